"""Near-duplicates by the Jaccard similarity of word shingles: SimHash components and, beyond their reach, min-hash bands find
candidates; sets of shingles verify them.

Four differing bits hold about half of the copies of similarity 0.8 to 0.95, so the dealt index alone can't find them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.llm import _bytes as B
from vantor.llm import simhash
from vantor.llm._graph import components
from vantor.llm._store import written

WIDTH = 5
#: Links have at least this similarity, as a fraction.
SIMILARITY = (4, 5)
#: Texts of similarity s share a bucket with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Shingles that are compared at once; larger buckets are cut into chunks, whose pairs are compared.
CHUNK = 1 << 21
_FACTORS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_ADDED = np.random.default_rng(18).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_sets(text: B.Text, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's shingles of ``width`` lower-cased words (fewer words: the whole sequence), distinct and sorted, and where each text's begin."""
    low = text.lowered()
    starts, ends = low.words(B.NON_SPACE)
    who = low.owner(starts)
    word = low.hashes(starts, ends)
    n = np.bincount(who, minlength=text.n)
    first = np.cumsum(n) - n
    own = np.arange(len(starts)) - first[who]
    heads = np.flatnonzero((own <= n[who] - width) | (own == 0) & (n[who] < width))
    last = (first + n)[who[heads]]
    h = np.zeros(len(heads), np.uint64)
    for k in range(width):
        at = heads + k
        h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(at < last, word[np.minimum(at, max(len(word) - 1, 0))] if len(word) else h, np.uint64(k + 1)))
    owner = who[heads]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])[: len(h)]
    h, owner = h[fresh], owner[fresh]
    return h, np.searchsorted(owner, np.arange(text.n + 1))


def sketches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set, and the hashes of its bands of minima (texts without words: 0)."""
    n = len(at) - 1
    sig, bands = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    some = at[1:] > at[:-1]
    if not some.any():
        return sig, bands
    begin = at[:-1][some]
    sig[some] = B.mix(np.add.reduceat(B.mix(h ^ np.uint64(0x5851F42D4C957F2D)), begin) + (at[1:] - at[:-1])[some].astype(np.uint64))
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = B.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * _FACTORS[k] + _ADDED[k], begin))
        bands[some, band] = key
    return sig, bands


def linked(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of sets at least so similar, enough to connect all that such pairs connect: each set is compared with those not reached yet."""
    num, den = similarity
    size = np.array([len(s) for s in sets], np.int64)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    mine = np.cumsum(size) - size
    order = np.argsort(item, kind="stable")
    holder = row[order]
    edge = np.searchsorted(item[order], np.arange(int(item.max(initial=-1)) + 2))
    left, found = np.ones(len(sets), bool), []
    for s in range(len(sets)):
        if not left[s]:
            continue
        left[s], stack = False, [s]
        while stack and left.any():
            i = stack.pop()
            items = item[mine[i] : mine[i] + size[i]]
            length = edge[items + 1] - edge[items]
            skip = np.repeat(edge[items] - (np.cumsum(length) - length), length)
            common = np.bincount(holder[np.arange(int(length.sum())) + skip], minlength=len(sets))
            near = np.flatnonzero(left & (common * (num + den) >= num * (size[i] + size)))
            left[near] = False
            found += [(i, int(k)) for k in near]
            stack += near.tolist()
    return found


def _buckets(indexed: DataFrame, chunk: int) -> DataFrame:
    """``bucket, sig, chunk``: the members of each bucket of two or more; buckets of equal members are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3

        def whole(keys, sigs, sizes):
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            length = np.diff(np.append(edge, len(keys)))
            upto = np.cumsum(sizes) - sizes
            mark = np.add.reduceat(B.mix(sigs.view(np.uint64)), edge) if len(edge) else np.zeros(0, np.uint64)
            name = B.signed(B.mix(mark + length.astype(np.uint64)))
            part = (upto - np.repeat(upto[edge], length)) // chunk
            some = np.repeat(length > 1, length)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, length)[some]), pa.array(sigs[some]), pa.array(part[some].astype(np.int32))], ["bucket", "sig", "chunk"])

        for batch in batches:
            keys, sigs, sizes = (np.concatenate([k, batch.column(c).to_numpy()]) for c, k in enumerate(kept))
            cut = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            yield whole(keys[:cut], sigs[:cut], sizes[:cut])
            kept = [x[cut:] for x in (keys, sigs, sizes)]
        yield whole(*kept)

    keyed = indexed.select(F.explode("bands").alias("key"), "sig", "n").repartition(F.col("key")).sortWithinPartitions("key", "sig")
    return keyed.mapInArrow(run, "bucket long, sig long, chunk int").distinct()


def _verified(units: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The links ``a > b`` inside each unit (columns ``unit, sig``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}

        def links():
            names = list(held)
            pairs = np.array([(names[i], names[k]) for i, k in linked(list(held.values()), similarity)] if len(held) > 1 else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], ["a", "b"]) if len(pairs) else None

        for batch in batches:
            for u, sig, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if u != unit:
                    if out := links():
                        yield out
                    unit, held = u, {}
                held[sig] = x.values.to_numpy()
        if out := links():
            yield out

    rows = units.join(sets, "sig").select("unit", "sig", "shingles").repartition(F.col("unit")).sortWithinPartitions("unit")
    return rows.mapInArrow(run, "a long, b long").distinct()


def links(marked: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: tuple[int, int], chunk: int = CHUNK) -> DataFrame:
    """Links between the sets of ``marked`` (``id, sig, n, fp, bands``), enough to connect all that verified candidates connect.

    A bucket's chunks are each compared with the first one; where that leaves a bucket in several components, all pairs of its chunks are compared.
    """
    one = marked.where("n > 0").groupBy("sig").agg(F.min_by(F.struct("id", "n", "fp", "bands"), "id").alias("x")).select("sig", "x.*")
    one = written(one, "shingles-distinct")
    near = simhash.components(simhash.links(one.select("fp").distinct())).withColumnRenamed("node", "fp")
    keyed = one.join(near, "fp", "left").select(F.when(F.col("root").isNull(), F.col("bands")).otherwise(F.array_append("bands", F.xxhash64("root"))).alias("bands"), "sig", "n")
    buckets = written(_buckets(keyed, chunk), "shingles-buckets")
    wanted = buckets.select("sig").distinct().join(one.select("sig", "id"), "sig").withColumnRenamed("sig", "_sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            h, at = shingle_sets(B.Text(batch.column(0)), width)
            sig, _ = sketches(h, at)
            arrays = [pa.array(B.signed(sig)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(B.signed(h)))]
            batch = pa.RecordBatch.from_arrays([batch.column(1), *arrays], ["_sig", "sig", "shingles"])
            yield batch.filter(pa.compute.equal(batch.column(0), batch.column(1)))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id").select("text", "_sig")
    schema = T.StructType().add("_sig", "long").add("sig", "long").add("shingles", T.ArrayType(T.LongType()))
    sets = written(texts.mapInArrow(run, schema).select("sig", "shingles"), "shingles-sets")
    unit = lambda a, b: F.xxhash64("bucket", a, b).alias("unit")
    many = buckets.groupBy("bucket").agg(F.max("chunk").alias("last")).where("last > 0")
    first = F.lit(0)
    heads = buckets.where("chunk = 0").join(many, "bucket").select("*", F.explode(F.sequence(F.lit(1), "last")).alias("other"))
    round_1 = buckets.select(unit(first, F.col("chunk")), "sig").union(heads.select(unit(first, F.col("other")), "sig"))
    found = written(_verified(round_1, sets, similarity), "shingles-links")
    if not many.limit(1).count():
        return found
    roots = written(components(found), "shingles-roots")
    large = buckets.join(many, "bucket").join(roots, F.col("sig") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sig"))
    open_ = large.withColumn("x", F.min("root").over(Window.partitionBy("bucket"))).withColumn("y", F.max("root").over(Window.partitionBy("bucket"))).where("x <> y")
    pairs = open_.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    round_2 = pairs.select(unit(F.least("chunk", "other"), F.greatest("chunk", "other")), "sig")
    return found.union(_verified(round_2, sets, similarity)).distinct()


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` without those that reach a smaller id over pairs of texts whose sets of shingles have at least the similarity.

    Candidates share a SimHash component (fingerprints at most four bits apart, by the deletion-variant index) or a band of
    minima. Texts without words are alike, and so are null texts. Rows that repeat the smallest id stay, and so do rows without
    id, which take no part. An empty table gives an empty result; further columns stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            text = B.Text(batch.column(1))
            h, at = shingle_sets(text, width)
            sig, bands = sketches(h, at)
            fps = simhash.simhash(text.lowered(), width).view(np.int64)
            cut = pa.array(np.arange(0, len(sig) * BANDS + 1, BANDS, dtype=np.int32))
            arrays = [pa.array(B.signed(sig)), pa.array(np.diff(at)), pa.array(fps), pa.ListArray.from_arrays(cut, pa.array(B.signed(bands.ravel())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "sig", "n", "fp", "bands"])

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = named.select("id").schema.add("sig", "long").add("n", "long").add("fp", "long").add("bands", T.ArrayType(T.LongType()))
    marked = written(named.mapInArrow(run, schema), "shingles")
    roots = written(components(links(marked, docs, id_col, text_col, width, similarity, chunk)), "shingles-roots")
    least = marked.groupBy("sig").agg(F.min("id").alias("_least")).join(roots, F.col("sig") == F.col("node"), "left").select("sig", "_least", F.coalesce("root", "sig").alias("_root"))
    labels = least.join(least.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("sig", "component_id")
    others = marked.select("id", "sig").join(labels, "sig").where("id <> component_id").select(F.col("id").alias(id_col)).distinct()
    return docs.join(others, id_col, "left_anti").select(*docs.columns)
