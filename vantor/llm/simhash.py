"""SimHash near-duplicates: fingerprints, deletion-variant candidates and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm import _bytes as B
from vantor.llm._graph import components
from vantor.llm._store import Table, written
from vantor.llm._xxh import xxh64

BITS = 64
#: Cuts of the fingerprint: of three segments, one differs by at most one bit if all of it differs by at most four.
SEGMENTS = ((0, 21), (21, 42), (42, 64))
MOST_BITS = 4
#: A task holds buckets of up to so many fingerprints (of 16 bytes).
BUCKET = 1 << 20
#: Buckets of up to so many fingerprints are compared pair by pair.
SMALL = 1024
_CHUNK = 1 << 16


_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def simhash(text: B.Text, width: int, seed: int = 42) -> np.ndarray:
    """The SimHash of each text over its shingles of ``width`` words (fewer words: the whole sequence; none: 0); repeated shingles count again."""
    starts, ends = text.words(B.NON_SPACE)
    out = np.zeros(text.n, np.uint64)
    if not len(starts):
        return out
    # the words alone, each followed by one space
    size = ends - starts
    line = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    line[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = text.data[B.NON_SPACE[text.data]]
    at = np.cumsum(np.concatenate([[0], (size + 1)[:-1]]))
    stop = at + size
    who = text.owner(starts)
    n = np.bincount(who, minlength=text.n)
    first = np.cumsum(n) - n
    own = np.arange(len(starts))
    heads = np.flatnonzero((own - first[who] <= n[who] - width) | (own == first[who]) & (n[who] < width))
    tails = np.minimum(heads + width, (first + n)[who[heads]]) - 1
    h = xxh64(line, at[heads], stop[tails] - at[heads], seed)
    owner = who[heads]
    total = np.bincount(owner, minlength=text.n)
    octets = h.view(np.uint8).reshape(-1, 8)
    for lo in range(0, text.n, 512):  # bounds the tables of byte counts
        hi = min(text.n, lo + 512)
        a, b = np.searchsorted(owner, (lo, hi))
        cell = (owner[a:b] - lo) << 8
        for k in range(8):
            seen = np.bincount(cell + octets[a:b, k], minlength=(hi - lo) << 8).reshape(-1, 256)
            ones = seen.astype(np.float64) @ _BIT
            bits = 2 * ones > total[lo:hi, None]
            out[lo:hi] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, width: int = 5, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of ``docs`` with ``fp``, the fingerprint's bits as a long. Null and blank texts have fingerprint 0."""
    names = [c for c in (keep or docs.columns) if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, text_col):
            text = B.Text(batch.column(batch.schema.get_field_index(text_col))).lowered()
            fps = pa.array(simhash(text, width).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), fps], [*names, "fp"])

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, docs.select(*names).schema.add("fp", "long"))


def _bucket_keys():
    """One key for each bit: the bit's number, and the rest of its segment with that bit left out."""
    keys = []
    for low, high in SEGMENTS:
        for p in range(low, high):
            mask = ((1 << high) - (1 << low)) & ~(1 << p)
            part = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), low)
            keys.append(part.bitwiseOR(F.lit(p << 22)))
    return F.array(*keys)


def _inner_keys(fp, outer):
    """Keys for the rows of one bucket: the bucket's, with one-wildcard segments of the bits that its members may differ in.

    Members of a bucket differ in at most one bit of its segment, so of three cuts of the other bits one differs by at most one
    bit if all differ by at most four.
    """
    keys = []
    for low, high in SEGMENTS:
        others = [p for p in range(BITS) if not low <= p < high]
        within = (F.shiftright(outer, 22) >= low) & (F.shiftright(outer, 22) < high)
        inner = []
        for part in np.array_split(np.array(others), len(SEGMENTS)):
            for p in part.tolist():
                mask = sum(1 << k for k in part.tolist() if k != p)
                inner.append(F.xxhash64(outer, F.lit(p), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
        keys.append(F.when(within, F.array(*inner)))
    return F.coalesce(*keys)


def _chunks(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of sorted keys of at least ``most`` rows (the last may have fewer), each of which ends with a bucket."""
    lo = 0
    while lo < len(keys):
        hi = int(np.searchsorted(keys, keys[min(lo + most, len(keys)) - 1], "right"))
        yield lo, hi
        lo = hi


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i] for every i; the numbers of the pairs that joined two sets, which form a forest.

    ``label`` has the smallest member of every member's set, before and after. Each round hooks the larger roots of the pairs
    that are still apart, each by one pair and to a smaller root, so there is no circle, and then shortens all ways to one step.
    """
    left, picked = np.arange(len(a)), []
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(picked) if picked else left
        high, first = np.unique(np.maximum(x, y), return_index=True)
        label[high] = np.minimum(x, y)[first]
        picked.append(left[first])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def _compared(keys: np.ndarray, who: np.ndarray, fps: np.ndarray, label: np.ndarray, most_bits: int, found: list) -> None:
    """Compares all rows of equal keys (sorted) that aren't in one set yet; adds the links (of ``who``) that join two sets."""
    live, d, checked = np.arange(len(fps)), 1, 2
    while True:
        live = live[live + d < len(fps)]
        live = live[keys[live] == keys[live + d]]
        if not len(live):
            return
        near = live[np.bitwise_count(fps[live] ^ fps[live + d]) <= most_bits]
        if len(near):
            near = near[_join(label, who[near], who[near + d])]
            found.append(np.stack([who[near], who[near + d]]))
        d += 1
        if d == checked:  # buckets that are in one piece need no more comparisons
            checked *= 2
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            mine = label[who]
            whole = np.minimum.reduceat(mine, edge) == np.maximum.reduceat(mine, edge)
            live = live[~np.repeat(whole, np.diff(np.append(edge, len(keys))))[live]]


def _split(who: np.ndarray, fps: np.ndarray, label: np.ndarray, most_bits: int, found: list, small: int) -> None:
    """Links the rows of one bucket: a large one by one-wildcard segments of the bits in which its rows differ, in turn."""
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [k for k in range(BITS) if differ >> k & 1]
    if len(fps) <= small or len(places) < 2 * len(SEGMENTS):
        _compared(np.zeros(len(fps), np.int8), who, fps, label, most_bits, found)
        return
    for part in np.array_split(np.array(places), len(SEGMENTS)):
        for p in part.tolist():
            if (label[who] == label[who[0]]).all():
                return
            mask = sum(1 << k for k in part.tolist() if k != p)
            keys = fps & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            k, w, f = keys[order], who[order], fps[order]
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(edge, len(k)))
            few = np.repeat(size <= small, size)
            _compared(k[few], w[few], f[few], label, most_bits, found)
            for at, n in zip(edge[size > small].tolist(), size[size > small].tolist(), strict=True):
                _split(w[at : at + n], f[at : at + n], label, most_bits, found, small)


def _linked(keys: np.ndarray, fps: np.ndarray, most_bits: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal keys (sorted) that join all rows which links of at most ``most_bits`` connect.

    Together they are a forest: fewer links than there are different fingerprints, however many pairs are near.
    """
    one, who = np.unique(fps, return_inverse=True)
    label, found = np.arange(len(one)), []
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    size = np.diff(np.append(edge, len(keys)))
    few = np.repeat(size <= small, size)
    _compared(keys[few], who[few], fps[few], label, most_bits, found)
    for at, n in zip(edge[size > small].tolist(), size[size > small].tolist(), strict=True):
        _split(who[at : at + n], fps[at : at + n], label, most_bits, found, small)
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return one[a], one[b]


def links(distinct: DataFrame, most_bits: int = MOST_BITS, bucket: int = BUCKET, small: int = SMALL) -> DataFrame:
    """Pairs ``a > b`` of fingerprints (column ``fp`` of ``distinct``) at most ``most_bits`` apart, enough to connect all that such pairs connect.

    Each fingerprint is indexed under its 64 one-wildcard segments; buckets of equal keys are sorted together and verified
    inside: all pairs of buckets of up to ``small`` rows; larger ones are cut by one-wildcard segments of the other bits. Rows
    of a bucket beyond ``bucket``, which no task shall hold, are dealt again by key and segments of the other bits; what is
    still beyond it goes to :func:`balls`.
    """
    if most_bits > MOST_BITS:
        raise ValueError(f"three segments find up to {MOST_BITS} differing bits")

    def verified(indexed: DataFrame) -> DataFrame:
        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held_k, held_f, dense_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
            for batch in batches:
                keys = np.concatenate([held_k, batch.column(1).to_numpy()])
                fps = np.concatenate([held_f, batch.column(0).to_numpy()])
                if dense_key is not None:  # more of a bucket that is already known to be dense
                    n = int(np.searchsorted(keys, dense_key, "right"))
                    if n:
                        yield rows(fps[:n], keys[:n], True)
                    keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    held_k, held_f = keys, fps
                    continue
                cut = int(np.searchsorted(keys, keys[-1], "left"))
                yield from whole(keys[:cut], fps[:cut])
                held_k, held_f = keys[cut:], fps[cut:]
                dense_key = None
                if len(held_k) > bucket:
                    dense_key = held_k[-1]
                    yield rows(held_f, held_k, True)
                    held_k, held_f = held_k[:0], held_f[:0]
            yield from whole(held_k, held_f)

        def rows(a, b, dense):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), dense))], ["a", "b", "dense"])

        def whole(keys, fps):
            if not len(keys):
                return
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(edge, len(keys)))
            big = np.repeat(size > bucket, size)
            if big.any():
                yield rows(fps[big], keys[big], True)
                keys, fps = keys[~big], fps[~big]
            for lo, hi in _chunks(keys, _CHUNK):
                a, b = (x.view(np.int64) for x in _linked(keys[lo:hi], fps[lo:hi].view(np.uint64), most_bits, small))
                if len(a):
                    yield rows(np.maximum(a, b), np.minimum(a, b), False)

        return indexed.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(verify, "a long, b long, dense boolean")

    found = Table(verified(distinct.select("fp", F.explode(_bucket_keys()).alias("key"))).distinct(), "simhash-links").df
    pairs = found.where("NOT dense").select("a", "b")
    if not found.where("dense").limit(1).count():
        return pairs
    # for rows of dense buckets, ``b`` is the bucket's key
    again = found.where("dense").select(F.col("a").alias("fp"), F.explode(_inner_keys(F.col("a"), F.col("b"))).alias("key"))
    inner = Table(verified(again).distinct(), "simhash-links").df
    pairs = pairs.unionByName(inner.where("NOT dense").select("a", "b"))
    dense = inner.where("dense").select(F.col("a").alias("fp")).distinct()
    return pairs.unionByName(balls(dense, most_bits)) if dense.limit(1).count() else pairs


def balls(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links among fingerprints of dense buckets without comparing them.

    Two are at most ``2 r`` bits apart exactly if some point is within r bits of both, and all within r bits of one point are
    at most 2 r apart: so each names the points within r, and those of one point are linked to the smallest of them.
    """
    if most_bits % 2:
        raise ValueError("balls need an even number of bits")
    flips = [0]
    for _ in range(most_bits // 2):
        flips = sorted({x ^ (1 << p) for x in flips for p in range(BITS)} | set(flips))
    table = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in flips]) if len(flips) < 100 else F.from_json(F.lit("[" + ",".join(str(x - (1 << 64) if x >> 63 else x) for x in flips) + "]"), "array<bigint>")
    points = fps.select("fp", F.explode(table).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return points.join(least, "point").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, bucket: int = BUCKET, small: int = SMALL) -> DataFrame:
    """The kept columns of ``docs`` with ``fp``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints that differ in at most ``most_bits`` bits are linked; ``component_id`` is the smallest id that a document
    reaches over links, its own included. Null and blank texts have fingerprint zero and are linked like any other.
    Null ids are never the smallest (a component of null ids alone has a null id). Repeated rows are in one component.
    Columns that have a name of the result are replaced; an empty table gives an empty result.
    """
    made = ("fp", "fingerprint", "component_id")
    names = [c for c in (keep or docs.columns) if c not in made]
    marked = written(fingerprints(docs, width, text_col, tuple(dict.fromkeys([*names, id_col]))), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min(id_col).alias("_least")), "simhash-distinct")
    roots = written(components(links(distinct.select("fp"), most_bits, bucket, small)), "simhash-roots")
    known = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = known.groupBy("_root").agg(F.min("_least").alias("component_id"))
    labels = known.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(labels, F.col("fp") == F.col("_fp"), "left").select(*names, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that have a smaller id in their component. Rows that repeat the smallest id, and rows without id, stay."""
    found = near_duplicates(docs, width, most_bits, id_col, text_col, keep=(id_col,))
    others = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(others, id_col, "left_anti").select(*docs.columns)
