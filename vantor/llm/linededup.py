"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantor.llm import _bytes as B
from vantor.llm._ids import numbered
from vantor.llm._store import Table, shared_dir

#: Distinct (key, document) pairs that a task holds before it hands them on.
HELD = 1 << 21


class LineRuns:
    """Which line keys earlier batches hold: runs of distinct keys in levels, each a table bucketed and sorted by key.

    A batch adds a run to the lowest level; a level of ``fanout`` runs is merged into one run of the next, so a key is
    rewritten once a level and a batch is joined to fewer than ``fanout`` runs of each. Spark knows the buckets and their
    order, so only a new batch is shuffled and sorted: runs are read in order, one bucket a task, both for joins and merges.
    Runs can be kept and given to later calls; ``drop`` removes them.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # one file a bucket, so a scan is in order

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_dir(self.spark)}/{name}"
        writer = keys.select("k1", "k2").write.format("parquet").option("path", self.paths[name]).option("compression", "zstd")
        writer.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").saveAsTable(name)
        return name

    def _merge(self, a: str, b: str) -> str:
        """Two runs as one; they have no key in common, so their outer join is their union, made bucket by bucket in order."""
        x, y = self.spark.table(a).alias("x"), self.spark.table(b).alias("y")
        both = x.join(y, (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")), "full")
        return self._write(both.select(F.coalesce("x.k1", "y.k1").alias("k1"), F.coalesce("x.k2", "y.k2").alias("k2")))

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, keys: DataFrame) -> None:
        """Adds the distinct keys ``k1, k2``, none of which a run may have yet."""
        run, level = self._write(keys.select("k1", "k2").repartition(self.buckets, "k1", "k2")), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, *others = self.levels[level]
            self.levels[level] = []
            for other in others:
                merged = self._merge(run, other)
                self._remove(run)
                self._remove(other)
                run = merged
            level += 1

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def drop(self) -> None:
        for name in list(self.paths):
            self._remove(name)
        self.levels = []


def line_keys(text: B.Text, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all lines: the number of the text, both halves of the key's hash, and whether the key is long enough."""
    starts, ends, who = text.lines()
    ink = np.flatnonzero(B.NON_SPACE[text.data])
    a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    some = b > a
    at, to = starts.copy(), starts.copy()
    at[some] = ink[a[some]]
    to[some] = ink[b[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((text.data & 0xC0) != 0x80)])
    k1, k2 = text.lowered().hashes128(at, to)
    return who, k1, k2, points[to] - points[at] >= min_chars


def _extract(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``doc, k1, k2, later``: the distinct long keys of each document; ``later`` if a smaller document of the same task has the key too.

    Of the others there is one row for each key and task, so a line that most documents have is a few rows of a shuffle.
    """

    def pick(docs_, k1, k2):
        order = np.lexsort((docs_, k2, k1))
        d, a, b = docs_[order], k1[order], k2[order]
        same_key = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        once = ~(same_key & np.concatenate([[False], d[1:] == d[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(d[once]), pa.array(B.signed(a[once])), pa.array(B.signed(b[once])), pa.array(same_key[once])], ["doc", "k1", "k2", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in B.slices(batches, text_col):
            text = B.Text(batch.column(batch.schema.get_field_index(text_col)))
            ids = batch.column(batch.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            who, k1, k2, long_enough = line_keys(text, min_chars)
            held.append((ids[who[long_enough]], k1[long_enough], k2[long_enough]))
            n += len(held[-1][0])
            if n > HELD:
                yield pick(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield pick(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select(id_col, text_col).where(F.col(id_col).isNotNull()).mapInArrow(run, "doc long, k1 long, k2 long, later boolean")


def dropped_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2, runs: LineRuns | None = None) -> DataFrame:
    """``doc, k1, k2``: keys whose lines a document loses, as a document with a smaller id (a long) has them.

    The documents come in ``batches`` of about equal numbers, by rising ids. Each batch is merge-joined to the runs of the
    batches before it: keys found there are dropped, of the others the smallest id of the batch keeps the line and the key
    joins the runs. Given ``runs`` are asked first, get the keys of all batches, and stay.
    """
    spark = docs.sparkSession
    shares = [k / batches for k in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(id_col, shares, 10_000)).first()[0] if shares else []
    number = sum(((F.col("doc") > cut).cast("int") for cut in sorted(set(cuts or []))), F.lit(0))
    lines = Table(_extract(docs, id_col, text_col, min_chars).withColumn("batch", number), "line-keys", "batch")
    known, found = runs or LineRuns(spark, fanout), []
    for k in range(batches):
        batch = lines.df.where((F.col("batch") == k) & ~F.col("later")).select("doc", "k1", "k2")
        first = batch.withColumn("owner", F.min("doc").over(Window.partitionBy("k1", "k2")))
        seen = F.lit(False)
        for i, run in enumerate(known.runs()):
            first = first.join(run.withColumn(f"in{i}", F.lit(True)), ["k1", "k2"], "left")
            seen = seen | F.coalesce(F.col(f"in{i}"), F.lit(False))
        done = Table(first.select("doc", "k1", "k2", (seen | (F.col("doc") != F.col("owner"))).alias("lost"), seen.alias("seen")), "line-batch")
        if runs or k + 1 < batches:
            known.add(done.df.where(~F.col("lost")))
        found.append(done.df.where("lost").select("doc", "k1", "k2"))
    if not runs:
        known.drop()
    out = lines.df.where("later").select("doc", "k1", "k2")
    for lost in found:
        out = out.unionByName(lost)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with shortened texts, ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points that two or more documents hold lose all their lines but those in the document with the smallest id (of any type
    that has an order). Other lines stay, joined by newlines. Null and empty texts are one empty line (null texts come back
    empty). Rows that share an id are one document: each keeps or loses the same keys. Rows with a null id keep all lines and
    own none. Keys that given ``runs`` hold lose their lines in all documents. Columns that have a name of the result are
    replaced; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = numbered(docs, id_col, "_number")
    lost = dropped_keys(docs.drop(id_col).withColumnRenamed("_number", id_col), id_col, text_col, min_chars, batches, fanout, runs)
    per_doc = lost.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("k1").alias("_k1"), F.collect_list("k2").alias("_k2"))
    joined = docs.select(*names, "_number").join(per_doc, F.col("_number") == F.col("_doc"), "left").drop("_doc", "_number")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(parts, text_col):
            place = batch.schema.get_field_index(text_col)
            text = B.Text(batch.column(place))
            who, k1, k2, long_enough = line_keys(text, min_chars)
            gone = np.zeros(len(who), bool)
            a, b = batch.column(batch.schema.get_field_index("_k1")), batch.column(batch.schema.get_field_index("_k2"))
            if a.null_count < len(a):
                owner = np.repeat(np.arange(text.n), a.value_lengths().fill_null(0).to_numpy())
                bad1, bad2 = a.flatten().to_numpy().view(np.uint64), b.flatten().to_numpy().view(np.uint64)
                pairs = {}
                for o, x, y in zip(owner.tolist(), bad1.tolist(), bad2.tolist(), strict=True):
                    pairs.setdefault(o, set()).add((x, y))
                look = np.flatnonzero(long_enough & np.isin(who, np.unique(owner)))
                hit = [(x, y) in pairs[o] for o, x, y in zip(who[look].tolist(), k1[look].tolist(), k2[look].tolist(), strict=True)]
                gone[look[np.array(hit, bool)]] = True
            starts, ends, _ = text.lines()
            n_dropped = np.bincount(who[gone], minlength=text.n)
            texts = []
            edge = np.searchsorted(who, np.arange(text.n + 1))
            for i in range(text.n):
                if n_dropped[i]:
                    stay = np.flatnonzero(~gone[edge[i] : edge[i + 1]]) + edge[i]
                    texts.append(b"\n".join(text.data[s:e].tobytes() for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)))
                else:
                    texts.append(text.bytes_of(i))
            arrays = [batch.column(batch.schema.get_field_index(c)) if c != text_col else pa.array(texts, pa.binary()).cast(pa.string()) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(edge).astype(np.int64)), pa.array(n_dropped.astype(np.int64))], [*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, docs.select(*names).schema.add("n_lines", "long").add("n_dropped", "long"))
