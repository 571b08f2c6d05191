"""Nearest vectors by cosine: a set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to the tasks at once, and rows that a task compares with them at once.
BLOCK, ROWS = 4096, 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of length 1; null, zero and rows of another length become zeros, similar to nothing."""
    out = np.zeros((len(column), width))
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.flatnonzero(sizes == width)
    begin = np.cumsum(sizes) - sizes
    if len(good):
        out[good] = flat[begin[good][:, None] + np.arange(width)]
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """``query_id, <id>, similarity`` (four places): the ``k`` most similar rows of each query, smaller ids first among equals.

    Queries come to the driver in blocks and go to all tasks; a task gives its best ``k`` rows of each query, so what is
    shuffled doesn't grow with the rows.
    """
    spark, out = rows.sparkSession, None
    names = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("v")).where("v IS NOT NULL")
    width = names.select(F.max(F.size("v"))).first()[0] or 0
    n = names.count()
    blocks = max(1, -(-n // BLOCK))
    for part in range(blocks):
        taken = names.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == part).toArrow()
        ids, given = taken.column("q").to_numpy(), _matrix(taken.column("v").combine_chunks(), width)
        shared = spark.sparkContext.broadcast((ids, given))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, given = shared.value
            kept_id, kept_s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    cut = batch.slice(at, ROWS)
                    s = np.floor(given @ _matrix(cut.column(1), width).T * 1e4 + 0.5) / 1e4
                    every_s = np.concatenate([kept_s, s], 1)
                    every_id = np.concatenate([kept_id, np.broadcast_to(cut.column(0).to_numpy(), s.shape)], 1)
                    order = np.lexsort((every_id, -every_s), axis=1)[:, :k]
                    kept_s, kept_id = np.take_along_axis(every_s, order, 1), np.take_along_axis(every_id, order, 1)
            if kept_id.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, kept_id.shape[1])), pa.array(kept_id.ravel()), pa.array(kept_s.ravel())], ["query_id", id_col, "similarity"])

        some = rows.select(F.col(id_col).cast("long").alias(id_col), vector_col).where(F.col(id_col).isNotNull())
        found = some.mapInArrow(best, f"query_id long, `{id_col}` long, similarity double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col)
    return out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")
