"""Ids of any type as numbers of the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.llm._store import written


def numbered(docs: DataFrame, id_col: str, name: str = "_doc") -> DataFrame:
    """``docs`` with a long ``name`` that orders rows as their ids do (null for null ids).

    Integer ids stand for themselves. Others are sorted once by ranges; a row's number counts on from partition to partition.
    """
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return docs.withColumn(name, F.col(id_col).cast("long"))
    ids = docs.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().orderBy("_id")
    ids = written(ids.withColumn(name, F.monotonically_increasing_id()), "ids")
    return docs.join(ids, F.col(id_col) == F.col("_id"), "left").drop("_id")
