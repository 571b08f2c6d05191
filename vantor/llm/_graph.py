"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm._store import Table


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: each node of ``edges`` (``a, b``) with the smallest node that it is connected to.

    Alternates large-star and small-star steps, each an aggregation and a join, until the edges form stars.
    """
    now = Table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    mark = None
    while True:
        both = now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        step = Table(large, "components")
        least = step.df.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = step.df.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        after = Table(small, "components")
        now.drop()
        step.drop()
        now = after
        sign = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == mark:
            break
        mark = sign
    stars = now.df
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
