"""The nightly run over landed pages: stages in order, what is skipped as fresh, degraded under pressure, and the closing report."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("discover", "crawl", "extract", "resolve", "facts", "verify", "quality", "history", "index")


def priority(urgent: Column, campaign: Column, fit: Column, stale_customer: Column, new: Column) -> Column:
    """P0 for campaigns and urgent items, P1 for high fit and stale customers, P2 for new ones, else P3."""
    return F.when(urgent | campaign, "P0").when((fit >= 0.8) | stale_customer, "P1").when(new, "P2").otherwise("P3")


def stale(ts: Column, as_of: Column, days: Column) -> Column:
    """Null times are stale."""
    age = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400.0
    return ts.isNull() | (age >= days)


def not_fresh(candidates: DataFrame, crawled: DataFrame, host: str, ts: str, as_of: Column, days: int = 30) -> DataFrame:
    """Candidates of which no page is newer than ``days``."""
    return candidates.join(crawled.where(F.col(ts) > as_of - F.expr(f"INTERVAL {days} DAYS")).select(host).distinct(), host, "left_anti")


def circuit(calls: DataFrame, key: str, ts: str, ok: str, failures: int = 5, seconds: int = 30) -> DataFrame:
    """``state`` of each call's breaker: it opens after failures in a row and tries again after a while. One ordered pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, row, opened = None, 0, None
        for part in parts:
            states = []
            for k, t, good in zip(part[key], part[ts], part[ok], strict=True):
                if k != last:
                    last, row, opened = k, 0, None
                if opened is not None and (t - opened).total_seconds() < seconds:
                    states.append("open")
                    continue
                states.append("half_open" if opened is not None else "closed")
                row = 0 if good else row + 1
                opened = None if good else t if opened is not None or row >= failures else None
            yield part.assign(state=states)

    return calls.repartition(F.col(key)).sortWithinPartitions(key, ts).mapInPandas(run, calls.schema.add("state", "string"))


def report(runs: DataFrame, cost: Column) -> DataFrame:
    """Counts, failures and cost of a run and for each company."""
    found = runs.agg(F.count("*").alias("pages"), F.countDistinct("company").alias("companies"), F.count_if("failed").alias("failures"), F.sum(cost).alias("cost"))
    return found.withColumn("cost_per_company", F.col("cost") / F.greatest(F.col("companies"), F.lit(1)))


def hydrate(parents: DataFrame, key: str, children: dict[str, DataFrame], order: str) -> DataFrame:
    """Parents with their children as arrays of structs, one aggregation for each kind."""
    out = parents
    for name, rows in children.items():
        fields = [c for c in rows.columns if c != key]
        packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name))
        out = out.join(packed, key, "left")
    return out
