"""Roll-ups and operational statistics: each is one aggregation or one window over its input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.functions.numeric import rnd


def counts_by_status(rows: DataFrame, status: str, every: tuple[str, ...]) -> DataFrame:
    """A row for each status of the list, with 0 where there is none."""
    listed = rows.sparkSession.createDataFrame([(s,) for s in every], "status string")
    return listed.join(rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def feedback(rows: DataFrame, kind: str, right: Column) -> DataFrame:
    each = rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))
    return each.select("kind", "n", rnd(F.col("n_right") / F.col("n"), 3).alias("accuracy"))


def nearest_rank(rows: DataFrame, key: str, value: str, at: tuple[float, ...] = (0.50, 0.95, 0.99)) -> DataFrame:
    """The value at place int(n * p) of each key's sorted values: by window, so that no group is collected."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return placed.groupBy(key).agg(*[F.max(F.when(F.col("_i") == F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(value))).alias(f"p{round(p * 100)}") for p in at])


def budget(rows: DataFrame, key: str, order: str, cost: Column, limit: float) -> DataFrame:
    """``spent, mode``: the running cost and how far it makes the work lighter."""
    spent = F.sum(cost).over(Window.partitionBy(key).orderBy(order))
    share = spent / F.lit(limit)
    mode = F.when(share > 1.0, "stopped").when(share >= 0.80, "light").when(share >= 0.60, "standard").otherwise("full")
    return rows.withColumn("spent", rnd(spent, 2)).withColumn("mode", mode)


def resume_stage(checkpoints: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """The first stage of each run that isn't completed (null: all are)."""
    listed = checkpoints.sparkSession.createDataFrame(list(enumerate(stages)), "place int, stage string")
    done = checkpoints.where("status = 'completed'").select("run_id", "stage").distinct()
    open_ = checkpoints.select("run_id").distinct().join(F.broadcast(listed)).join(done, ["run_id", "stage"], "left_anti")
    return checkpoints.select("run_id").distinct().join(open_.groupBy("run_id").agg(F.min_by("stage", "place").alias("stage")), "run_id", "left")


def sliding_rate(rows: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """``in_window, limited``: requests of the last seconds, this one included, and whether they are too many."""
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds + 1, 0)
    return rows.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > most)


def last_of_each(rows: DataFrame, key: str, order: list[Column], k: int = 50) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def leases(beats: DataFrame, key: str, ts: str, seconds: int = 300) -> DataFrame:
    """Leases of a worker's heartbeats: a gap of more than the lease begins a new one."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(ts).over(w).cast("timestamp"))
    marked = beats.withColumn("_new", F.when(gap.isNull() | (gap > seconds), 1).otherwise(0)).withColumn("lease", F.sum("_new").over(w))
    return marked.groupBy(key, "lease").agg(F.min(ts).alias("began"), F.max(ts).alias("last_beat"), F.count("*").alias("beats"))


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with ``total`` and ``has_more``."""
    total = rows.agg(F.count("*").alias("total"))
    return page_of(rows, order, offset, limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row of totals


def table_filter(rows: DataFrame, text: str, order: str, descending: bool = False) -> DataFrame:
    """Rows whose JSON contains a text, without case; sorted with nulls last."""
    kept = rows.where(F.lower(F.to_json(F.struct("*"))).contains(text.lower()))
    return kept.orderBy(F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last())


def evaluation(rows: DataFrame, task: str, valid: Column, latency: Column, cost: Column) -> DataFrame:
    """``task, cases, validity_rate, avg_latency, total_cost`` of evaluated cases."""
    out = rows.groupBy(F.col(task).alias("task")).agg(F.count("*").alias("cases"), F.count_if(valid).alias("_v"), F.avg(latency).alias("_l"), F.sum(cost).alias("_c"))
    return out.select("task", "cases", rnd(F.col("_v") / F.col("cases"), 4).alias("validity_rate"), rnd(F.col("_l"), 2).alias("avg_latency"), rnd(F.col("_c"), 4).alias("total_cost"))


def project_overview(prospects: DataFrame, project: str, status: str, score_status: str) -> DataFrame:
    """Counts of a project's prospects by their status and that of their score (null: not ranked)."""
    s, r = F.col(status), F.col(score_status)
    return prospects.groupBy(project).agg(
        F.count("*").alias("candidates"), F.count_if(r.isNotNull()).alias("ranked"), (F.count_if(s == "researching") + F.count_if(r == "research_more")).alias("research_needed"),
        F.count_if(r == "reverify").alias("reverify_needed"), F.count_if(s == "campaign_ready").alias("campaign_ready"), F.count_if(s == "rejected").alias("rejected"),
    )


def usage(rows: DataFrame, key: str, units: Column, tiers: dict[str, int], tier: Column) -> DataFrame:
    """``key, tier, used, quota, remaining, over``: what each key has used of its tier's quota."""
    quota = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    used = rows.groupBy(key).agg(F.sum(units).alias("used"), F.max(tier).alias("tier"))
    out = used.withColumn("quota", F.try_element_at(quota, F.col("tier")))
    return out.select(key, "tier", "used", "quota", F.greatest(F.col("quota") - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") > F.col("quota")).alias("over"))


def gate_metrics(rows: DataFrame, gate: str, status: str, reason: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """How often each gate gave each status, and the most frequent reasons."""
    return rows.groupBy(gate, status).agg(F.count("*").alias("n")), rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason).limit(most)


def throttle(alerts: DataFrame, key: str, ts: str, seconds: int = 300, tie: str | None = None) -> DataFrame:
    """``dispatched``: an alert goes out if none of its key has gone out in the last seconds; of equal times the first by ``tie``.

    One ordered pass that holds one time; each step jumps to the next alert that goes out.
    """

    def run(parts):
        last, until = None, None
        for part in parts:
            keys, times = part[key].to_numpy(), part[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
            sent = np.zeros(len(part), bool)
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True):
                at = a if keys[a] != last else a + int(np.searchsorted(times[a:b], until))
                while at < b:
                    sent[at] = True
                    until = times[at] + seconds * 1_000_000
                    at = max(at + 1, a + int(np.searchsorted(times[a:b], until)))
                last = keys[a]
            yield part.assign(dispatched=sent)

    order = [key, ts, *([tie] if tie else [])]
    return alerts.repartition(F.col(key)).sortWithinPartitions(*order).mapInPandas(run, alerts.schema.add("dispatched", "boolean"))


def monthly_quota(rows: DataFrame, key: str, ts: str, most: int) -> DataFrame:
    """``used_in_month, over_quota`` of each request, in the order of time."""
    w = Window.partitionBy(key, F.date_trunc("month", ts)).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used_in_month", F.count("*").over(w)).withColumn("over_quota", F.col("used_in_month") > most)


def newest(rows: DataFrame, key: str, order: list[Column], k: int = 1000) -> DataFrame:
    """The newest rows of each key, on which rolling statistics stand."""
    return last_of_each(rows, key, order, k).drop("place")


def reclaim(leases_: DataFrame, now: Column, expires: str, attempts: str, most: int = 3) -> DataFrame:
    """``state, attempts`` of leased jobs: expired ones wait again, or fail after too many attempts."""
    late = F.col(expires) < now
    state = F.when(late & (F.col(attempts) + 1 >= most), "failed").when(late, "pending").otherwise("leased")
    return leases_.withColumn("state", state).withColumn(attempts, F.col(attempts) + late.cast("int"))


def progress(events: DataFrame, run: str, stage: str, ts: str, stages: tuple[str, ...]) -> DataFrame:
    """``stages_done, percent, current, began, last_at`` of each run: the furthest of the listed stages that it has reached."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage))
    known = events.where(F.col(stage).isin(*stages))
    out = known.groupBy(run).agg(F.countDistinct(stage).alias("stages_done"), F.max_by(stage, F.struct(place, ts)).alias("current"), F.min(ts).alias("began"), F.max(ts).alias("last_at"))
    return out.withColumn("percent", F.floor(F.col("stages_done") * 100 / len(stages)).cast("int"))


def cached(entries: DataFrame, key: list[str], ts: str, now: Column, seconds: int) -> DataFrame:
    """The newest entry of each key that has not outlived its time."""
    live = entries.where((F.col(ts) <= now) & (F.col(ts) > now - F.expr(f"INTERVAL {seconds} SECONDS")))
    fields = [c for c in entries.columns if c not in key]
    return live.groupBy(*key).agg(F.max_by(F.struct(*fields), ts).alias("_e")).select(*key, *[F.col(f"_e.{c}").alias(c) for c in fields])


def presence_changes(sightings: DataFrame, key: str, period: str) -> DataFrame:
    """``key, period, event``: ``appeared`` where a key is first seen, ``disappeared`` in the first period without it, ``reappeared`` where it is seen again.

    Periods are whole numbers; one that nothing was seen in counts as a period.
    """
    seen = sightings.select(F.col(key), F.col(period).cast("long").alias("p")).distinct()
    w = Window.partitionBy(key).orderBy("p")
    last = sightings.agg(F.max(F.col(period).cast("long")).alias("_last"))
    rows = seen.withColumn("before", F.lag("p").over(w)).withColumn("after", F.lead("p").over(w)).crossJoin(F.broadcast(last))  # one row
    here = F.when(F.col("before").isNull(), "appeared").when(F.col("before") < F.col("p") - 1, "reappeared")
    gone = F.when(F.coalesce("after", F.col("_last") + 1) > F.col("p") + 1, "disappeared")
    events = F.array(F.struct(F.col("p").alias("period"), here.alias("event")), F.struct((F.col("p") + 1).alias("period"), gone.alias("event")))
    return rows.select(key, F.inline(events)).where("event IS NOT NULL")
