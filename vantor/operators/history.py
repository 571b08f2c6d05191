"""Change events, intervals of validity, states as of a time, and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.functions.numeric import rnd

LEVELS = ("low", "medium", "high", "critical")
#: The significance of predicates and of events.
PREDICATE_LEVEL = {"company.headquarters": "high", "company.legal_name": "high", "company.employee_count": "high", "company.employee_range": "high", "company.funding_stage": "high", "company.revenue_range": "high", "company.industry": "medium", "company.technology": "medium", "company.description": "low", "company.email": "low", "company.phone": "low", "person.title": "medium", "person.email": "low"}
EVENT_LEVEL = {"employment_started": "medium", "employment_ended": "medium", "location_added": "high", "location_removed": "medium", "technology_added": "medium", "technology_removed": "medium", "domain_changed": "high", "interpretation_revised": "low"}


def changes(rows: DataFrame, key: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """Each row that has another value than the one before: ``previous_value, delta, pct`` (0 if the previous value is 0)."""
    w = Window.partitionBy(*key).orderBy(ts, tie)
    out = rows.withColumn("previous_value", F.lag(value).over(w)).where(F.col("previous_value").isNotNull() & (F.col("previous_value") != F.col(value)))
    delta = F.col(value) - F.col("previous_value")
    pct = F.when(F.col("previous_value") != 0, delta / F.col("previous_value") * 100.0).otherwise(0.0)
    return out.withColumn("delta", rnd(delta, 2)).withColumn("pct", rnd(pct, 2))


def value_range(x: Column) -> Column:
    """(low, high) of "51-200" or "500+", else null."""
    clean = F.regexp_replace(x, ",", "")
    low, high = (F.regexp_extract(clean, r"(\d+)\s*[-–]\s*(\d+)", k).try_cast("long") for k in (1, 2))
    open_ = F.regexp_extract(clean, r"(\d+)\s*\+", 1).try_cast("long")
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high"))).when(open_.isNotNull(), F.struct(open_.alias("low"), F.lit(None).cast("long").alias("high")))


def range_transition(old: Column, new: Column) -> Column:
    """The two ranges as text if both are ranges and differ, else null."""
    a, b = value_range(old), value_range(new)
    text = lambda r: F.concat_ws("-", r["low"].cast("string"), r["high"].cast("string"))
    return F.when(a.isNotNull() & b.isNotNull() & ~a.eqNullSafe(b), F.concat(text(a), F.lit(" to "), text(b)))


def change_event(old: Column, new: Column, old_version: Column, new_version: Column, confidence: Column) -> Column:
    """``event, confidence``: null for a change of form alone; another extractor means another reading, with half the confidence."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s,.]+", "")
    revised = old_version.isNotNull() & new_version.isNotNull() & (old_version != new_version)
    made = F.when(revised, F.struct(F.lit("interpretation_revised").alias("event"), (confidence * 0.5).alias("confidence"))).otherwise(F.struct(F.lit("fact_changed").alias("event"), (confidence * 1.0).alias("confidence")))
    return F.when(~plain(old).eqNullSafe(plain(new)), made)


def adoption(rows: DataFrame, key: list[str], ts: str, status: str, as_of: Column, days: int) -> DataFrame:
    """``added, removed, net_change`` of a trailing window, for keys with any."""
    inside = rows.where((F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= as_of))
    found = inside.groupBy(*key).agg(F.count_if(F.col(status) == "accepted").alias("added"), F.count_if(F.col(status) == "superseded").alias("removed"))
    return found.where("added + removed > 0").withColumn("net_change", F.col("added") - F.col("removed"))


def backfill(changes_: DataFrame, known: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """The changes that aren't known yet, once each, and one row of counters (``processed, created, skipped``)."""
    new = changes_.dropDuplicates([fingerprint]).join(known.select(fingerprint).distinct(), fingerprint, "left_anti")
    counters = changes_.agg(F.count("*").alias("processed")).crossJoin(F.broadcast(new.agg(F.count("*").alias("created"))))  # one row each
    return new, counters.withColumn("skipped", F.col("processed") - F.col("created"))


def set_changes(old: Column, new: Column, prefix: str) -> Column:
    """Rows (event, value) of what a list of values gained and lost."""
    made = lambda values, what: F.transform(F.array_sort(values), lambda v: F.struct(F.lit(f"{prefix}_{what}").alias("event"), v.alias("value")))
    return F.concat(made(F.array_except(new, old), "added"), made(F.array_except(old, new), "removed"))


def significance(event: Column, predicate: Column, magnitude: Column, confidence: Column) -> Column:
    """The level of the predicate, else of the event, else medium; up a level beyond 50 percent, down one below half confidence."""
    levels = F.array(*[F.lit(x) for x in LEVELS])
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    base = F.coalesce(F.try_element_at(table(PREDICATE_LEVEL), predicate), F.try_element_at(table(EVENT_LEVEL), event), F.lit("medium"))
    up = F.least(F.array_position(levels, base) + F.when(F.abs(magnitude) > 50, 1).otherwise(0), F.lit(len(LEVELS)))
    place = F.greatest(up - F.when(confidence < 0.5, 1).otherwise(0), F.lit(1))
    return F.element_at(levels, place.cast("int"))


def intervals(rows: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """``valid_from, valid_to, is_current``: each row holds until the next one of its key."""
    w = Window.partitionBy(*key).orderBy(ts, tie)
    return rows.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(w)).withColumn("is_current", F.col("valid_to").isNull())


def state_as_of(rows: DataFrame, key: list[str], ts: str, tie: str, at: Column, values: list[str]) -> DataFrame:
    """The last values of each key at a time: one aggregation, no sort."""
    return rows.where(F.col(ts) <= at).groupBy(*key).agg(F.max_by(F.struct(*values, ts), F.struct(ts, tie)).alias("_s")).select(*key, *[F.col(f"_s.{c}").alias(c) for c in (*values, ts)])


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """For each left row the last right row of its key that isn't later: both sides sorted together once, no pairs."""
    names = left.columns
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*names).alias("_l"), F.lit(None).cast(right.select(F.struct(*values, right_ts).alias("x")).schema["x"].dataType).alias("_r"))
    b = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values, right_ts).alias("_r"))
    w = Window.partitionBy("_k").orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in values], F.col(f"_r.{right_ts}").alias(f"matched_{right_ts}"))


def growth(rows: DataFrame, key: list[str], ts: str, value: str, tie: str, as_of: Column, days: tuple[int, ...] = (90, 365)) -> DataFrame:
    """``window_days, baseline, latest, growth_pct, n_values, confidence`` of each trailing window.

    The baseline is the last value before the window, else the first one in it. All windows come from one aggregation.
    """
    known = rows.where(F.col(ts) <= as_of)
    aggs = []
    for d in days:
        start = as_of - F.expr(f"INTERVAL {d} DAYS")
        inside = F.col(ts) >= start
        order = F.struct(ts, tie)
        before, first = F.max_by(value, F.when(~inside, order)), F.min_by(value, F.when(inside, order))
        aggs.append(F.struct(F.lit(d).alias("window_days"), F.coalesce(before, first).alias("baseline"), F.max_by(value, F.when(inside, order)).alias("latest"), F.count_if(inside).alias("n_values")).alias(f"_{d}"))
    found = known.groupBy(*key).agg(*aggs).select(*key, F.explode(F.array(*[F.col(f"_{d}") for d in days])).alias("t")).select(*key, "t.*")
    pct = rnd((F.col("latest") - F.col("baseline")) / F.col("baseline") * 100.0, 2)
    return found.where("latest IS NOT NULL AND baseline <> 0").withColumn("growth_pct", pct).withColumn("confidence", rnd(F.least(F.lit(0.5) + 0.1 * F.col("n_values"), F.lit(0.99)), 2))


def activity(rows: DataFrame, key: list[str], ts: str, as_of: Column, days: tuple[int, ...] = (30, 90)) -> DataFrame:
    counts = [F.count_if((F.col(ts) >= as_of - F.expr(f"INTERVAL {d} DAYS")) & (F.col(ts) <= as_of)).alias(f"changes_{d}d") for d in days]
    return rows.groupBy(*key).agg(*counts, F.max(ts).alias("last_change_at"))


def timeline(events: DataFrame, fingerprint: str, drop_derived: bool = False, ts: str | None = None) -> DataFrame:
    """Events once each, without derived ones if asked, in the order of ``ts`` if there is one."""
    kept = events.dropDuplicates([fingerprint])
    kept = kept.where("NOT is_derived") if drop_derived else kept
    return kept.orderBy(ts, fingerprint) if ts else kept
