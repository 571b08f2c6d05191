"""Facts from observations: validation, confidence, and the state machine of each subject and predicate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.functions.numeric import lookup, rnd
from vantor.functions.text import EMAIL, fingerprint, phone

#: How far classes of sources are trusted.
AUTHORITY = {"official": 1.0, "registry": 0.95, "first_party": 0.9, "third_party": 0.7, "inferred": 0.5}


@dataclass(frozen=True)
class Predicate:
    name: str
    value_type: str
    many: bool = False
    conflict: bool = False


def confidence(authority: Column, extractor: Column, sources: Column) -> Column:
    base = lookup(authority, AUTHORITY, 0.6) * F.least(F.greatest(extractor, F.lit(0.1)), F.lit(1.0))
    return rnd(F.least(base + F.least((sources - 1) * 0.04, F.lit(0.12)), F.lit(0.99)), 2)


def integer(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(raw, ",", ""), r"\b(\d+)\b", 1), F.lit("")).try_cast("long")


def employee_range(raw: Column) -> Column:
    """min and max of "a-b", "a to b", "n+" or "n"."""
    x = F.regexp_replace(raw, ",", "")
    pair = r"(\d+)\s*(?:-|–|to)\s*(\d+)"
    num = lambda p, g: F.nullif(F.regexp_extract(x, p, g), F.lit("")).try_cast("long")
    low = F.coalesce(num(pair, 1), num(r"(\d+)", 1))
    high = F.when(num(pair, 2).isNotNull(), num(pair, 2)).when(~x.rlike(r"\d\s*\+"), low)
    return F.when(low.isNotNull(), F.struct(low.alias("min"), high.alias("max")))


def money(raw: Column) -> Column:
    """min, max and currency of an amount or range; a unit after the upper bound holds for both."""
    low = F.lower(raw)
    currency = F.when(low.rlike("₹|inr|rs"), "INR").when(low.rlike("€|eur"), "EUR").when(low.rlike("£|gbp"), "GBP").otherwise("USD")
    unit = F.when(low.rlike(r"\d\s*(cr|crore)"), 1e7).when(low.rlike(r"\d\s*(lakh|lac)"), 1e5).when(low.rlike(r"\d\s*(b|bn|billion)\b"), 1e9).when(low.rlike(r"\d\s*(m|mn|million)\b"), 1e6).when(low.rlike(r"\d\s*(k|thousand)\b"), 1e3).otherwise(1.0)
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(low, ",", ""), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda n: n.cast("double") * unit)
    return F.when(F.size(numbers) > 0, F.struct(F.get(numbers, F.lit(0)).alias("min"), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0))).alias("max"), currency.alias("currency")))


def rejected(value_type: Column, raw: Column) -> Column:
    """Why a raw value isn't one of its type, or null."""
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "empty_value")
        .when((value_type == "integer") & integer(raw).isNull(), "invalid_integer")
        .when((value_type == "decimal") & raw.try_cast("double").isNull(), "invalid_decimal")
        .when((value_type == "boolean") & raw.try_cast("boolean").isNull(), "invalid_boolean")
        .when((value_type == "email") & ~F.lower(raw).rlike(f"^{EMAIL}$".lower()), "invalid_email")
        .when((value_type == "phone") & phone(raw).isNull(), "invalid_phone")
        .when((value_type == "url") & ~raw.rlike(r"^(https?://)?[^\s/]+\.[^\s]+$"), "invalid_url")
        .when((value_type == "json") & F.try_parse_json(raw).isNull(), "invalid_json")
    )


def observation_hash(subject: Column, predicate: Column, value: Column, source: Column, at: Column) -> Column:
    """Equal for equal values of a source within an hour."""
    return fingerprint(subject, predicate, value, source, F.date_format(at, "yyyy-MM-dd'T'HH"))


def quote(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def values_equal(a: Column, b: Column) -> Column:
    """Whether two values (JSON objects or texts) mean the same: by ``value``, else by ``min`` and ``max``, else as a whole without case and outer space."""
    x, y = F.try_parse_json(a), F.try_parse_json(b)
    field = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    both = lambda f: field(x, f).isNotNull() & field(y, f).isNotNull()
    objects = a.startswith("{") & b.startswith("{") & x.isNotNull() & y.isNotNull()
    as_objects = (
        F.when(both("value"), field(x, "value") == field(y, "value"))
        .when(both("min") & both("max"), (field(x, "min") == field(y, "min")) & (field(x, "max") == field(y, "max")))
        .otherwise(F.to_json(x) == F.to_json(y))
    )
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(objects, as_objects).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def normal_value(value_type: Column, raw: Column) -> Column:
    """The value of an accepted observation as text: digits, a trimmed lower-cased address, a number; else the trimmed text."""
    text = F.trim(raw)
    return (
        F.when(rejected(value_type, raw).isNotNull(), None).when(value_type == "integer", integer(raw).cast("string")).when(value_type == "decimal", raw.try_cast("double").cast("string"))
        .when(value_type == "email", F.lower(text)).when(value_type == "phone", phone(raw)).otherwise(text)
    )


def health(facts: DataFrame, conflict: Column, n_observations: int, rejections: DataFrame) -> DataFrame:
    """One row: how many facts conflict, and how many observations were turned away."""
    n = rejections.agg(F.count("*").alias("total_rejections"))
    out = facts.agg(F.count("*").alias("total_facts"), F.count_if(conflict).alias("conflicts")).crossJoin(F.broadcast(n))  # one row each
    tried = F.lit(n_observations) + F.col("total_rejections")
    return out.select(
        "total_facts", "conflicts", "total_rejections", F.when(F.col("total_facts") > 0, rnd(F.col("conflicts") / F.col("total_facts"), 4)).otherwise(0.0).alias("conflicting_fact_rate"),
        F.when(tried > 0, rnd(F.col("total_rejections") / tried, 4)).otherwise(0.0).alias("quarantine_rejection_rate"),
    )


def subject_confidence(facts: DataFrame, subject: str, predicate: str, value: str, confidence_: str) -> DataFrame:
    """``subject, facts_count, overall_confidence, predicates``: the mean confidence and how many predicates are known."""
    return facts.groupBy(subject).agg(F.count("*").alias("facts_count"), rnd(F.avg(confidence_), 2).alias("overall_confidence"), F.countDistinct(predicate).alias("predicates"))


_NAMES = ["subject", "predicate", "value", "status", "confidence", "n_sources", "n_conflicts", "valid_from"]
_FOLDED = "subject string, predicate string, value string, status string, confidence double, n_sources int, n_conflicts int, valid_from timestamp"


def fold(observations: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """The current facts after all observations in order.

    ``observations`` has ``subject, predicate, value, source, authority, confidence, at, seq``. An equal value adds a source and
    0.04 of confidence; for predicates of many values it joins the others; else a trusted source of no less confidence takes
    over, and any other opens a conflict. Predicates of many values are one aggregation. The others depend on the order of
    their rows: one pass over rows sorted by subject and predicate, which holds one fact and gives rows batch by batch.
    """
    many = [p.name for p in predicates if p.many]
    strict = frozenset(p.name for p in predicates if p.conflict)
    rows = observations.select("subject", "predicate", "value", "source", "authority", "confidence", "at", "seq")
    joined = rows.where(F.col("predicate").isin(many)) if many else None
    ordered = rows.where(~F.col("predicate").isin(many)) if many else rows
    trusted = F.col("authority").isin("official", "registry", "first_party")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, sources, out = None, None, set(), []

        def give():
            out.append((*key, now[0], now[1], round(now[2], 2), len(sources), now[3], now[4]))

        for part in parts:
            columns = (part[c].tolist() for c in ("subject", "predicate", "value", "source", "trusted", "confidence", "at"))
            for subject, predicate, value, source, sure, confidence_, at in zip(*columns, strict=True):
                if (subject, predicate) != key:
                    if key:
                        give()
                    key, now, sources = (subject, predicate), [value, "active", confidence_, 0, at], {source}
                elif value == now[0]:
                    sources.add(source)
                    now[2] = min(0.99, now[2] + 0.04)
                    if len(sources) > 1:
                        now[1] = "multi_source"
                elif sure and predicate not in strict and confidence_ >= now[2]:
                    now, sources = [value, "active", confidence_, now[3], at], {source}
                else:
                    now[3] += 1
                    now[1] = "conflict"
            yield pd.DataFrame(out, columns=_NAMES)
            out.clear()
        if key:
            give()
            yield pd.DataFrame(out, columns=_NAMES)

    slim = ordered.select("subject", "predicate", "value", "source", trusted.alias("trusted"), "confidence", "at", "seq")
    found = slim.repartition(F.col("subject"), F.col("predicate")).sortWithinPartitions("subject", "predicate", "at", "seq").mapInPandas(run, _FOLDED)
    if joined is None:
        return found
    first = F.min_by(F.struct("confidence", "at"), F.struct("at", "seq"))
    each = joined.groupBy("subject", "predicate", "value").agg(first.alias("f"), F.count("*").alias("n"), F.countDistinct("source").cast("int").alias("n_sources"))
    # rounded as Python does: half to even on the shortest decimal
    sure = F.bround(F.least(F.lit(0.99), F.col("f.confidence") + 0.04 * (F.col("n") - 1)), 2)
    listed = each.select("subject", "predicate", "value", F.when(F.col("n_sources") > 1, "multi_source").otherwise("active").alias("status"), sure.alias("confidence"), "n_sources", F.lit(0).alias("n_conflicts"), F.col("f.at").alias("valid_from"))
    return found.unionByName(listed)
