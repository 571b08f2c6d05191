"""Ideal customer profiles: criteria compiled into one expression, exclusions, personas, and differences of versions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.functions.numeric import rnd


@dataclass(frozen=True)
class Criterion:
    field: str
    operator: str
    value: object = None
    weight: float = 1.0
    requirement: str = "optional"


#: How a matched criterion's weight counts.
FACTORS = {"boost": 1.5, "required": 1.2, "penalty": -1.0}


def test(column: Column, operator: str, value: object) -> Column:
    """Whether a criterion holds; null where the value is unknown."""
    norm = lambda c: F.lower(F.trim(c.cast("string")))
    number = lambda: column.cast("double")
    values = [str(v).strip().lower() for v in (value if isinstance(value, (list, tuple)) else [value])]
    match operator:
        case "exists":
            return F.coalesce(norm(column), F.lit("")) != ""
        case "not_exists":
            return F.coalesce(norm(column), F.lit("")) == ""
        case "equals":
            return norm(column) == values[0]
        case "in":
            return norm(column).isin(*values)
        case "not_in":
            return ~norm(column).isin(*values)
        case "contains":
            return norm(column).contains(values[0])
        case "gt":
            return number() > float(value)
        case "gte":
            return number() >= float(value)
        case "lt":
            return number() < float(value)
        case "lte":
            return number() <= float(value)
        case "range":
            return number().between(float(value[0]), float(value[1]))
        case "changed_within":
            return F.lit(False)
    raise ValueError(f"no such operator: {operator}")


def score(rows: DataFrame, criteria: list[Criterion], excluded: Column | None = None) -> DataFrame:
    """``fit_score, data_confidence, fit_status``: one projection, whatever the number of criteria.

    Unknown values count in the denominator alone and lower the confidence; a required criterion that fails holds the fit at 0.25.
    """
    held = [test(F.col(c.field), c.operator, c.value) for c in criteria]
    total = sum(c.weight for c in criteria)
    earned = reduce(lambda a, b: a + b, [F.when(h, c.weight * FACTORS.get(c.requirement, 1.0)).otherwise(0.0) for h, c in zip(held, criteria, strict=True)], F.lit(0.0))
    unknown = reduce(lambda a, b: a + b, [F.when(h.isNull(), 1).otherwise(0) for h in held], F.lit(0))
    failed = reduce(lambda a, b: a | b, [F.coalesce(~h, F.lit(False)) for h, c in zip(held, criteria, strict=True) if c.requirement == "required"], F.lit(False))
    fit = F.greatest(F.lit(0.0), earned / F.lit(total)) if total else F.lit(0.5)
    fit = F.least(F.lit(1.0), rnd(F.when(failed, F.least(fit, F.lit(0.25))).otherwise(fit), 3))
    sure = rnd(F.greatest(F.lit(0.1), 1.0 - unknown / float(max(1, len(criteria))) * 0.45), 3)
    out_of = excluded if excluded is not None else F.lit(False)
    out = rows.withColumn("fit_score", F.when(out_of, 0.0).otherwise(fit)).withColumn("data_confidence", F.when(out_of, 1.0).otherwise(sure))
    f, c = F.col("fit_score"), F.col("data_confidence")
    return out.withColumn("fit_status", F.when(out_of, "excluded").when(c < 0.30, "insufficient_data").when(f >= 0.85, "excellent_fit").when(f >= 0.70, "strong_fit").when(f >= 0.50, "possible_fit").otherwise("weak_fit"))


def exclude(rows: DataFrame, key: str, lists: dict[str, DataFrame], rules: list[tuple[str, Criterion]]) -> DataFrame:
    """``exclusion``: the first list that has the row's key, else the first rule that holds, else null."""
    out, reasons = rows, []
    for name, listed in lists.items():
        out = out.join(listed.select(F.col(key).alias(f"_{name}")).distinct(), F.col(key) == F.col(f"_{name}"), "left")
        reasons.append(F.when(F.col(f"_{name}").isNotNull(), F.lit(name)))
    reasons += [F.when(test(F.col(c.field), c.operator, c.value), F.lit(name)) for name, c in rules]
    return out.withColumn("exclusion", F.coalesce(*reasons, F.lit(None).cast("string"))).select(*rows.columns, "exclusion")


def diff_versions(a: DataFrame, b: DataFrame) -> DataFrame:
    """``key, change``: criteria of ``b`` that are added, removed or weighed otherwise than in ``a``."""
    key = F.concat_ws(":", "category", "field", "operator")
    one = a.select(key.alias("key"), F.col("weight").alias("weight_a"))
    two = b.select(key.alias("key"), F.col("weight").alias("weight_b"))
    change = F.when(F.col("weight_a").isNull(), "added").when(F.col("weight_b").isNull(), "removed").when(F.col("weight_a") != F.col("weight_b"), "weight_changed")
    return one.join(two, "key", "full_outer").withColumn("change", change).where("change IS NOT NULL")


def match_persona(people: DataFrame, title: Column, personas: list[tuple[str, str, int]]) -> DataFrame:
    """``persona, persona_score``: the best of (name, title, priority); from 0.50 on it counts."""
    low = F.lower(title)
    words = F.split(low, r"\W+")
    found = []
    for name, wanted, priority in personas:
        parts = [F.lit(w) for w in wanted.lower().split()]
        base = F.when(low.contains(wanted.lower()), 0.85).when(F.size(F.array_intersect(words, F.array(*parts))) >= 2, 0.65).otherwise(0.0)
        base = base + F.when(low.rlike(r"\b(chief|vp|head|director|founder)\b"), 0.15).otherwise(0.0)
        found.append(F.struct(F.least(F.lit(1.0), rnd(base * (1.1 if priority == 1 else 1.0), 3)).alias("s"), F.lit(name).alias("n")))
    best = F.array_max(F.array(*found))
    return people.withColumn("persona", F.when(best["s"] >= 0.50, best["n"])).withColumn("persona_score", F.when(best["s"] >= 0.50, best["s"]).otherwise(0.0))


def needs_refresh(active: DataFrame, key: str, as_of: Column, created: str, industry: tuple[str, str], products: tuple[str, str], facts: tuple[str, str], days: int = 90) -> DataFrame:
    """``needs_refresh, reasons`` of each profile: its age, and how the seller differs from the snapshot it was made from.

    ``industry``, ``products`` (arrays) and ``facts`` (counts) name the snapshot's column and the present one; what is unknown on
    either side doesn't count.
    """
    age = F.datediff(as_of.cast("timestamp"), F.col(created).cast("timestamp"))
    old, new = (F.col(c) for c in products)
    both = (F.size(F.coalesce(old, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(new, F.array().cast("array<string>"))) > 0)
    reasons = F.array_compact(F.array(
        F.when(F.col(created).isNull(), "no_active_version").when(age > days, "too_old"), F.when(F.col(industry[0]) != F.col(industry[1]), "industry_changed"),
        F.when(both & (F.size(F.array_except(new, old)) > 0), "products_added"), F.when(both & (F.size(F.array_except(old, new)) > 0), "products_removed"),
        F.when(F.col(facts[0]) != F.col(facts[1]), "facts_changed"),
    ))
    return active.select(key, (F.size(reasons) > 0).alias("needs_refresh"), reasons.alias("reasons"))
