"""Numeric and temporal column functions. Rounding is half up on the binary value, alike in every engine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, places: int) -> Column:
    unit = float(10**places)
    return F.floor(x * F.lit(unit) + F.lit(0.5)) / F.lit(unit)


def unit_score(x: Column) -> Column:
    """Clamped to [0, 1] and rounded to three places."""
    return rnd(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))), 3)


def age_days(ts: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / F.lit(86400.0)


def step_decay(age: Column, steps: Sequence[tuple[int, float]] = ((30, 1.0), (90, 0.70), (180, 0.35))) -> Column:
    """The factor of the first step that reaches the age; beyond all, 0."""
    out = F.lit(0.0)
    for days, factor in reversed(steps):
        out = F.when(age <= days, F.lit(factor)).otherwise(out)
    return out


def linear_decay(age: Column, lifetime: Column) -> Column:
    return rnd(F.greatest(F.lit(0.0), F.lit(1.0) - age / lifetime), 3)


def saturation(points: Column, rate: float = 1.5) -> Column:
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + points * F.lit(rate))


def authority(links: Column) -> Column:
    return rnd(F.log2(F.lit(1.0) + links) * 1.5, 2)


def freshness(age: Column, ttl: Column) -> Column:
    """fresh up to half of the time to live, aging up to all of it, stale up to one and a half times it, else expired; null: expired."""
    ratio = age / ttl
    return F.when(ratio <= 0.5, "fresh").when(ratio <= 1.0, "aging").when(ratio <= 1.5, "stale").otherwise("expired")


def lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def cost(model: Column, prompt: Column, completion: Column, rates: Mapping[str, tuple[float, float]], default: tuple[float, float] = (0.20, 0.80)) -> Column:
    """Price of a call at rates for a million prompt and completion tokens."""
    a = lookup(model, {k: v[0] for k, v in rates.items()}, default[0])
    b = lookup(model, {k: v[1] for k, v in rates.items()}, default[1])
    return prompt / F.lit(1e6) * a + completion / F.lit(1e6) * b


def freshness_ratio(age: Column, ttl: Column) -> Column:
    """What is left of the time to live, from 1 to 0; ages below zero are 1."""
    return rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - age / ttl)), 2)


def valid_until(at: Column, hours: Column) -> Column:
    return at + F.make_dt_interval(hours=hours.cast("int"))


def estimated_tokens(text: Column) -> Column:
    """One token for each four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))
