"""Verification: weights, status cascades of each kind of subject, and the metrics over their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.functions.numeric import rnd
from vantor.functions.text import email_kind

#: The weights of source, identity, agreement, technique and freshness for each kind of subject.
WEIGHTS = {
    "company": (0.20, 0.25, 0.20, 0.25, 0.10),
    "domain": (0.10, 0.10, 0.10, 0.60, 0.10),
    "company_domain": (0.20, 0.35, 0.20, 0.15, 0.10),
    "person": (0.25, 0.30, 0.25, 0.10, 0.10),
    "employment": (0.20, 0.25, 0.25, 0.15, 0.15),
    "email": (0.10, 0.15, 0.10, 0.55, 0.10),
    "fact": (0.30, 0.15, 0.30, 0.10, 0.15),
}


def confidence(subject: str, source, identity, agreement, technical, fresh, conflict=0.0, staleness=0.0) -> Column:
    """The weighted sum less its penalties, from 0 to 1."""
    total = F.lit(0.0)
    for w, c in zip(WEIGHTS[subject], (source, identity, agreement, technical, fresh), strict=True):
        total = total + (c if isinstance(c, Column) else F.lit(float(c))) * F.lit(w)
    less = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    return rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - less(conflict) - less(staleness))), 3)


def _result(cases: list[tuple[Column, str]], default: str, score: Column) -> Column:
    status = F.lit(default)
    for condition, label in reversed(cases):
        status = F.when(condition, label).otherwise(status)
    return F.struct(status.alias("status"), score.alias("confidence"))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def company(name: Column, domain: Column, reachable: Column, contacts: Column, description: Column) -> Column:
    """verified, supported, uncertain, unverified or invalid, and the confidence (0 without a name)."""
    named = F.coalesce(F.trim(name), F.lit("")) != ""
    has_domain = F.coalesce(domain, F.lit("")) != ""
    up = _yes(reachable)
    score = confidence("company", F.when(has_domain, 0.90).otherwise(0.50), F.when(has_domain, 0.95).otherwise(0.60), 0.85, F.when(up, 0.95).otherwise(0.30), 1.0)
    score = F.when(named, score).otherwise(0.0)
    return _result([(~named, "invalid"), (up & (score >= 0.80), "verified"), (up | (_yes(contacts) & _yes(description)), "supported"), (has_domain, "uncertain")], "unverified", score)


def domain(dns: Column, http: Column, https: Column, parked: Column, off_host: Column, body: Column) -> Column:
    live = _yes(http) | _yes(https)
    technical = F.when(_yes(https) | _yes(http), 1.0).when(_yes(dns), 0.5).otherwise(0.0)
    score = confidence("domain", 0.90, 0.90, 0.90, technical, 1.0, F.when(_yes(parked), 0.5).otherwise(0.0))
    return _result([(~_yes(dns), "unreachable"), (_yes(parked), "uncertain"), (_yes(off_host), "supported"), (_yes(https) & (F.coalesce(body, F.lit(0)) > 100), "verified"), (live | _yes(dns), "supported")], "unverified", score)


def company_domain(in_label: Column, in_title: Column, by_mail: Column) -> Column:
    """By points for the name in the host, the name in the title and mail of the host."""
    points = F.when(_yes(in_label), 0.40).otherwise(0.0) + F.when(_yes(in_title), 0.35).otherwise(0.0) + F.when(_yes(by_mail), 0.25).otherwise(0.0)
    score = confidence("company_domain", 0.85, F.least(points + 0.2, F.lit(1.0)), 0.85, 0.90, 1.0, F.when(points == 0, 0.4).otherwise(0.0))
    return _result([(points >= 0.70, "verified"), (points >= 0.40, "supported"), (points > 0, "uncertain")], "conflicting", score)


def person(name: Column, profile: Column, email: Column) -> Column:
    full = F.size(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+")) >= 2
    has_profile, has_mail = F.coalesce(profile, F.lit("")) != "", F.coalesce(email, F.lit("")) != ""
    identity = F.lit(0.5) + F.when(has_profile, 0.25).otherwise(0.0) + F.when(has_mail, 0.20).otherwise(0.0) + F.when(full, 0.05).otherwise(0.0)
    score = confidence("person", 0.85, identity, 0.85, F.when(has_mail, 0.90).otherwise(0.50), 1.0)
    return _result([(~full, "invalid"), (has_profile & has_mail & (score >= 0.75), "verified"), (has_profile | has_mail, "supported")], "uncertain", score)


def employment(same_domain: Column, on_team: Column, email: Column, age: Column) -> Column:
    """An unknown age counts as 30 days."""
    days = F.coalesce(age, F.lit(30))
    known = _yes(same_domain) | _yes(on_team)
    has_mail = F.coalesce(email, F.lit("")) != ""
    fresh = F.when(days > 365, 0.2).when(days > 180, 0.6).otherwise(1.0)
    late = F.when(days > 365, 0.4).when(days > 180, 0.15).otherwise(0.0)
    score = confidence("employment", 0.85, F.when(known, 0.90).otherwise(0.50), 0.85, F.when(known, 1.0).otherwise(0.4), fresh, 0.0, late)
    return _result([(days > 365, "stale"), (known & (days <= 180), "verified"), (known, "supported"), (has_mail, "uncertain")], "unverified", score)


def email(address: Column, mx: Column, answer: Column) -> Column:
    """By syntax, mail host and the answer of the mail server (250, ``user_not_found`` or none)."""
    kind = email_kind(address)
    role, free = kind == "role", kind == "free"
    technical = F.when(answer == "250", F.when(role, 0.85).otherwise(0.98)).when(answer == "user_not_found", 0.10).otherwise(0.82)
    score = confidence("email", 0.90, F.when(role, 0.60).otherwise(0.85), 0.90, technical, 1.0, F.when(role, 0.15).when(free, 0.10).otherwise(0.0))
    score = F.when(kind.isin("missing", "invalid"), 0.0).when(~_yes(mx), 0.05).otherwise(score)
    return _result([(kind.isin("missing", "invalid"), "invalid"), (~_yes(mx), "unreachable"), (_yes(answer == "user_not_found"), "invalid"), (_yes(answer == "250") & ~role, "verified")], "supported", score)


def fact(raw: Column, conflicting: Column, age: Column, evidence: Column) -> Column:
    old = F.coalesce(age, F.lit(0)) > 180
    some = F.coalesce(evidence, F.lit(0)) > 0
    score = confidence("fact", raw, 0.90, F.when(some, 0.90).otherwise(0.50), 0.80, F.when(old, 0.30).otherwise(1.0), 0.0, F.when(old, 0.20).otherwise(0.0))
    score = F.when(_yes(conflicting), 0.30).otherwise(score)
    return _result([(_yes(conflicting), "conflicting"), (old, "stale"), ((score >= 0.75) & some, "verified"), (score >= 0.60, "supported")], "uncertain", score)


def bundle_confidence(*scores: Column) -> Column:
    """The mean of those that are there; 0 without any."""
    known = F.array_compact(F.array(*scores))
    return F.when(F.size(known) > 0, rnd(F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known), 3)).otherwise(0.0)


def metrics(results: DataFrame, subject: str = "subject", status: str = "status") -> DataFrame:
    """Counts and rates over all results and by subject (null: all), in one grouping-sets aggregation."""
    s = F.col(status)
    each = {"verified": s == "verified", "supported": s == "supported", "uncertain": s == "uncertain", "stale": s == "stale", "invalid": s.isin("invalid", "failed"), "conflicting": s == "conflicting"}
    out = results.rollup(subject).agg(F.count("*").alias("runs"), *[F.count_if(c).alias(n) for n, c in each.items()])
    return out.select("*", *[rnd(F.col(n) / F.col("runs"), 3).alias(f"{n}_rate") for n in ("verified", "stale", "invalid")])


def reusable(status: Column, confidence_: Column, state: Column, least: float = 0.80) -> Column:
    """Whether an earlier result stands: it is fresh, or verified with enough confidence."""
    return _yes(state == "fresh") | (_yes(status == "verified") & _yes(confidence_ >= least))
