"""Prospect ranking: component scores, weighted profiles, queues and comparisons; each is a projection or one window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.functions.numeric import lookup, rnd, saturation, step_decay, unit_score
from vantor.functions.text import email_kind

#: Weights of signals, and of the seniority that a title shows.
SIGNAL_WEIGHTS = {"location_expansion": 0.90, "hiring_growth": 0.85, "leadership_change": 0.80, "funding_raised": 0.85, "tech_adoption": 0.75, "product_launch": 0.70, "partnership": 0.65}
SENIORITY = ((("chief", "cto", "ceo", "cro", "cmo", "cfo", "founder", "president"), 1.0), (("vp", "vice president"), 0.95), (("director", "head"), 0.85), (("manager", "lead", "supervisor"), 0.65))


@dataclass(frozen=True)
class Profile:
    """Weights of the components, thresholds of the statuses, and penalties."""

    name: str
    account: float
    person: float
    signal: float
    timing: float
    contact: float
    priority: float = 0.80
    strong: float = 0.65
    research_below: float = 0.45
    role_penalty: float = 0.20
    missing_penalty: float = 0.15


PROFILES = (
    Profile("default_v1", 0.35, 0.25, 0.15, 0.15, 0.10),
    Profile("high_intent_v1", 0.25, 0.20, 0.30, 0.20, 0.05, 0.78),
    Profile("account_first_v1", 0.50, 0.20, 0.15, 0.10, 0.05, 0.82, 0.68),
    Profile("person_first_v1", 0.25, 0.45, 0.10, 0.10, 0.10),
)


def account_score(fit: Column, verified: Column, quality: Column, growth: Column, changes: Column) -> Column:
    momentum = F.when(growth >= 20, 1.0).when(changes >= 3, 0.8).otherwise(0.5)
    parts = [rnd(unit_score(fit) * 0.55, 3), rnd(unit_score(verified) * 0.20, 3), rnd(unit_score(quality) * 0.15, 3), rnd(momentum * 0.10, 3)]
    return unit_score(parts[0] + parts[1] + parts[2] + parts[3])


def seniority(title: Column, whole_words: bool = False) -> Column:
    """By the first group of words that the title contains; ``whole_words`` keeps "director" from counting as a "cto"."""
    low, out = F.lower(title), F.lit(0.40)
    for words, score in reversed(SENIORITY):
        pattern = "|".join(words)
        out = F.when(low.rlike(rf"\b({pattern})\b" if whole_words else pattern), F.lit(score)).otherwise(out)
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(0.5)).otherwise(out)


def role(title: Column) -> Column:
    low = F.lower(title)
    return F.when(low.rlike("tech|engineer|dev|cto|architect"), "technical_buyer").when(low.rlike("sales|cro|revenue|commercial"), "economic_buyer").when(low.rlike("ops|operations|coo"), "operational_buyer").otherwise("champion")


def person_score(fit: Column, title: Column, relevance: Column, employment: Column) -> Column:
    return unit_score(rnd(unit_score(fit) * 0.45, 3) + rnd(seniority(title) * 0.30, 3) + rnd(relevance * 0.15, 3) + rnd(unit_score(employment) * 0.10, 3))


def signal_points(kind: Column, confidence: Column) -> Column:
    return rnd(lookup(kind, SIGNAL_WEIGHTS, 0.5) * confidence, 3)


def signal_score(points: Column, conflicting: Column) -> Column:
    """Diminishing returns of the summed points; expansion together with contraction costs a quarter twice."""
    cut = F.when(conflicting, F.greatest(F.lit(0.0), points - 0.25)).otherwise(points)
    score = saturation(cut)
    return F.when(points.isNull(), 0.0).otherwise(unit_score(F.when(conflicting, F.greatest(F.lit(0.0), score - 0.25)).otherwise(score)))


def timing_score(best: Column, recent: Column, n: Column) -> Column:
    """The best recency of the signals and 0.10 for each further recent one, 0.20 at most; 0.25 without signals."""
    boost = F.when(n > 1, F.least(F.lit(0.20), (recent - 1) * 0.10)).otherwise(0.0)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.25).otherwise(unit_score(F.least(F.lit(1.0), best + boost)))


def recency(age: Column) -> Column:
    return step_decay(age)


def contactability(email: Column, suppressed: Column, catch_all: Column) -> Column:
    kind = email_kind(email)
    score = F.lit(1.0) - F.when(kind == "role", 0.35).otherwise(0.0) - F.when(kind == "free", 0.30).otherwise(0.0) - F.when(catch_all, 0.15).otherwise(0.0)
    return F.when(suppressed, 0.0).when(kind == "missing", 0.20).when(kind == "invalid", 0.0).otherwise(unit_score(F.greatest(F.lit(0.1), score)))


def freshness_score(company_age: Column, employment_age: Column) -> Column:
    return unit_score(F.greatest(F.lit(0.2), 1.0 - F.greatest(company_age, employment_age) / 365.0))


def composite(rows: DataFrame, profile: Profile) -> DataFrame:
    """``raw_score, confidence_factor, final_score, status`` from the component columns of ``rows``.

    Reads ``account_score, person_score, signal_score, timing_score, contact_score, fit, verified, quality, fresh, company_age,
    employment_age, mail_kind, blocked``.
    """
    stale_company, stale_employment = F.col("company_age") > 270, F.col("employment_age") > 180
    penalty = F.when(stale_company, 0.15).otherwise(0.0) + F.when(stale_employment, 0.25).otherwise(0.0)
    penalty = penalty + F.when(F.col("mail_kind") == "role", profile.role_penalty).when(F.col("mail_kind") == "missing", profile.missing_penalty).otherwise(0.0)
    total = F.col("account_score") * profile.account + F.col("person_score") * profile.person + F.col("signal_score") * profile.signal + F.col("timing_score") * profile.timing + F.col("contact_score") * profile.contact
    raw = F.when(F.col("blocked"), 0.0).otherwise(unit_score(F.greatest(F.lit(0.0), total - penalty)))
    factor = F.when(F.col("blocked"), 0.0).otherwise(unit_score(F.greatest(F.lit(0.20), 0.45 * F.col("verified") + 0.35 * F.col("quality") + 0.20 * F.col("fresh"))))
    out = rows.withColumn("raw_score", raw).withColumn("confidence_factor", factor)
    out = out.withColumn("final_score", unit_score(F.col("raw_score") * F.col("confidence_factor")))
    status = (
        F.when(F.col("blocked"), "not_eligible")
        .when(((F.col("fit") >= 0.70) | (F.col("final_score") >= 0.65)) & (stale_company | stale_employment), "reverify")
        .when((F.col("quality") < profile.research_below) | ((F.col("raw_score") >= 0.60) & (F.col("confidence_factor") < 0.50)), "research_more")
        .when(F.col("final_score") >= profile.priority, "priority")
        .when(F.col("final_score") >= profile.strong, "strong")
        .otherwise("possible")
    )
    return out.withColumn("status", status).withColumn("profile", F.lit(profile.name))


def queue(scored: DataFrame, id_col: str, k: int, least: float = 0.0) -> DataFrame:
    """The first ``k`` rows by final and raw score with their positions: a top-k, not a sort of all rows."""
    top = scored.where(F.col("final_score") >= least).orderBy(F.desc("final_score"), F.desc("raw_score"), id_col).limit(k)
    return top.withColumn("rank_position", F.row_number().over(Window.orderBy(F.desc("final_score"), F.desc("raw_score"), id_col)))


def best_per_account(scored: DataFrame, account: str, id_col: str, most: int = 3) -> DataFrame:
    w = Window.partitionBy(account).orderBy(F.desc("final_score"), F.desc("raw_score"), id_col)
    return scored.withColumn("account_rank", F.row_number().over(w)).where(F.col("account_rank") <= most)


def compare(rows: DataFrame, a: Profile, b: Profile, id_col: str) -> DataFrame:
    """The change of score and status from one profile to another; both come from one scan of the components."""
    one = composite(rows, a).withColumnsRenamed({"final_score": "score_a", "status": "status_a"}).drop("raw_score", "confidence_factor", "profile")
    both = composite(one, b).withColumnsRenamed({"final_score": "score_b", "status": "status_b"})
    return both.select(id_col, "score_a", "score_b", rnd(F.col("score_b") - F.col("score_a"), 4).alias("score_delta"), "status_a", "status_b", (F.col("status_a") != F.col("status_b")).alias("status_changed"))


def lead_score(industry_matches: Column, industry: Column, city_matches: Column, phones: Column, mails: Column, tier: Column, facts: list[Column], presence: list[Column]) -> Column:
    """Points for fit, contacts, decision makers, data and presence, 100 at most."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    total = F.when(industry_matches, 20).when(F.coalesce(industry, F.lit("")) != "", 10).otherwise(0) + one(city_matches, 10) + one(phones, 15) + one(mails, 10)
    total = total + F.when(tier == "Tier 1", 20).when(tier == "Tier 2", 15).when(tier.isNotNull(), 10).otherwise(0)
    for c in (*facts, *presence):
        total = total + one(c, 5)
    return F.least(total, F.lit(100))


def lead_priority(score: Column) -> Column:
    return F.when(score >= 75, "High").when(score >= 50, "Medium").otherwise("Low")


def axes(web: Column, mails: Column, phones: Column, place: Column, description: Column, industry: Column, city: Column, target_industry: str | None, target_city: str | None, signals: dict[str, Column]) -> dict[str, Column]:
    """Data confidence, profile fit and buying signals from 0 to 100, and the priority that they give."""
    one = lambda c, n: F.when(F.coalesce(c, F.lit(False)), float(n)).otherwise(0.0)
    sure = one(web, 25) + one(mails, 25) + one(phones, 20) + one(place, 15) + one(description, 15)
    ind, town = F.lower(F.coalesce(industry, F.lit(""))), F.lower(F.coalesce(city, F.lit("")))
    if target_industry:
        t = F.lit(target_industry.lower())
        fit = F.when(ind.contains(t) | t.contains(ind), 50.0).when(ind != "", 20.0).otherwise(0.0)
    else:
        fit = F.when(ind != "", 30.0).otherwise(0.0)
    fit = fit + (F.when(town.contains(target_city.lower()), 50.0).otherwise(0.0) if target_city else F.when(town != "", 20.0).otherwise(0.0))
    worth = {"funding_raised": 40.0, "hiring_growth": 35.0, "tech_stack_active": 25.0}
    buying = F.least(F.lit(100.0), sum((F.coalesce(signals[k], F.lit(0)) * w for k, w in worth.items() if k in signals), F.lit(0.0)))
    total = sure * 0.25 + fit * 0.45 + buying * 0.30
    priority = F.when((total >= 75.0) | ((fit >= 80.0) & (sure >= 60.0)), "High").when(total >= 50.0, "Medium").otherwise("Low")
    return {"data_confidence": sure, "icp_fit": fit, "buying_signal": buying, "priority": priority}


def lifecycle(status: Column, current: Column, batch: bool = False) -> Column:
    """The status of a prospect after its ranking; outside batches, what is to be verified again counts as qualified."""
    again = "ranked" if batch else "qualified"
    return (
        F.when(status == "not_eligible", "rejected").when(status == "research_more", "researching").when(status == "reverify", again)
        .when(status.isin("priority", "strong"), "qualified").when(status == "possible", "ranked").otherwise(current)
    )


#: Parts of reason codes that speak against a prospect.
AGAINST = ("BLOCK", "PENALTY", "EXCLUSION", "SUPPRESS", "INVALID", "STALE", "CONFLICT", "MISSING")


def reason_rows(scored: DataFrame, id_col: str, reasons: str, status: str) -> DataFrame:
    """One row for each reason of a score: ``reason_code, component, contribution, direction``."""
    each = scored.select(id_col, status, F.explode(reasons).alias("reason_code"))
    bad = F.col("reason_code").rlike("|".join(AGAINST))
    worth = F.when(bad & (F.col(status) == "not_eligible"), -1.0).when(bad, -0.05).otherwise(0.10)
    return each.select(id_col, "reason_code", F.when(bad, "penalty").otherwise("fit").alias("component"), worth.alias("contribution"), F.when(bad, "negative").otherwise("positive").alias("direction"))


def explanations(scored: DataFrame, id_col: str) -> DataFrame:
    """One row for each component of a score."""
    parts = ("account_score", "person_score", "signal_score", "timing_score", "contact_score")
    return scored.select(id_col, F.inline(F.array(*[F.struct(F.lit(p).alias("component"), F.col(p).alias("contribution")) for p in parts])))
