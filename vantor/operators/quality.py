"""Quality gates, verification confidence and verdicts as struct-valued columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.functions.numeric import rnd
from vantor.functions.text import email_kind


def empty(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit("")) == ""


def missing(fields: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(empty(c), F.lit(n)) for n, c in fields.items()]))


def completeness(fields: list[Column]) -> Column:
    present = F.lit(0)
    for c in fields:
        present = present + F.when(empty(c), 0).otherwise(1)
    return rnd(present / F.lit(float(len(fields))), 3)


def quality_score(required: Column, complete: Column, verified: Column, evidence: Column, penalties: Column) -> Column:
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return rnd(clamp(F.when(required, 0.30).otherwise(0.0) + 0.30 * clamp(complete) + 0.25 * clamp(verified) + 0.15 * clamp(evidence) - penalties), 3)


def _decided(cases: list[tuple[Column, str, float, str]], status: str, score: float, reason: str) -> Column:
    made = lambda s, n, r: F.struct(F.lit(s).alias("status"), F.lit(n).alias("score"), F.lit(r).alias("reason"))
    out = made(status, score, reason)
    for condition, *rest in reversed(cases):
        out = F.when(condition, made(*rest)).otherwise(out)
    return out


def ingestion_gate(subject_type: Column, subject_id: Column, source: Column, conflict: Column) -> Column:
    return _decided(
        [
            (F.coalesce(conflict, F.lit(False)), "quarantine", 0.10, "HARD_CONFLICT"),
            (empty(subject_type) | empty(subject_id), "quarantine", 0.0, "MISSING_CANONICAL_IDENTITY"),
            (empty(source), "quarantine", 0.20, "OBSERVATION_SOURCE_MISSING"),
        ],
        "pass", 1.0, "CANONICAL_IDENTITY_VALID",
    )


def outreach_gate(email: Column, suppressed: Column, mail_status: Column, is_role: Column, catch_all: Column, employment: Column) -> Column:
    no = F.lit(False)
    return _decided(
        [
            (empty(email), "blocked", 0.0, "EMAIL_UNVERIFIED"),
            (F.coalesce(suppressed, no), "blocked", 0.0, "SUPPRESSED"),
            (F.lower(employment).isin("stale", "ended"), "reverify", 0.50, "STALE_EMPLOYMENT"),
            (F.coalesce(is_role, no), "limited", 0.60, "EMAIL_ROLE_ACCOUNT"),
            (F.coalesce(catch_all, no), "limited", 0.65, "EMAIL_CATCHALL"),
            (~F.coalesce(F.lower(mail_status), F.lit("unverified")).isin("verified", "valid"), "reverify", 0.45, "EMAIL_UNVERIFIED"),
        ],
        "pass", 0.95, "EMAIL_VERIFIED",
    )


def trust_gate(status: Column, evidence: Column, confidence: Column, least: float = 0.70) -> Column:
    """Whether a fact counts as known: conflicts, staleness, evidence and confidence, in that order."""
    score = F.coalesce(confidence, F.lit(0.5))
    decided = lambda s, n, r: F.struct(F.lit(s).alias("status"), n.alias("score"), F.lit(r).alias("reason"))
    return (
        F.when(F.coalesce(status == "conflicting", F.lit(False)), decided("blocked", F.lit(0.20), "UNRESOLVED_ENTITY_CONFLICT"))
        .when(F.coalesce(status == "stale", F.lit(False)), decided("reverify", F.lit(0.45), "DATA_STALE"))
        .when(F.coalesce(evidence, F.lit(0)) < 1, decided("limited", F.lit(0.40), "INSUFFICIENT_EVIDENCE"))
        .when((score < least) & (score >= 0.5), decided("limited", score, "LOW_FACT_CONFIDENCE"))
        .when(score < least, decided("blocked", score, "LOW_FACT_CONFIDENCE"))
        .otherwise(decided("pass", score, "FACT_CONFIDENCE_ACCEPTABLE"))
    )


def prospect_gate(duplicate: Column, required: list[Column], recommended: list[Column], verification: Column, confidence: Column, least: float = 0.75) -> Column:
    """Whether a prospect is complete and verified enough. Duplicates and missing fields block."""
    status, sure = F.coalesce(verification, F.lit("unverified")), F.coalesce(confidence, F.lit(1.0))
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | empty(c)
    score = quality_score(F.lit(True), completeness(recommended), F.when(status == "verified", sure).otherwise(0.4), F.lit(1.0), F.lit(0.0))
    decided = lambda s, n, r: F.struct(F.lit(s).alias("status"), n.alias("score"), F.lit(r).alias("reason"))
    return (
        F.when(F.coalesce(duplicate, F.lit(False)), decided("blocked", F.lit(0.0), "DUPLICATE_PROSPECT"))
        .when(lacking, decided("blocked", F.lit(0.20), "MISSING_PRIMARY_DOMAIN"))
        .when(status.isin("stale", "aging"), decided("reverify", score, "DOMAIN_STALE"))
        .when(status == "unverified", decided("limited", score, "DOMAIN_UNVERIFIED"))
        .when(score < least, decided("limited", score, "PROFILE_INCOMPLETE"))
        .otherwise(decided("pass", score, "DOMAIN_VERIFIED"))
    )


def personalization_gate(company: Column, lead: Column, offer: Column, hook: Column) -> Column:
    return _decided([(empty(company) | empty(lead) | empty(offer), "blocked", 0.20, "PROFILE_INCOMPLETE"), (empty(hook), "limited", 0.55, "INSUFFICIENT_EVIDENCE")], "pass", 0.85, "EVIDENCE_SUFFICIENT")


#: What is to be done about each reason, in order.
ACTIONS = (
    ("reverify_email", ("EMAIL_UNVERIFIED", "EMAIL_CATCHALL")),
    ("suppress", ("EMAIL_SUPPRESSED",)),
    ("deduplicate", ("DUPLICATE_PROSPECT",)),
    ("refresh_employment", ("STALE_EMPLOYMENT", "EMPLOYMENT_UNKNOWN")),
    ("verify_company", ("COMPANY_UNVERIFIED",)),
    ("verify_domain", ("DOMAIN_UNVERIFIED", "MISSING_PRIMARY_DOMAIN", "DOMAIN_UNREACHABLE")),
    ("reverify_domain", ("DOMAIN_STALE",)),
    ("resolve_identity", ("UNRESOLVED_ENTITY_CONFLICT", "HARD_IDENTITY_CONFLICT", "MISSING_CANONICAL_IDENTITY")),
    ("collect_more_evidence", ("INSUFFICIENT_EVIDENCE", "LOW_FACT_CONFIDENCE")),
    ("research_company", ("PROFILE_INCOMPLETE",)),
    ("reprocess_quarantine", ("MALFORMED_OBSERVATION", "QUARANTINE_RECORDED")),
)


def actions(reasons: Column) -> Column:
    """The repairs that an array of reasons asks for, once each."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(reasons, F.array(*[F.lit(r) for r in causes])), F.lit(a)) for a, causes in ACTIONS]))


#: Statuses from best to worst.
SEVERITY = ("pass", "limited", "reverify", "quarantine", "blocked")


def worst(*statuses: Column) -> Column:
    order = F.array(*[F.lit(s) for s in SEVERITY])
    return F.element_at(order, F.greatest(*[F.array_position(order, s) for s in statuses]).cast("int"))


def verification_confidence(source: Column, identity: Column, agreement: Column, technical: Column, fresh: Column, penalties: Column, weights: tuple[float, ...] = (0.25, 0.25, 0.20, 0.20, 0.10)) -> Column:
    total = F.lit(0.0)
    for w, c in zip(weights, (source, identity, agreement, technical, fresh), strict=True):
        total = total + c * w
    return rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - penalties)), 3)


def blend(scores: Column) -> Column:
    """Two fifths of the least and three fifths of the mean."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) > 0, rnd(F.array_min(scores) * 0.4 + mean * 0.6, 3)).otherwise(0.0)


def verification_gate(company: Column, person: Column, employment: Column, email: Column, role_mail: Column, catch_all: Column) -> Column:
    """BLOCK before REVERIFY before ALLOW_WITH_RISK before ALLOW."""
    bad = lambda c: c.isin("invalid", "failed")
    yes = lambda c: F.coalesce(c, F.lit(False))
    block = yes(bad(email)) | yes(email == "suppressed") | yes(bad(company)) | yes(company == "unreachable") | yes(employment == "conflicting") | yes(bad(person))
    again = yes(employment.isin("stale", "unverified", "uncertain"))
    risk = yes(role_mail) | yes(catch_all) | yes(company == "uncertain") | yes(person == "uncertain")
    return F.when(block, "BLOCK").when(again, "REVERIFY").when(risk, "ALLOW_WITH_RISK").otherwise("ALLOW")


def email_status(email: Column, mx: Column, catch_all: Column) -> Column:
    kind = email_kind(email)
    return F.when(kind.isin("missing", "invalid"), "invalid").when(~F.coalesce(mx, F.lit(False)), "failed").when(F.coalesce(catch_all, F.lit(False)) | (kind == "role"), "uncertain").otherwise("verified")


def domain_status(dns: Column, http: Column, parked: Column) -> Column:
    no = F.lit(False)
    return F.when(~F.coalesce(dns, no), "invalid").when(F.coalesce(parked, no), "parked").when(~F.coalesce(http, no), "unreachable").otherwise("active")


def employment_status(same_domain: Column, on_page: Column, age: Column) -> Column:
    return F.when(~F.coalesce(same_domain, F.lit(False)) & ~F.coalesce(on_page, F.lit(False)), "mismatch").when(age > 365, "stale").when(F.coalesce(on_page, F.lit(False)), "current").otherwise("uncertain")
