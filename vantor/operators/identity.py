"""Canonical identity: companies behind observed names and hosts, match rules, aliases of fields, and keep-first duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.functions.text import sequence_ratio
from vantor.operators.resolution import by_rule

#: Where the value of a field may stand.
FIELD_ALIASES = {
    "industry": ("industry", "industries", "category"),
    "country": ("country_code", "country", "location"),
    "city": ("city", "location"),
    "employee_count": ("employee_count", "employees", "size", "employee_range"),
    "employee_range": ("employee_range", "employee_count", "size"),
    "technologies": ("technologies_used", "technologies", "tech_stack"),
    "products": ("products", "services"),
}


def field_value(name: str, columns: list[str], facts: Column | None = None) -> Column:
    """The first known of: the column of that name, its aliases, and the fact ``company.<name>`` of a map of facts."""
    name = name.strip().lower()
    places = [c for c in (name, *FIELD_ALIASES.get(name, ())) if c in columns]
    found = [F.col(c).cast("string") for c in dict.fromkeys(places)]
    if facts is not None:
        found += [F.try_element_at(facts, F.lit(f"company.{name}")), F.try_element_at(facts, F.lit(name))]
    return F.coalesce(*found, F.lit(None).cast("string"))


def resolve_companies(observed: DataFrame, companies: DataFrame, domains: DataFrame) -> DataFrame:
    """``obs_id, company_id, action``: the company behind each observation, found by host first and by name after that.

    ``observed`` has ``obs_id, name_key, domain``; ``companies`` has ``company_id, name_key, primary_domain``; ``domains`` has
    ``domain, company_id``. A known host decides (``linked``, or ``alias_added`` if the name differs). An unknown host joins the
    company of that name if it has none (``domain_attached``, the first host that is observed); if the company has another
    host, a new company is made and the pair is queued for review (``queued``). Without a host the name decides
    (``name_matched``). All else is ``created``. New companies are named by the first observation of their host or name.
    """
    known_names = companies.where("name_key <> ''").groupBy("name_key").agg(F.min_by(F.struct("company_id", "primary_domain"), "company_id").alias("named"))
    names = companies.select(F.col("company_id"), F.col("name_key").alias("linked_name"))
    linked = domains.groupBy("domain").agg(F.min("company_id").alias("company_id")).join(names, "company_id", "left").select("domain", F.struct("company_id", "linked_name").alias("linked"))
    rows = observed.select("obs_id", "name_key", F.nullif("domain", F.lit("")).alias("domain")).join(linked, "domain", "left").join(known_names, "name_key", "left")
    rows = rows.select("obs_id", "name_key", "domain", F.col("linked.company_id").alias("linked_id"), F.col("linked.linked_name").alias("linked_name"), F.col("named.company_id").alias("named_id"), F.col("named.primary_domain").alias("named_domain"))
    open_ = F.col("linked_id").isNull() & F.col("domain").isNotNull() & F.col("named_id").isNotNull() & F.col("named_domain").isNull()
    first = rows.where(open_).groupBy("named_id").agg(F.min_by("domain", "obs_id").alias("attached"))
    rows = rows.join(first, "named_id", "left")
    action = (
        F.when(F.col("linked_id").isNotNull(), F.when(F.col("linked_name") == F.col("name_key"), "linked").otherwise("alias_added"))
        .when(F.col("domain").isNotNull() & (F.col("attached") == F.col("domain")), "domain_attached")
        .when(F.col("domain").isNotNull() & F.col("named_id").isNotNull(), "queued")
        .when(F.col("domain").isNull() & F.col("named_id").isNotNull(), "name_matched")
        .otherwise("created")
    )
    rows = rows.withColumn("action", action)
    made = F.col("action").isin("queued", "created")
    key = F.when(F.col("domain").isNotNull(), F.concat(F.lit("d:"), "domain")).otherwise(F.concat(F.lit("n:"), "name_key"))
    fresh = F.concat(F.lit("new:"), F.min("obs_id").over(Window.partitionBy(F.when(made, key).otherwise(F.concat(F.lit("o:"), F.col("obs_id").cast("string"))))).cast("string"))
    return rows.withColumn("_fresh", fresh).select("obs_id", F.when(made, F.col("_fresh")).otherwise(F.coalesce("linked_id", "named_id").cast("string")).alias("company_id"), "action")


def company_links(rows: DataFrame, id_col: str, similar: float = 0.95) -> DataFrame:
    """Links ``a, b, signal, score`` by all company rules; each rule links the rows of a value to the smallest of them.

    Reads ``domain, emails, phones, profiles`` (arrays), ``name_key, city, raw_name``. Names alone count if their keys are equal
    and the names themselves nearly so; those are compared with the smallest row of the key.
    """
    many = lambda c: rows.select(id_col, F.explode_outer(c).alias("v"))
    links = by_rule(rows, id_col, F.col("domain"), "same_domain", 1.0)
    for column, signal, score in (("emails", "same_normalized_email", 0.95), ("phones", "same_normalized_phone", 0.95), ("profiles", "same_social_url", 0.90)):
        links = links.unionByName(by_rule(many(column), id_col, F.col("v"), signal, score))
    place = F.when((F.col("name_key") != "") & (F.col("city") != ""), F.concat_ws("|", "name_key", "city"))
    links = links.unionByName(by_rule(rows, id_col, place, "same_name_and_city", 0.75))
    of = lambda n: rows.select(F.col(id_col).alias(n), F.col("raw_name").alias(f"{n}_name"), F.col("city").alias(f"{n}_city"))
    pairs = by_rule(rows, id_col, F.col("name_key"), "high_name_similarity", 0.70).join(of("a"), "a").join(of("b"), "b")
    apart = F.coalesce(F.col("a_city") != F.col("b_city"), F.lit(True)) | (F.col("a_city") == "")
    near = pairs.where(apart).where(sequence_ratio("a_name", "b_name") >= similar)
    return links.unionByName(near.select("a", "b", "signal", "score"))


def person_links(rows: DataFrame, id_col: str, similar: float = 0.90) -> DataFrame:
    """Links of persons by e-mail, by profile, and by company with similar names; the latter are compared under equal first letters."""
    links = by_rule(rows, id_col, F.col("email"), "same_email", 1.0).unionByName(by_rule(rows, id_col, F.col("linkedin_url"), "same_linkedin_url", 0.98))
    key = F.when(F.col("company_id").isNotNull(), F.concat_ws("|", "company_id", F.substring("normalized_name", 1, 1)))
    of = lambda n: rows.select(F.col(id_col).alias(n), F.col("normalized_name").alias(f"{n}_name"))
    pairs = by_rule(rows, id_col, key, "same_company_and_name", 0.85).join(of("a"), "a").join(of("b"), "b")
    return links.unionByName(pairs.where(sequence_ratio("a_name", "b_name") >= similar).select("a", "b", "signal", "score"))


def keep_first(rows: DataFrame, order: str, keys: list[Column], rounds: int = 100) -> DataFrame:
    """Rows none of whose ``keys`` (null: none) a kept row before it has, in the order of ``order``.

    Whether a row stays depends on which rows before it stay, so rows are settled in rounds: a row that is the first open one of
    all its keys stays, and what shares a key with it goes. Rows far apart settle together, and most in the first round.
    """
    from vantor.sources.tables import Scratch

    each = rows.select(F.col(order).alias("r"), F.posexplode(F.array(*[k.cast("string") for k in keys])).alias("k", "v")).where("v IS NOT NULL AND v <> ''")
    scratch = Scratch(rows.sparkSession)
    each, plain = scratch.write(each, "keys"), rows.select(F.col(order).alias("r"))
    kept = plain.join(each.select("r").distinct(), "r", "left_anti")  # rows without any key stay
    for _ in range(rounds):
        least = each.groupBy("k", "v").agg(F.min("r").alias("first"))
        marked = each.join(least, ["k", "v"])
        stay = marked.groupBy("r").agg(F.bool_and(F.col("r") == F.col("first")).alias("ok")).where("ok").select("r")
        stay = scratch.write(stay, "kept")
        if not stay.limit(1).count():
            break
        kept = kept.unionByName(stay)
        taken = each.join(stay, "r", "left_semi").select("k", "v").distinct()
        gone = each.join(taken, ["k", "v"], "left_semi").select("r").distinct()
        each = scratch.write(each.join(gone, "r", "left_anti"), "keys")
    return rows.join(kept, F.col(order) == F.col("r"), "left_semi")
