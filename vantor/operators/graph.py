"""Relationships of companies: overlap of pairs, strength, kinds, and bounded expansion of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.functions.numeric import rnd
from vantor.sources.tables import Scratch


#: Pairs a row of the input that are counted directly.
DIRECT = 64


def shared_pairs(rows: DataFrame, key: str, item: str, least: float = 0.0) -> DataFrame:
    """``a < b, n_shared, n_a, n_b, overlap``: pairs of keys with a Jaccard overlap of at least ``least``, exactly.

    Without a bound these are all pairs that share an item, as many as the square of a common item's keys. With one, a pair
    must share one of the rarest items of both: of a key with n items the n - ceil(least * n) + 1 rarest. Where items that very
    many keys have would give more than DIRECT pairs a row, only those are joined, and candidates are counted on all their items.
    """
    scratch = Scratch(rows.sparkSession)
    own = scratch.write(rows.select(F.col(key).alias("k"), F.col(item).alias("i")).where("k IS NOT NULL AND i IS NOT NULL").distinct(), "items")
    sizes = scratch.write(own.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    side = lambda of, name: of.select(F.col("k").alias(name), "i")
    common = scratch.write(own.groupBy("i").agg(F.count("*").alias("f")), "common")
    n_rows, n_pairs = common.agg(F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.sum(F.col("f") * (F.col("f") - 1) / 2), F.lit(0.0))).first()
    if least <= 0 or n_pairs <= DIRECT * n_rows:
        pairs = side(own, "a").join(side(own, "b"), "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_shared"))
    else:
        ranked = own.join(common, "i").join(sizes, "k").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("f", "i")))
        rare = scratch.write(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("k", "i"), "prefixes")
        near = side(rare, "a").join(side(rare, "b"), "i").where("a < b").select("a", "b").distinct()
        pairs = near.join(side(own, "a"), "a").join(side(own, "b"), ["b", "i"]).groupBy("a", "b").agg(F.count("*").alias("n_shared"))
    out = pairs.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("k").alias("b"), F.col("n").alias("n_b")), "b")
    overlap = F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared"))
    return out.where(overlap >= least).select("a", "b", "n_shared", "n_a", "n_b", rnd(overlap, 3).alias("overlap"))


def profiles(facts: DataFrame, company: str, predicate: str, value: str, kinds: dict[str, str]) -> DataFrame:
    """One row a company with a sorted array of the distinct values of each kind of fact: one aggregation of all of them."""
    sets = [F.array_sort(F.collect_set(F.when(F.col(predicate) == p, F.col(value)))).alias(n) for n, p in kinds.items()]
    return facts.groupBy(company).agg(*sets)


def touching(edges: DataFrame, node: Column) -> DataFrame:
    """Edges of which either end is the node."""
    return edges.where((F.col("a") == node) | (F.col("b") == node))


def corporate_relation(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """``pairs`` with ``relation``: that of either direction (columns ``a, b, relation``), the first by name; null without one."""
    known = relations.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("relation").alias("relation"))
    return pairs.withColumn("_a", F.least("a", "b")).withColumn("_b", F.greatest("a", "b")).join(known.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "relation"), ["_a", "_b"], "left").drop("_a", "_b")


def reasons(market: Column, offering: Column, customer: Column, geography: Column, explicit: Column, corporate: Column) -> Column:
    """Codes that explain an edge; a corporate relation explains it alone."""
    low = F.lower(corporate)
    of_overlaps = F.array_compact(F.array(
        F.when(market >= 0.40, "SAME_MARKET"), F.when(customer >= 0.40, "SAME_CUSTOMER_SEGMENT"), F.when(offering >= 0.35, "OFFERING_OVERLAP"),
        F.when(geography >= 0.50, "GEOGRAPHY_OVERLAP").when(geography < 0.10, "DIFFERENT_GEOGRAPHY_NO_REMOTE"), F.when(explicit, "EXPLICIT_COMPARISON"),
    ))
    blocked = F.when(low.isin("parent", "subsidiary", "brand_owner"), F.array(F.lit("PARENT_RELATIONSHIP_CONFLICT"))).when(low == "customer", F.array(F.lit("CUSTOMER_RELATIONSHIP_CONFLICT"))).when(low.isin("supplier", "partner"), F.array(F.lit("SUPPLIER_RELATIONSHIP_CONFLICT"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(corporate, F.lit("")) != "", blocked).otherwise(of_overlaps)


def narrative(a: Column, b: Column, kind_: Column, codes: Column, offering: Column) -> Column:
    """A sentence about an edge."""
    has = lambda code: F.array_contains(codes, F.lit(code))
    parts = F.array_compact(F.array(
        F.when(has("OFFERING_OVERLAP"), F.format_string("overlapping capabilities/products (%d%% match)", F.floor(offering * 100).cast("int"))), F.when(has("SAME_CUSTOMER_SEGMENT"), "shared target buyer personas"),
        F.when(has("SAME_MARKET"), "shared industry market"), F.when(has("EXPLICIT_COMPARISON"), "explicit third-party comparison/alternative evidence"),
    ))
    both = F.concat(a, F.lit(" and "), b)
    found = F.concat(both, F.lit(" identified as "), F.initcap(F.replace(kind_, F.lit("_"), F.lit(" "))), F.lit(" competitors"), F.when(F.size(parts) > 0, F.concat(F.lit(" due to "), F.array_join(parts, ", "))).otherwise(""), F.lit("."))
    return (
        F.when(has("PARENT_RELATIONSHIP_CONFLICT"), F.concat(both, F.lit(" share a corporate parent/subsidiary structure (non-competitive).")))
        .when(has("CUSTOMER_RELATIONSHIP_CONFLICT"), F.concat(both, F.lit(" maintain a customer relationship rather than direct competition.")))
        .when(has("SUPPLIER_RELATIONSHIP_CONFLICT"), F.concat(both, F.lit(" maintain a vendor/partner relationship."))).otherwise(found)
    )


def competitor_summary(edges: DataFrame, most: int = 5) -> DataFrame:
    """``company, top, n_competitors, n_verified``: of each company's ``most`` strongest edges those verified or supported, and counts of all.

    Reads ``a, b, strength, status``; both ends get the edge in one pass.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("company"), F.col("b").alias("other")), F.struct(F.col("b").alias("company"), F.col("a").alias("other")))).alias("e"), "strength", "status").select("e.*", "strength", "status")
    placed = ends.withColumn("k", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("strength"), "other")))
    top = F.when((F.col("k") <= most) & F.col("status").isin("verified", "supported"), F.struct("k", "other"))
    out = placed.groupBy("company").agg(F.array_sort(F.collect_list(top)).alias("_t"), F.count("*").alias("n_competitors"), F.count_if(F.col("status") == "verified").alias("n_verified"))
    return out.select("company", F.transform("_t", lambda t: t["other"]).alias("top"), "n_competitors", "n_verified")


def market_overlap(industry: Column, problem: Column) -> Column:
    return F.when((industry > 0) & (problem > 0), rnd(industry * 0.6 + problem * 0.4, 3)).when(industry > 0, industry).when(problem > 0, rnd(problem * 0.7, 3)).otherwise(0.0)


def offering_overlap(product: Column, service: Column, positioning: Column) -> Column:
    scores = F.filter(F.array(product * 1.0, service * 0.8, positioning * 0.6), lambda x: x > 0)
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.least(F.lit(1.0), rnd(F.array_max(scores) * 0.7 + mean * 0.3, 3)))


def customer_overlap(customers: Column, size_a: Column, size_b: Column) -> Column:
    size = F.when(size_a.isNull() | size_b.isNull(), 0.5).when(F.lower(F.trim(size_a)) == F.lower(F.trim(size_b)), 1.0).otherwise(0.2)
    return F.when(customers > 0, rnd(customers * 0.75 + size * 0.25, 3)).when(size_a.isNotNull() & size_b.isNotNull(), rnd(size * 0.4, 3)).otherwise(0.0)


def strength(market: Column, offering: Column, customer: Column, geography: Column, evidence: Column) -> Column:
    explicit = F.least(F.lit(1.0), evidence * 0.5)
    return F.least(F.lit(1.0), rnd(offering * 0.35 + customer * 0.25 + market * 0.20 + geography * 0.10 + explicit * 0.10, 3))


def confidence(n_evidence: Column, n_types: Column, mean: Column, quality_a: Column, quality_b: Column) -> Column:
    base = F.when(n_evidence == 0, 0.35).otherwise(F.least(F.lit(0.95), mean * F.least(F.lit(1.2), 0.8 + n_types * 0.15)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), rnd(base * (quality_a + quality_b) / 2.0, 3)))


def kind(strength: Column, market: Column, offering: Column, customer: Column, geography: Column) -> Column:
    return (
        F.when((geography > 0) & (geography < 0.25) & (offering >= 0.50), "regional")
        .when((strength >= 0.60) & (offering >= 0.30) & ((market >= 0.25) | (customer >= 0.25)), "direct")
        .when((strength >= 0.35) & ((customer >= 0.40) | (offering >= 0.15) & (market >= 0.25)), "adjacent")
        .when((strength >= 0.30) & (market >= 0.30) & (offering < 0.15), "substitute")
        .when(strength >= 0.20, "emerging")
        .otherwise("unknown")
    )


def verdict(corporate: Column, market: Column, geography: Column, strength: Column, confidence: Column, n_evidence: Column) -> Column:
    """Whether a relationship is rejected, verified, supported, uncertain or a candidate."""
    return (
        F.when(F.lower(F.trim(corporate)).isin("parent", "subsidiary", "brand_owner", "partner", "supplier", "customer", "acquired"), "rejected")
        .when((geography == 0) & (market < 0.20), "rejected")
        .when((confidence >= 0.70) & (strength >= 0.35) & (n_evidence >= 1), "verified")
        .when((confidence >= 0.45) & (strength >= 0.30), "supported")
        .when(strength >= 0.25, "uncertain")
        .when(strength < 0.15, "rejected")
        .otherwise("candidate")
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, in one pass."""
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.src", "e.dst", "weight")


def expand(edges: DataFrame, start: DataFrame, depth: int = 2, first: int = 50, fan: int = 10, further: int = 20) -> DataFrame:
    """``a, b, weight, hop``: the graph around the start nodes (column ``node``).

    Up to ``first`` edges of a start node; then up to ``further`` edges of each of its ``fan`` strongest neighbours. The edges
    are computed and written once.
    """
    scratch = Scratch(edges.sparkSession)
    arcs = both_ways(scratch.write(edges, "edges"))
    order = [F.desc("weight"), F.col("dst")]
    near = arcs.join(start.select(F.col("node").alias("src")), "src").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where(F.col("k") <= first)
    near = scratch.write(near, "near")
    found = near.select("src", "dst", "weight", F.lit(1).alias("hop"))
    if depth > 1:
        next_nodes = near.where(F.col("k") <= fan).select(F.col("dst").alias("src")).distinct()
        far = arcs.join(next_nodes, "src").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(*order))).where(F.col("k") <= further)
        found = found.unionByName(far.select("src", "dst", "weight", F.lit(2).alias("hop")))
    return found.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("weight"), F.min("hop").alias("hop"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``node, depth``: nodes by the least number of hops from the start.

    Each round joins the newest nodes alone, is written once, and the rounds end when one finds nothing new.
    """
    scratch = Scratch(edges.sparkSession)
    newest = scratch.write(start.select("node", F.lit(0).alias("depth")), "round")
    seen = newest
    for d in range(1, depth + 1):
        found = edges.join(newest, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        newest = scratch.write(found.withColumn("depth", F.lit(d)), "round")
        if not newest.limit(1).count():
            break
        seen = seen.unionByName(newest)
    return seen
