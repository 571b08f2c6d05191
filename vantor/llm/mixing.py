"""Mixing of sources to target weights by repetition and hash-seeded draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.llm._store import written

WORD = r"[^\x20\x09-\x0D]+"
#: A table of targets with at most this many sources (at most some 64 MB) is broadcast; a larger one is joined on salted keys.
BROADCAST_SOURCES = 200_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; null ids share one draw."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last. Each partition numbers its own range; only the ranges' lengths meet."""
    parts = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    lengths = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = lengths.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return parts.join(before, "_part").withColumn("rank", F.row_number().over(within) - 1 + F.col("_before")).drop("_part", "_before")


def targets(sources: DataFrame, weights: Sequence[int] | Mapping[str, int], cap: int) -> DataFrame:
    """Target words of each source.

    ``sources`` has ``source`` and ``source_size``. ``weights`` repeat along the sources in code point order (null last), or
    name a weight for each source (absent: 0). All sources share the total size by weight; a target stops at ``cap`` times its
    source's size and the excess is shared again by weight until no target is above. Shares are compared as whole numbers.
    """
    if isinstance(weights, Mapping):
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        weight = F.coalesce(table[F.col("source")], F.lit(0)) if table is not None else F.lit(0)
        weighed = sources.withColumn("weight", weight.cast("long"))
    else:
        cycle = F.array(*[F.lit(int(w)) for w in weights])
        weighed = _numbered(sources).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    weighed = written(weighed.withColumn("ceiling", F.col("source_size") * cap), "mix-sources")

    total, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, all_weight = int(total or 0), int(all_weight or 0)
    big = lambda c: c.cast("decimal(38,0)")
    left, left_weight, full = total, all_weight, F.lit(False)
    while left_weight:
        above = big(F.col("weight")) * F.lit(left).cast("decimal(18,0)") > big(F.col("ceiling")) * F.lit(left_weight).cast("decimal(12,0)")
        used, used_weight, n = weighed.where(above).agg(F.sum("ceiling"), F.sum("weight"), F.count("*")).first()
        full = above
        if total - int(used or 0) == left and all_weight - int(used_weight or 0) == left_weight:
            break
        left, left_weight = total - int(used or 0), all_weight - int(used_weight or 0)
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(left_weight or 1))
    return weighed.select("source", "source_size", F.when(full, F.col("ceiling").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] | Mapping[str, int], cap: int = 3, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies, taken``: how often the mix takes each document.

    A document's rate is its source's target divided by the source's size. It is taken floor(rate) times, and once more if
    its draw, seeded by its id, is below the fraction. Null text: size 0. Null source: a source of its own, ordered last.
    Sources without words: target and rate 0. Repeated rows are separate rows with the same draw. Empty input: empty result.
    Columns of ``docs`` that have a name of the result are replaced.
    """
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    keep = [c for c in docs.columns if c not in made]
    sized = docs.select(*keep, word_count(F.col(text_col)).alias("size"))
    sums = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return apply_rates(sized, written(targets(sums, weights, cap), "mix-targets"), seed, id_col, source_col)


def mix_sized(sized: DataFrame, weights: Sequence[int] | Mapping[str, int], cap: int = 3, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """As :func:`mix`, for rows that have their ``size`` already."""
    sums = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    return apply_rates(sized, written(targets(sums, weights, cap), "mix-targets"), seed, id_col, source_col)


def apply_rates(sized: DataFrame, wanted: DataFrame, seed: int, id_col: str, source_col: str) -> DataFrame:
    """Joins the sources' targets to the documents and draws their copies."""
    if wanted.count() <= BROADCAST_SOURCES:
        side = wanted.withColumnRenamed("source", "_source")
        joined = sized.join(F.broadcast(side), F.col(source_col).eqNullSafe(F.col("_source")), "inner").drop("_source")
    else:
        side = wanted.select(F.col("source").alias("_source"), "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        salted = sized.withColumn("_key", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        joined = salted.join(side, F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_key") == F.col("_salt")), "inner").drop("_source", "_salt", "_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate").cast("long")
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", whole + F.when(draw(F.col(id_col), seed) < F.col("rate") - whole, 1).otherwise(0))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def emit(mixed: DataFrame, copy_col: str = "copy") -> DataFrame:
    """One row for each copy that the mix takes, numbered from 1 in ``copy_col``; documents that it doesn't take have none."""
    return mixed.where("copies > 0").withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
