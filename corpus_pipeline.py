"""The corpus pipeline: documents pass through the stages in turn, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
``documents``; the last has one row for each copy that the mix takes, numbered in ``copy``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.llm import decontaminate, linededup, mixing, shingles, toxicity
from vantor.llm._store import mark, release, written
from vantor.llm.queries import MIX_CAP, MIX_SEED, MIX_WEIGHTS, toxicity_machine

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine calls toxic; it learns from the labels of documents that are there.

    Null and empty texts get the score of no terms; repeated rows go or stay together; without labels all stay.
    """
    machine = toxicity_machine(spark, docs.select("doc_id", "text"), sf_dir)
    return toxicity.score(docs, machine).where("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id has too go; all documents stay. Null texts come back empty; rows without id keep all lines."""
    done = linededup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles of similarity 0.8 or more stays.

    Texts without words are one group; rows that repeat the smallest id stay, and so do rows without id.
    """
    return shingles.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a window of a benchmark item. Null texts have none; an empty benchmark drops nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean_documents(docs, benchmark).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix of sources takes. Null is a source of its own; texts without words weigh nothing."""
    mixed = mixing.mix(docs, MIX_WEIGHTS, MIX_CAP, MIX_SEED)
    return mixing.emit(mixed).select(*COLUMNS, F.col("copy").cast("int").alias("copy"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]
#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        since = mark()
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(since, keep=1)  # the stage's own tables, now that its result is written
    return docs
