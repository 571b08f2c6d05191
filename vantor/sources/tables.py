"""Readers of landed data and writers of results."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantor.functions.text import company_key, fingerprint, host


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """Tables written once in the folder that ``spark.checkpoint.dir`` names, to cut lineage; :meth:`drop` removes them.

    A local session without that setting gets a folder of its own, which goes when Python ends.
    """

    _own: dict[str, str] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            app = spark.sparkContext.applicationId
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            if app not in self._own:
                folder = tempfile.mkdtemp(prefix="vantor-scratch-")
                atexit.register(shutil.rmtree, folder, True)
                self._own[app] = f"file://{folder}"
            named = self._own[app]
        self.folder = f"{named.rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def point_lookup(rows: DataFrame, key: Column, value, text: str) -> DataFrame:
    """The rows of one key with the length of a text column (null: 0); the filter reaches the scan."""
    return rows.where(key == F.lit(value)).withColumn(f"{text}_length", F.length(F.coalesce(F.col(text), F.lit(""))))


def write_content(pages: DataFrame, path: str, key_parts: list[str], content: str) -> DataFrame:
    """Stores content once under its hash, and returns ``object_key, content_hash, size`` of each row; what is there already isn't written again."""
    hashed = pages.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256))
    named = hashed.withColumn("shard", F.substring("content_hash", 1, 2))
    try:
        known = pages.sparkSession.read.parquet(path).select("content_hash")
    except AnalysisException:
        known = None
    new = named.dropDuplicates(["content_hash"])
    new = new.join(known, "content_hash", "left_anti") if known is not None else new
    new.select("content_hash", F.col(content).alias("content"), "shard").write.mode("append").partitionBy("shard").option("compression", "zstd").parquet(path)
    return named.select(*key_parts, F.concat_ws("/", "shard", "content_hash").alias("object_key"), "content_hash", F.length(F.coalesce(F.col(content), F.lit(""))).alias("size"))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet in a folder of its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def migrate_companies(old: DataFrame, name: str, website: str, city: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of an old company table as canonical companies and their domains; rows of one host become one company."""
    keyed = old.withColumn("name_key", company_key(F.col(name))).withColumn("domain", F.nullif(host(F.col(website)), F.lit("")))
    key = F.coalesce(F.concat(F.lit("d:"), "domain"), F.concat(F.lit("n:"), "name_key"))
    rows = keyed.withColumn("_key", key).where("name_key <> ''")
    parts = [F.min(name).alias("canonical_name"), F.min("name_key").alias("name_key"), F.min("domain").alias("primary_domain"), F.count("*").alias("n_merged")]
    if city:
        parts.append(F.min(city).alias("city"))
    companies = rows.groupBy("_key").agg(*parts).select(fingerprint(F.col("_key"), length=16).alias("company_id"), "*").drop("_key")
    domains = companies.where("primary_domain IS NOT NULL").select(F.col("primary_domain").alias("domain"), "company_id", F.lit(True).alias("is_primary"))
    return companies, domains


def first_contact(companies: DataFrame, contacts: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Companies with the fields of their first contact, flat, as a CSV holds them."""
    one = contacts.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_c")).select(key, *[F.col(f"_c.{f}").alias(f"contact_{f}") for f in fields])
    return companies.join(one, key, "left")


def _one_per_host(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("host").orderBy("line")
    return rows.where("host <> ''").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def csv_seeds(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``url, host`` of a CSV: its url, website or link column, else the first; the first row of each host."""
    rows = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in rows.columns}
    url = F.coalesce(*[F.nullif(F.trim(F.col(names[c])), F.lit("")) for c in ("url", "website", "link") if c in names] or [F.col(rows.columns[0])])
    seeds = _one_per_host(rows.select(url.alias("raw"), F.monotonically_increasing_id().alias("line")).withColumn("host", host(F.col("raw"))))
    full = seeds.select(F.when(F.col("raw").rlike("^https?://"), F.col("raw")).otherwise(F.concat(F.lit("https://"), "raw")).alias("url"), "host", "line").orderBy("line")
    return (full.limit(limit) if limit else full).drop("line")


def text_seeds(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and comments are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("raw"), F.monotonically_increasing_id().alias("line")).where("raw <> '' AND NOT startswith(raw, '#')")
    return _one_per_host(rows.withColumn("host", host(F.col("raw")))).orderBy("line").select(F.when(F.col("raw").rlike("^https?://"), F.col("raw")).otherwise(F.concat(F.lit("https://"), "raw")).alias("url"), "host")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages with the host that is the second part of their key, and the hash of their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("host"), F.decode("content", "utf-8").alias("html"), F.sha2("content", 256).alias("content_hash"))


def object_key(category: Column, entity: Column, day: Column, name: Column) -> Column:
    clean = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9._\-]", "_")
    return F.concat_ws("/", clean(category), F.date_format(day, "yyyy/MM/dd"), clean(entity), clean(name))


def union_leads(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """All columns of all parts; of each key the first known value of each column, earlier parts first."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rank = F.struct("_part", order)
    return rows.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rows.columns if c not in (key, "_part")])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_snapshots(pages: DataFrame, path: str, host_col: str) -> None:
    """Pages by host, compressed."""
    pages.write.mode("overwrite").partitionBy(host_col).option("compression", "zstd").parquet(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV for each sheet."""
    for name, rows in sheets.items():
        write_csv(rows, f"{path}/{name}")


def push_batches(rows: DataFrame, job: str, id_col: str, size: int) -> DataFrame:
    """``batch, n, idempotency_key, payload`` of rows in batches; equal rows give equal keys.."""
    placed = rows.withColumn("_h", F.xxhash64(F.col(id_col).cast("string")))
    parts = placed.groupBy().agg(F.count("*").alias("n")).first()[0]
    batches = max(1, -(-int(parts or 0) // max(1, size // 2)))
    named = placed.withColumn("batch", F.pmod("_h", F.lit(batches)).cast("int"))
    ids = F.array_join(F.array_sort(F.collect_list(F.col(id_col).cast("string"))), ",")
    grouped = named.groupBy("batch").agg(F.count("*").alias("n"), F.substring(F.sha2(F.concat_ws(":", F.lit(job), F.first("batch").cast("string"), ids).cast("binary"), 256), 1, 16).alias("idempotency_key"), F.collect_list(F.to_json(F.struct(*rows.columns))).alias("payload"))
    return grouped


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON configuration, read through Spark so that it may be anywhere."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)
