"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.llm import decontaminate, hmm, licenses, linededup, mixing, quality, repeats, simhash, toxicity, urlfilter
from vantor.llm._store import written

#: Weights of the sources in code point order, repeating.
MIX_WEIGHTS, MIX_CAP, MIX_SEED = (5, 2, 1), 3, 1
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "mix-sizes")
    mixed = mixing.mix_sized(sized, MIX_WEIGHTS, MIX_CAP, MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS ceiling,
    CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS HUGEINT) AS weight
  FROM sums),
filling AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(ceiling) OVER up, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS rest_weight
  FROM weighed
  WINDOW up AS (ORDER BY CAST(ceiling AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, rest * weight > ceiling * rest_weight AS is_full FROM filling),
leftover AS (
  SELECT sum(source_size) - coalesce(sum(ceiling) FILTER (is_full), 0) AS rest, sum(weight) - coalesce(sum(weight) FILTER (is_full), 0) AS rest_weight FROM marked),
wanted AS (
  SELECT m.source, m.source_size,
    CASE WHEN is_full THEN CAST(ceiling AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(l.rest AS DOUBLE) / CAST(l.rest_weight AS DOUBLE) END AS target
  FROM marked m, leftover l),
rated AS (
  SELECT s.doc_id, s.size, CAST(w.source_size AS BIGINT) AS source_size, w.target,
    CASE WHEN w.source_size > 0 THEN w.target / CAST(w.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS draw
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, width=4, keep=("doc_id",)).select("doc_id", "fingerprint", "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC NULLS LAST, verdict DESC) AS k
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality.judge(docs, keep=("doc_id",))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def toxicity_machine(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.FactorizationMachine:
    """Learnt from the labels that aren't held out."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(toxicity.bucket_of(F.col("doc_id"), 5) != 0)
    return toxicity.train(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_machine(spark, docs, sf_dir), keep=("doc_id",))
    held_out = F.coalesce(toxicity.bucket_of(F.col("doc_id"), 5) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(toxicity.bucket_of(F.col("doc_id"), 7) == 2, F.lit(True))
    docs = docs.withColumn("held_out", held_out)
    return hmm.score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.mark(docs, _table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
item_at AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM item_at),
lengths AS (SELECT DISTINCT n FROM grams),
doc_at AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT a.doc_id, a.i, a.n, g.item_id FROM doc_at a JOIN grams g ON g.n = a.n AND g.gram = array_to_string(a.w[a.i:a.i + a.n - 1], ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id
"""


def op8_repeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = repeats.remove_repeats(docs, keep=("doc_id",))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 256)) AS base FROM d),
parts AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * (256 + 99)) AS part FROM starts),
places AS (SELECT doc_id, base, part, unnest(range(0, least(256, length(part) // 2 - 99))) AS j FROM parts),
keys AS (SELECT doc_id, base + j AS i, md5(substr(part, 2 * j + 1, 200)) AS k FROM places),
firsts AS (SELECT k, min({'doc': doc_id, 'i': i}) AS f FROM keys GROUP BY k HAVING count(*) > 1),
later AS (SELECT keys.doc_id, keys.i FROM keys JOIN firsts ON keys.k = firsts.k WHERE {'doc': keys.doc_id, 'i': keys.i} > firsts.f),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM steps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, r),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
pieces AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM cuts JOIN d ON d.doc_id = cuts.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN pieces p ON p.doc_id = d.doc_id
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, keep=("doc_id",))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS n FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT k.*, coalesce(o.n >= 2 AND k.doc_id <> o.owner, false) AS lost FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return quality.base_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))


QUALITY_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
tok AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
seq AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM seq WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words FROM w LEFT JOIN hit ON hit.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""


def hmm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express; the score to four places."""
    base = F.floor(F.col("base_score") * 1e4 + 0.5) / 1e4
    return op6_hmm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"))


#: CRC-32 of the digits of an id: a table-free form, bit by bit.
_CRC_SQL = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
HMM_BASE_SQL = rf"""
WITH d AS (SELECT doc_id, {_CRC_SQL} % 7 = 2 AS held_out, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), [' end']) AS w FROM documents),
tok AS (SELECT doc_id, held_out, unnest(w) AS t FROM d),
vocab AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
total AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM vocab)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, floor(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) * 1e4 + 0.5) / 1e4 AS base_score
FROM tok LEFT JOIN vocab ON vocab.t = tok.t, total GROUP BY doc_id, held_out
"""


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LICENSE_BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
seq AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, i - 1 AS place, CASE WHEN a = 'under' AND b = 'the' AND c = 'mit' AND e = 'license' THEN 'mit' WHEN a = 'apache' AND b = 'license' AND c = 'version' AND e = '2' THEN 'apache-2' WHEN a = 'cc' AND b = 'by' AND c = 'nc' THEN 'cc-by-nc' END AS label FROM seq)
SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(label) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id AND label IS NOT NULL GROUP BY d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_quality_rules": op4_quality_rules,
        "op5_toxicity": op5_toxicity,
        "op6_hmm_score": op6_hmm_score,
        "op7_decontaminate": op7_decontaminate,
        "op8_repeat_dedup": op8_repeat_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_line_dedup": op10_line_dedup,
        "quality_base": quality_base,
        "hmm_base": hmm_base,
        "license_base": license_base,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op3_url_filter": OP3_SQL, "op7_decontaminate": OP7_SQL, "op8_repeat_dedup": OP8_SQL, "op10_line_dedup": OP10_SQL, "quality_base": QUALITY_BASE_SQL, "hmm_base": HMM_BASE_SQL, "license_base": LICENSE_BASE_SQL}
