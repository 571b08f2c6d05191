"""The registered queries and, where SQL can express them, the SQL that they equal.

The driver's tables stand for the engine's: customers and suppliers are companies, events are signals and timelines, orders are
fact histories, shared parts are relationships, pages and documents are what was crawled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.functions import numeric as N
from vantor.functions import text as T
from vantor.operators import extract, facts, graph, history, icp, pages, pipeline, quality, resolution, rollups, scoring, search, vectors
from vantor.sources.tables import table
from vantor.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The time at which states, ages and windows are taken.
AS_OF = "2024-01-25 00:00:00"
ORDERS_AS_OF = "1998-01-01 00:00:00"
_TERMS = "the that"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _r(x: str, n: int) -> str:
    return f"(floor(({x}) * 1e{n} + 0.5) / 1e{n})"


# --- search ---

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _tok(x: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({x}, '')), '{T.MARKED}', '{T.PLAIN}'), '[\p{{L}}\p{{N}}]+')"


def _hits_sql(text: str, domain: str = "") -> str:
    """The fielded formula over all documents: source as host, first line as title, language as description."""
    query = search.parse_query(text)

    def count(field: str, unit: tuple[str, ...]) -> str:
        if len(unit) == 1:
            return f"len(list_filter({field}, lambda x: x = '{unit[0]}'))"
        same = " AND ".join(f"{field}[j + {k}] = '{t}'" for k, t in enumerate(unit))
        return f"len(list_filter(range(1, len({field}) + 1), lambda j: {same}))"

    def holds(tree) -> str:
        if isinstance(tree, int):
            return f"w_{tree} > 0"
        op, x, y = tree
        return f"({holds(x)} {'OR' if op == 'OR' else 'AND'} {'NOT ' if op == 'NOT' else ''}({holds(y)}))"

    n = range(len(query.units))
    weights = ", ".join(f"CAST({' + '.join(f'{int(w)} * {count(f't{k}', query.units[i])}' for k, w in enumerate(search.FIELDS.values()))} AS DOUBLE) AS w_{i}" for i in n)
    part = " + ".join(f"greatest(1e-6, ln((n - df_{i} + 0.5) / (df_{i} + 0.5))) * (w_{i} * 2.2e0) / (w_{i} + 1.2e0 * (0.25e0 + 0.75e0 * len / mean))" for i in n)
    return f"""cut AS (SELECT doc_id AS id, source AS domain, split_part(text, chr(10), 1) AS title, {_tok("source")} AS t0, {_tok("split_part(text, chr(10), 1)")} AS t1, {_tok("lang")} AS t2, {_tok("text")} AS t3 FROM documents),
counted AS (SELECT id, domain, title, len(t0) + len(t1) + len(t2) + len(t3) AS len, {weights} FROM cut),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS mean, {", ".join(f"CAST(count(*) FILTER (w_{i} > 0) AS DOUBLE) AS df_{i}" for i in n)} FROM counted),
hits AS (SELECT id, domain, title, {_r("0e0 + " + part, 4)} AS bm25, CAST(len AS INT) AS len FROM counted, stats WHERE {holds(query.tree)}{domain})"""


_INDEXES: dict[tuple[str, str], search.Index] = {}


def _index(spark, d) -> search.Index:
    """The index of the documents, built once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        first_line = F.split_part("text", F.lit("\n"), F.lit(1))
        fields = {"domain": F.col("source"), "title": first_line, "description": F.col("lang"), "content": F.col("text")}
        _INDEXES[key] = search.build_index(table(spark, d, "documents"), "doc_id", fields, {"n_chars": F.col("n_chars")}, stems=False)
    return _INDEXES[key]


@register(f"SELECT DISTINCT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tok('source')} || {_tok('split_part(text, chr(10), 1)')} || {_tok('lang')} || {_tok('text')}) AS term FROM documents) GROUP BY term")
def search_index_terms(spark, d):
    return _index(spark, d).terms.select("term", "df")


@register(f"WITH {_hits_sql(_TERMS)} SELECT id, domain, bm25, len FROM hits ORDER BY bm25 DESC, id LIMIT 20")
def search_bm25_topk(spark, d):
    return search.matches(_index(spark, d), search.parse_query(_TERMS)).orderBy(F.desc("bm25"), "id").limit(20)


@register(f"""WITH {_hits_sql("the of")}, page AS (SELECT * FROM hits ORDER BY bm25 DESC, id LIMIT 10 OFFSET 5)
SELECT id, bm25, len, {_r("bm25 + 4.0 * ((CASE WHEN contains(lower(title), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(title), 'of') THEN 1 ELSE 0 END)) + floor(log2(1.0 + id % 7) * 1.5 * 1e2 + 0.5) / 1e2 + CASE WHEN id % 60 < 7 THEN 2.0 WHEN id % 60 < 30 THEN 1.0 ELSE 0.0 END", 2)} AS score FROM page""")
def search_two_stage_rerank(spark, d):
    return search.two_stage(_index(spark, d), search.parse_query("the of"), 10, 5, F.col("id") % 7, F.col("id") % 60).select("id", "bm25", "len", "score")


@register(f"WITH {_hits_sql('and AND with NOT license')} SELECT id, domain, bm25, len FROM hits")
def search_boolean_filter(spark, d):
    return search.matches(_index(spark, d), search.parse_query("and AND with NOT license"))


_PHRASE = '"of the" that'


@register(f"WITH {_hits_sql(_PHRASE)} SELECT id, domain, bm25, len FROM hits")
def search_phrase(spark, d):
    return search.matches(_index(spark, d), search.parse_query(_PHRASE))


@register(f"WITH {_hits_sql('the', " AND (domain = 'src1' OR contains(lower(domain), 'src1'))")} SELECT id, domain, bm25, len FROM hits")
def search_site(spark, d):
    return search.matches(_index(spark, d), search.parse_query("the site:www.src1"))


@register(f"WITH {_hits_sql('src2 OR fr et -license')} SELECT id, domain, bm25, len FROM hits")
def search_fielded(spark, d):
    return search.matches(_index(spark, d), search.parse_query("src2 OR fr et -license"))


@register("SELECT doc_id AS id, n_chars, 1e0 AS score FROM documents WHERE source = 'src2' OR contains(lower(source), 'src2') ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 3")
def search_browse(spark, d):
    return search.browse(_index(spark, d), "n_chars", 3, 10, "src2").select("id", "n_chars", "score")


@register(rf"""WITH f AS (SELECT doc_id, text, string_split_regex(trim(text), '\s+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]', '', 'g') IN ('license', 'licence'))) > 0 THEN 'found' ELSE coalesce(nullif(left(text, 0), ''), 'Document content matched query terms.') END AS shown FROM f""")
def search_snippet(spark, d):
    """Whether a window with a marked term is shown, or the fallback."""
    shown = search.snippet(F.col("text"), ("license", "licence"), fallback=F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.when(shown.contains("<mark>"), "found").otherwise(shown).alias("shown"))


@register("SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, sum(n_chars)::BIGINT AS chars FROM documents")
def catalog_stats(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))


@register(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(*) AS n, max(doc_id) AS last_at FROM w GROUP BY term ORDER BY n DESC, last_at DESC, term LIMIT 8")
def popular_terms_top8(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return search.popular(words, "term", "doc_id")


@register(r"""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term, len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS len FROM documents)
SELECT id, len, term, count(*) AS tf FROM w GROUP BY ALL""")
def search_postings(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", F.col("text"))


# --- pages ---

_HOST = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(url)), '^https?://', ''), '^([^/?#]*)', 1), ':.*$', ''), '^www\.', '')"


@register(rf"""WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages)
SELECT page_id, host,
  regexp_extract(url, '^(https?)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#;]*)', 1), '/+$', '') AS clean,
  CASE WHEN len(string_split(host, '.')) <= 2 THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS registrable
FROM p""")
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.host(u).alias("host"), T.url(u).alias("clean"), T.registrable(u).alias("registrable"))


@register(rf"""SELECT page_id,
  CASE WHEN regexp_matches(lower(regexp_extract(regexp_replace(url, '^https?://', ''), '^[^/?#]*([^?#;]*)', 1)), '/news/|/blog/|/article/|/wiki/') THEN 'article' ELSE 'company_website' END AS site_kind,
  CASE WHEN regexp_replace(regexp_extract(regexp_replace(url, '^https?://', ''), '^[^/?#]*([^?#;]*)', 1), '/+$', '') = '' THEN 'homepage' ELSE 'other' END AS page_kind
FROM pages""")
def page_classify(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", T.site_kind(u).alias("site_kind"), T.page_kind(u, F.lit("")).alias("page_kind"))


@register(rf"""WITH l AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '{pages.HREF.replace("'", "''")}', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href WHEN starts_with(href, '/') THEN site || href WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href
  ELSE site || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*/|/)', 1), ''), '/') || regexp_replace(href, '^(\./)+', '') END AS to_url, count(*) AS n FROM l WHERE NOT regexp_matches(lower(href), '^(javascript|mailto|tel|data):') GROUP BY ALL""")
def link_extract(spark, d):
    return pages.link_rows(table(spark, d, "pages"), "page_id", "url", "html").groupBy("page_id", "to_url").agg(F.count("*").alias("n"))


@register(rf"""WITH p AS (SELECT page_id, {_HOST} AS from_host FROM pages), l AS (SELECT from_host, CASE WHEN len(string_split(from_host, '.')) <= 2 THEN from_host ELSE array_to_string(string_split(from_host, '.')[-2:], '.') END AS host FROM p),
d AS (SELECT host, count(*) AS inbound FROM l WHERE from_host <> host GROUP BY host)
SELECT host, inbound, {_r("log2(1.0 + inbound) * 1.5", 2)} AS boost FROM d""")
def inbound_authority(spark, d):
    """Pages of a host's parts count as links to the host."""
    each = table(spark, d, "pages").select(T.host(F.col("url")).alias("from_host"), T.registrable(F.col("url")).alias("to_host"))
    return pages.inbound(each)


def _has(pattern: str) -> str:
    return f"regexp_matches(html, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _count(pattern: str, of: str = "html") -> str:
    return f"len(regexp_extract_all({of}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _content_sql(name: str) -> str:
    tag = pages._META.format(name).replace("'", "''")
    return f"""trim(regexp_extract(regexp_extract(html, '{tag}', 0), '(?i)content=["'']([^"'']*)', 1))"""


_AUDIT_SQL = rf"""WITH x AS (SELECT page_id, html, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS name, {_content_sql("description")} AS about, {_count(r"(?i)<h1[\s>]")} AS n_h1,
  {" + ".join(f"(CASE WHEN {_has(pages._META.format(f'og:{p}'))} THEN 1 ELSE 0 END)" for p in ("title", "description", "image"))} AS n_og, {_count(r"(?i)<img[\s>]")} AS images,
  {_count(r"(?i)<img[\s>]")} - {_count(r"""(?i)<img\s[^>]*alt=["'][^"']""")} AS missing,
  {_count(r"\S+", "regexp_replace(regexp_replace(html, '" + pages.TEXT_BETWEEN + "', ' ', 'g'), '<[^>]+>', ' ', 'g')")} AS words FROM pages),
s AS (SELECT page_id, CASE WHEN length(name) BETWEEN 10 AND 70 THEN 100 WHEN name <> '' THEN 75 ELSE 0 END AS title_score, CASE WHEN length(about) BETWEEN 50 AND 165 THEN 100 WHEN about <> '' THEN 70 ELSE 0 END AS description_score,
  CASE WHEN n_h1 = 1 THEN 100 WHEN n_h1 > 1 THEN 80 ELSE 0 END AS h1_score, CASE WHEN {_has(pages._META.format("viewport"))} THEN 100 ELSE 0 END AS viewport_score, CASE WHEN {_has(r"""(?i)<link\s[^>]*rel=["']canonical["']""")} THEN 100 ELSE 60 END AS canonical_score,
  CASE WHEN n_og = 3 THEN 100 WHEN n_og >= 1 THEN 70 ELSE 30 END AS og_score, CASE WHEN missing <= 0 THEN 100 ELSE greatest(20, CAST(floor((1e0 - missing / CAST(images AS DOUBLE)) * 100) AS INT)) END AS alt_score,
  CASE WHEN contains(lower({_content_sql("robots")}), 'noindex') THEN 50 ELSE 100 END AS robots_score,
  (CASE WHEN {_has(r"""(?i)<script[^>]*type=["']application/ld\+json["']""")} THEN 35 ELSE 0 END) + (CASE WHEN words >= 500 THEN 25 WHEN words >= 200 THEN 15 ELSE 0 END)
  + (CASE WHEN {_has(r"(?is)<h[23][^>]*>[^<]*\?\s*</h[23]>")} OR contains(html, 'FAQPage') THEN 20 ELSE 0 END) + (CASE WHEN {_has(r"(?i)<(?:table|ul|ol)[\s>]")} THEN 20 ELSE 0 END) AS aeo_score FROM x),
t AS (SELECT *, CAST(floor((title_score + description_score + h1_score + viewport_score + canonical_score + og_score + alt_score + robots_score + aeo_score) / 9e0) AS INT) AS seo_score FROM s)
SELECT *, CASE WHEN seo_score >= 90 THEN 'Excellent' WHEN seo_score >= 70 THEN 'Good' ELSE 'Needs Improvement' END AS rating FROM t"""


@register(_AUDIT_SQL)
def seo_audit(spark, d):
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in pages.audit(F.col("html")).items()])


@register()
def page_parse(spark, d):
    parsed = table(spark, d, "pages").select("page_id", pages.parse("url", "html").alias("p"))
    return parsed.select("page_id", "p.title", "p.description", "p.n_words", "p.headings", "p.images", F.size("p.links").alias("n_links"))


@register("SELECT page_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(html), {chr(39)}{t}{chr(39)})' for t in texts)} THEN '{name}' END" for name, texts in pages.TECHNOLOGIES.items()) + "], lambda x: x IS NOT NULL), ',') AS technologies FROM pages")
def page_technologies(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(pages.technologies(F.col("html")), ",").alias("technologies"))


@register(r"""WITH e AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})', 1), lambda x: lower(x))) AS found FROM documents), u AS (SELECT doc_id, unnest(found) AS email FROM e) SELECT doc_id, email FROM u""")
def email_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


# --- names and resolution ---


@register("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name_key, upper(left(p_name, 1)) AS initial FROM part")
def name_key_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.company_key(F.col("p_name")).alias("name_key"), F.upper(F.substring("p_name", 1, 1)).alias("initial"))


@register("""WITH k AS (SELECT s_suppkey AS id, 'n' || s_nationkey || ':' || CAST(floor(s_acctbal / 5000) AS BIGINT) AS key FROM supplier)
SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id""")
def blocking_pairs(spark, d):
    key = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(":"), F.floor(F.col("s_acctbal") / 5000).cast("string"))
    return resolution.candidate_pairs(table(spark, d, "supplier"), "s_suppkey", F.array(key))


@register("""WITH r AS (SELECT p_partkey AS id, p_name, p_brand || '/' || p_type || '/' || p_size AS spec FROM part),
l AS (SELECT min(id) OVER (PARTITION BY p_name) AS a, id AS b, 'same_name' AS signal, 0.75 AS score FROM r
  UNION ALL SELECT min(id) OVER (PARTITION BY spec) AS a, id AS b, 'same_spec' AS signal, 0.95 AS score FROM r)
SELECT a, b, CAST(max(score) AS DOUBLE) AS confidence, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals, CASE WHEN max(score) >= 0.9 THEN 'auto_merged' ELSE 'review_required' END AS decision FROM l WHERE a < b GROUP BY a, b""")
def entity_match_decide(spark, d):
    parts = table(spark, d, "part")
    spec = F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))
    links = resolution.by_rule(parts, "p_partkey", F.col("p_name"), "same_name", 0.75).unionByName(resolution.by_rule(parts, "p_partkey", spec, "same_spec", 0.95))
    return resolution.best_signal(links).withColumn("signals", F.array_join("signals", ","))


@register()
def entity_name_ratio(spark, d):
    parts = table(spark, d, "part")
    pairs = resolution.candidate_pairs(parts, "p_partkey", F.array(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))))
    name = lambda c: parts.select(F.col("p_partkey").alias(c), F.col("p_name").alias(f"name_{c}"))
    return pairs.join(name("a"), "a").join(name("b"), "b").select("a", "b", N.rnd(T.sequence_ratio("name_a", "name_b"), 4).alias("ratio"))


@register("""SELECT md5(text) AS dedupe_key, min(doc_id) AS first_seen, count(*) AS n_merged, arg_min(source, doc_id) AS source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY text""")
def priority_dedupe_merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.md5("text").alias("h"))
    return resolution.merge_by_priority(docs, [F.col("h")], "doc_id", ["source"], ["lang"]).withColumn("langs", F.array_join("langs", ","))


@register("""WITH RECURSIVE r AS (SELECT o_orderkey AS source, max_by(o_orderkey // 2, o_orderdate) AS target FROM orders GROUP BY 1),
walk AS (SELECT source, target, 1 AS hops FROM r UNION ALL SELECT w.source, r.target, w.hops + 1 FROM walk w JOIN r ON r.source = w.target WHERE w.hops < 10 AND r.target <> w.source)
SELECT source, max_by(target, hops) AS target, CAST(max(hops) AS INT) AS hops FROM walk GROUP BY source""")
def merge_redirects(spark, d):
    redirects = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.expr("o_orderkey div 2").alias("target"), F.col("o_orderdate").alias("at"))
    return resolution.follow_redirects(redirects)


# --- history and facts ---


@register(f"""WITH w AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice AS value, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_value FROM orders)
SELECT o_custkey, o_orderkey, {_r("value - previous_value", 2)} AS delta, CASE WHEN previous_value <> 0 THEN {_r("(value - previous_value) / previous_value * 100.0", 2)} ELSE 0.0 END AS pct FROM w WHERE previous_value IS NOT NULL AND previous_value <> value""")
def change_events_lag(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_totalprice", "value")
    return history.changes(rows, ["o_custkey"], "o_orderdate", "value", "o_orderkey").select("o_custkey", "o_orderkey", "delta", "pct")


@register("""SELECT event_id, CASE greatest(1, least(4, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 WHEN 'signup' THEN 2 ELSE 2 END) + CASE WHEN abs(value) > 50 THEN 1 ELSE 0 END) - CASE WHEN event_id % 10 < 3 THEN 1 ELSE 0 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS significance FROM events""")
def significance(spark, d):
    event = F.when(F.col("event_type") == "purchase", "location_added").otherwise("technology_added")
    return table(spark, d, "events").select("event_id", history.significance(event, F.lit(None).cast("string"), F.col("value"), (F.col("event_id") % 10 + 2) / 10.0).alias("significance"))


@register("""SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def scd2_intervals(spark, d):
    return history.intervals(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus", "valid_from", "valid_to", "is_current")


@register(f"SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '{ORDERS_AS_OF}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def state_as_of(spark, d):
    return history.state_as_of(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", _at(ORDERS_AS_OF), ["o_orderstatus", "o_totalprice"])


@register("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT v.event_id, p.value, p.ts AS matched_ts FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts""")
def as_of_join(spark, d):
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return history.as_of_join(views, bought, "user_id", "ts", "ts", ["value"]).select("event_id", "value", "matched_ts")


def _growth_sql(day: int) -> str:
    start = f"TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL {day} DAY"
    return f"""SELECT o_custkey, {day} AS window_days,
  coalesce(arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderdate < {start}), arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= {start})) AS baseline,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= {start}) AS latest, count(*) FILTER (o_orderdate >= {start}) AS n_values
FROM orders WHERE o_orderdate <= TIMESTAMP '{ORDERS_AS_OF}' GROUP BY o_custkey"""


@register(f"""WITH t AS ({_growth_sql(90)} UNION ALL {_growth_sql(365)})
SELECT *, {_r("(latest - baseline) / baseline * 100.0", 2)} AS growth_pct, {_r("least(0.5 + 0.1 * n_values, 0.99)", 2)} AS confidence FROM t WHERE latest IS NOT NULL AND baseline <> 0""")
def trend_growth_90_365(spark, d):
    return history.growth(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice", "o_orderkey", _at(ORDERS_AS_OF))


@register(f"""SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}') AS changes_7d, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AND ts <= TIMESTAMP '{AS_OF}') AS changes_14d, max(ts) AS last_change_at FROM events GROUP BY user_id""")
def temporal_summary(spark, d):
    return history.activity(table(spark, d, "events"), ["user_id"], "ts", _at(AS_OF), (7, 14))


_SIGNALS = {"purchase": "funding_raised", "signup": "hiring_growth", "view": "product_launch"}
_LIFETIMES = {"funding_raised": 180, "hiring_growth": 60, "product_launch": 180}
_SIGNAL_SQL = f"""WITH s AS (SELECT event_id, user_id, ts, value, CASE event_type WHEN 'purchase' THEN 'funding_raised' WHEN 'signup' THEN 'hiring_growth' WHEN 'view' THEN 'product_launch' END AS signal FROM events WHERE event_type IN ('purchase', 'signup', 'view') AND ts <= TIMESTAMP '{AS_OF}'),
a AS (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400.0 AS age, CASE signal WHEN 'hiring_growth' THEN 60.0 ELSE 180.0 END AS lifetime FROM s),
f AS (SELECT *, {_r("greatest(0.0, 1.0 - age / lifetime)", 3)} AS freshness FROM a)
"""


def _signals(spark, d) -> DataFrame:
    events = table(spark, d, "events").where(F.col("event_type").isin(*_SIGNALS) & (F.col("ts") <= _at(AS_OF)))
    named = F.create_map(*[F.lit(x) for kv in _SIGNALS.items() for x in kv])[F.col("event_type")]
    rows = events.withColumn("signal", named).withColumn("age", N.age_days(F.col("ts"), _at(AS_OF)))
    return rows.withColumn("freshness", N.linear_decay(F.col("age"), N.lookup(F.col("signal"), {k: float(v) for k, v in _LIFETIMES.items()}, 180.0)))


@register(_SIGNAL_SQL + f"SELECT event_id, signal, freshness, {_r('0.8 * freshness', 3)} AS score FROM f WHERE freshness > 0")
def signal_active_decay(spark, d):
    return _signals(spark, d).where("freshness > 0").select("event_id", "signal", "freshness", N.rnd(0.8 * F.col("freshness"), 3).alias("score"))


@register(_SIGNAL_SQL + """SELECT user_id, signal, count(*) AS n, CASE WHEN min(age) <= 30 THEN 1.0 WHEN min(age) <= 90 THEN 0.7 WHEN min(age) <= 180 THEN 0.35 ELSE 0.0 END AS recency FROM f GROUP BY user_id, signal""")
def signal_candidates(spark, d):
    return _signals(spark, d).groupBy("user_id", "signal").agg(F.count("*").alias("n"), N.step_decay(F.min("age")).alias("recency"))


@register("""SELECT event_id, CASE WHEN trim(props) = '' THEN 'empty_value' WHEN TRY_CAST(regexp_extract(props, '\\d+') AS BIGINT) IS NULL THEN 'invalid_integer' END AS reason FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, CASE WHEN TRY_CAST(props AS DOUBLE) IS NULL THEN 'invalid_decimal' END AS reason FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'invalid_json' END AS reason FROM events WHERE event_id % 3 = 2""".replace("\\\\d", "\\d"))
def observation_quarantine(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, "integer").when(F.col("event_id") % 3 == 1, "decimal").otherwise("json")
    return table(spark, d, "events").select("event_id", facts.rejected(kind, F.col("props")).alias("reason"))


@register("SELECT user_id, event_type, date_trunc('hour', ts) AS hour, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY ALL")
def hourly_idempotent_dedupe(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@register()
def fact_fold(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.col("user_id").cast("string").alias("subject"), F.when(F.col("event_type") == "click", "company.technology").otherwise(F.concat(F.lit("company."), "event_type")).alias("predicate"),
        F.floor(F.col("value") / 25).cast("string").alias("value"), (F.col("event_id") % 5).cast("string").alias("source"), F.when(F.col("event_id") % 3 == 0, "official").otherwise("third_party").alias("authority"),
        (F.lit(0.5) + (F.col("event_id") % 5) / 10.0).alias("confidence"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
    )
    return facts.fold(rows, [facts.Predicate("company.technology", "string", many=True), facts.Predicate("company.error", "string", conflict=True)])


@register(f"SELECT event_id, {_r('''least((CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 ELSE 0.5 END) * least(greatest(0.1 * (event_id % 10), 0.1), 1.0) + least((event_id % 4) * 0.04, 0.12), 0.99)''', 2)} AS confidence FROM events")
def fact_confidence(spark, d):
    e = F.col("event_id")
    source = F.element_at(F.array(*[F.lit(k) for k in facts.AUTHORITY]), (e % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", facts.confidence(source, 0.1 * (e % 10), e % 4 + 1).alias("confidence"))


# --- ranking ---

_COMPONENT_SQL = f"""WITH c AS (SELECT c_custkey AS id, c_nationkey AS account, {_r("least(1.0, greatest(0.0, c_acctbal / 10000.0))", 3)} AS fit, CASE WHEN c_custkey % 4 = 0 THEN 0.3 ELSE 1.0 END AS verified, CASE WHEN c_custkey % 9 = 0 THEN 0.35 ELSE 0.95 END AS quality,
  CAST(c_custkey % 400 AS DOUBLE) AS company_age, CAST(c_custkey % 250 AS DOUBLE) AS employment_age,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'info@firm.com' WHEN 2 THEN 'ann.lee@gmail.com' ELSE 'ann.lee@firm.com' END AS email, c_custkey % 50 = 0 AS blocked,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'MACHINERY' THEN 0.95 WHEN 'AUTOMOBILE' THEN 0.85 ELSE 0.40 END AS seniority FROM customer),
s AS (SELECT o_custkey AS id, sum({_r("CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 * 0.8 ELSE 0.5 * 0.8 END", 3)}) AS points, count(*) AS n FROM orders GROUP BY o_custkey),
p AS (SELECT c.*, CASE WHEN s.points IS NULL THEN 0.0 ELSE {_r("1.0 - 1.0 / (1.0 + " + _r("s.points", 3) + " * 1.5)", 3)} END AS signal_score, CASE WHEN coalesce(s.n, 0) = 0 THEN 0.25 ELSE 1.0 END AS timing_score,
  {_r(_r("fit * 0.55", 3) + " + " + _r("verified * 0.20", 3) + " + " + _r("quality * 0.15", 3) + " + " + _r("0.5 * 0.10", 3), 3)} AS account_score,
  {_r(_r("fit * 0.45", 3) + " + " + _r("seniority * 0.30", 3) + " + " + _r("1.0 * 0.15", 3) + " + " + _r("1.0 * 0.10", 3), 3)} AS person_score,
  CASE c.id % 4 WHEN 0 THEN 0.20 WHEN 1 THEN 0.65 WHEN 2 THEN 0.7 ELSE 1.0 END AS contact_score,
  {_r("greatest(0.2, 1.0 - greatest(company_age, employment_age) / 365.0)", 3)} AS fresh FROM c LEFT JOIN s ON s.id = c.id),
"""


def _composite_sql(name: str, p: scoring.Profile) -> str:
    total = f"account_score * {p.account}e0 + person_score * {p.person}e0 + signal_score * {p.signal}e0 + timing_score * {p.timing}e0 + contact_score * {p.contact}e0"
    penalty = "(CASE WHEN company_age > 270 THEN 0.15e0 ELSE 0e0 END + CASE WHEN employment_age > 180 THEN 0.25e0 ELSE 0e0 END) + CASE id % 4 WHEN 1 THEN 0.20e0 WHEN 0 THEN 0.15e0 ELSE 0e0 END"
    return f"""{name}_raw AS (SELECT *, CASE WHEN blocked THEN 0e0 ELSE {_r(f"least(1e0, greatest(0e0, {total} - ({penalty})))", 3)} END AS raw_score,
  CASE WHEN blocked THEN 0e0 ELSE {_r("least(1e0, greatest(0.20e0, 0.45e0 * verified + 0.35e0 * quality + 0.20e0 * fresh))", 3)} END AS confidence_factor FROM p),
{name}_final AS (SELECT *, {_r("raw_score * confidence_factor", 3)} AS final_score FROM {name}_raw),
{name} AS (SELECT *, CASE WHEN blocked THEN 'not_eligible' WHEN (fit >= 0.70 OR final_score >= 0.65) AND (company_age > 270 OR employment_age > 180) THEN 'reverify'
  WHEN quality < 0.45 OR raw_score >= 0.60 AND confidence_factor < 0.50 THEN 'research_more' WHEN final_score >= {p.priority} THEN 'priority' WHEN final_score >= {p.strong} THEN 'strong' ELSE 'possible' END AS status FROM {name}_final)"""


def _components(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    mails = F.array(*[F.lit(x) for x in ("", "info@firm.com", "ann.lee@gmail.com", "ann.lee@firm.com")])
    title = F.when(F.col("c_mktsegment") == "BUILDING", "Founder").when(F.col("c_mktsegment") == "MACHINERY", "VP").when(F.col("c_mktsegment") == "AUTOMOBILE", "Head").otherwise("Analyst")
    rows = c.select(
        k.alias("id"), F.col("c_nationkey").alias("account"), N.unit_score(F.col("c_acctbal") / 10000.0).alias("fit"), F.when(k % 4 == 0, 0.3).otherwise(1.0).alias("verified"), F.when(k % 9 == 0, 0.35).otherwise(0.95).alias("quality"),
        (k % 400).cast("double").alias("company_age"), (k % 250).cast("double").alias("employment_age"), F.element_at(mails, (k % 4 + 1).cast("int")).alias("email"), (k % 50 == 0).alias("blocked"), title.alias("title"),
    )
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "location_expansion").otherwise("other")
    signals = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(N.rnd(F.sum(scoring.signal_points(kind, F.lit(0.8))), 3).alias("points"), F.count("*").alias("n"))
    one = F.lit(1.0)
    return rows.join(signals, "id", "left").select(
        "*", scoring.account_score(F.col("fit"), F.col("verified"), F.col("quality"), F.lit(0), F.lit(0)).alias("account_score"), scoring.person_score(F.col("fit"), F.col("title"), one, one).alias("person_score"),
        scoring.signal_score(F.col("points"), F.lit(False)).alias("signal_score"), scoring.timing_score(one, one, F.col("n") * 0 + 1).alias("timing_score"),
        scoring.contactability(F.col("email"), F.lit(False), F.lit(False)).alias("contact_score"), scoring.freshness_score(F.col("company_age"), F.col("employment_age")).alias("fresh"), T.email_kind(F.col("email")).alias("mail_kind"),
    )


_SCORES = ("id", "raw_score", "confidence_factor", "final_score", "status")


@register(_COMPONENT_SQL + _composite_sql("a", scoring.PROFILES[0]) + " SELECT id, raw_score, confidence_factor, final_score, status FROM a")
def rank_composite(spark, d):
    return scoring.composite(_components(spark, d), scoring.PROFILES[0]).select(*_SCORES)


@register(_COMPONENT_SQL + _composite_sql("a", scoring.PROFILES[0]) + " SELECT id, final_score, CAST(row_number() OVER (ORDER BY final_score DESC, raw_score DESC, id) AS INT) AS rank_position FROM a ORDER BY final_score DESC, raw_score DESC, id LIMIT 50")
def rank_queue(spark, d):
    return scoring.queue(scoring.composite(_components(spark, d), scoring.PROFILES[0]), "id", 50).select("id", "final_score", "rank_position")


@register(_COMPONENT_SQL + _composite_sql("a", scoring.PROFILES[2]) + " SELECT account, id, final_score, CAST(row_number() OVER w AS INT) AS account_rank FROM a WINDOW w AS (PARTITION BY account ORDER BY final_score DESC, raw_score DESC, id) QUALIFY row_number() OVER w <= 3")
def rank_account_first_top3(spark, d):
    return scoring.best_per_account(scoring.composite(_components(spark, d), scoring.PROFILES[2]), "account", "id").select("account", "id", "final_score", "account_rank")


@register(_COMPONENT_SQL + _composite_sql("a", scoring.PROFILES[0]) + ", " + _composite_sql("b", scoring.PROFILES[1]) + f" SELECT a.id, a.final_score AS score_a, b.final_score AS score_b, {_r('b.final_score - a.final_score', 4)} AS score_delta, a.status AS status_a, b.status AS status_b, a.status <> b.status AS status_changed FROM a JOIN b ON a.id = b.id")
def profile_compare(spark, d):
    return scoring.compare(_components(spark, d), scoring.PROFILES[0], scoring.PROFILES[1], "id")


_CRITERIA = [icp.Criterion("c_mktsegment", "in", ["BUILDING", "MACHINERY"], 3.0, "boost"), icp.Criterion("c_acctbal", "gte", 1000, 2.0, "required"), icp.Criterion("c_nationkey", "range", [5, 15], 1.0), icp.Criterion("note", "exists", None, 1.0), icp.Criterion("n_name", "contains", "an", 1.0, "penalty")]
_ICP_SQL = f"""WITH t AS (SELECT c_custkey, c_nationkey, (CASE WHEN lower(c_mktsegment) IN ('building', 'machinery') THEN 4.5 ELSE 0.0 END + CASE WHEN c_acctbal >= 1000 THEN 2.4 ELSE 0.0 END + CASE WHEN c_nationkey BETWEEN 5 AND 15 THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(n_name), 'an') THEN -1.0 ELSE 0.0 END) AS earned, c_acctbal < 1000 AS failed FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT *, least(1e0, {_r("CASE WHEN failed THEN least(greatest(0e0, CAST(earned AS DOUBLE) / 8e0), 0.25e0) ELSE greatest(0e0, CAST(earned AS DOUBLE) / 8e0) END", 3)}) AS fit_score FROM t)
"""


def _icp_rows(spark, d) -> DataFrame:
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.withColumn("note", F.lit(None).cast("string"))


@register(_ICP_SQL + "SELECT c_custkey, fit_score, 1.0e0 AS data_confidence, CASE WHEN fit_score >= 0.85 THEN 'excellent_fit' WHEN fit_score >= 0.70 THEN 'strong_fit' WHEN fit_score >= 0.50 THEN 'possible_fit' ELSE 'weak_fit' END AS fit_status FROM f")
def icp_score(spark, d):
    return icp.score(_icp_rows(spark, d), _CRITERIA).select("c_custkey", "fit_score", "data_confidence", "fit_status")


@register("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'customer' WHEN c_acctbal < 0 THEN 'in_debt' WHEN c_mktsegment = 'FURNITURE' THEN 'segment' END AS exclusion FROM customer""")
def icp_exclusions(spark, d):
    listed = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return icp.exclude(table(spark, d, "customer"), "c_custkey", {"customer": listed}, [("in_debt", icp.Criterion("c_acctbal", "lt", 0)), ("segment", icp.Criterion("c_mktsegment", "equals", "furniture"))]).select("c_custkey", "exclusion")


@register("""WITH a AS (SELECT p_brand || ':' || p_type || ':' || p_size AS key, max(p_retailprice) AS w FROM part WHERE p_name < 'm' GROUP BY 1), b AS (SELECT p_brand || ':' || p_type || ':' || p_size AS key, max(p_retailprice) AS w FROM part WHERE p_name >= 'c' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, a.w AS weight_a, b.w AS weight_b, CASE WHEN a.w IS NULL THEN 'added' WHEN b.w IS NULL THEN 'removed' ELSE 'weight_changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.w IS NULL OR b.w IS NULL OR a.w <> b.w""")
def version_diff(spark, d):
    of = lambda names: table(spark, d, "part").where(names).groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("field"), F.col("p_size").cast("string").alias("operator")).agg(F.max("p_retailprice").alias("weight"))
    return icp.diff_versions(of("p_name < 'm'"), of("p_name >= 'c'"))


# --- relationships ---

#: Edges have at least this overlap.
_LEAST = 0.1
_PAIR_SQL = f"""WITH o AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM o GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS n_shared FROM o a JOIN o b ON a.i = b.i AND a.k < b.k GROUP BY 1, 2),
e AS (SELECT p.a, p.b, p.n_shared, x.n AS n_a, y.n AS n_b, {_r("p.n_shared / CAST(x.n + y.n - p.n_shared AS DOUBLE)", 3)} AS overlap FROM p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE p.n_shared / CAST(x.n + y.n - p.n_shared AS DOUBLE) >= {_LEAST})
"""


def _edges(spark, d) -> DataFrame:
    return graph.shared_pairs(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", _LEAST)


@register(_PAIR_SQL + "SELECT * FROM e")
def competitor_overlap(spark, d):
    return _edges(spark, d)


@register(_PAIR_SQL + f""", s AS (SELECT a, b, overlap, {_r("overlap * 0.35 + (CASE WHEN a % 3 = b % 3 THEN 1e0 ELSE 0.4e0 END) * 0.25 + (CASE WHEN a % 2 = b % 2 THEN 0.8e0 ELSE 0e0 END) * 0.20 + 0.5 * 0.10 + 0e0 * 0.10", 3)} AS strength, CASE WHEN a % 3 = b % 3 THEN 1e0 ELSE 0.4e0 END AS customer, CASE WHEN a % 2 = b % 2 THEN 0.8e0 ELSE 0e0 END AS market FROM e)
SELECT a, b, strength, CASE WHEN strength >= 0.60 AND overlap >= 0.30 AND (market >= 0.25 OR customer >= 0.25) THEN 'direct' WHEN strength >= 0.35 AND (customer >= 0.40 OR overlap >= 0.15 AND market >= 0.25) THEN 'adjacent' WHEN strength >= 0.30 AND market >= 0.30 AND overlap < 0.15 THEN 'substitute' WHEN strength >= 0.20 THEN 'emerging' ELSE 'unknown' END AS kind FROM s""")
def competitor_classify(spark, d):
    customer = F.when(F.col("a") % 3 == F.col("b") % 3, 1.0).otherwise(0.4)
    market = F.when(F.col("a") % 2 == F.col("b") % 2, 0.8).otherwise(0.0)
    rows = _edges(spark, d).withColumn("strength", graph.strength(market, F.col("overlap"), customer, F.lit(0.5), F.lit(0)))
    return rows.select("a", "b", "strength", graph.kind(F.col("strength"), market, F.col("overlap"), customer, F.lit(0.5)).alias("kind"))


@register(_PAIR_SQL + """, arcs AS (SELECT a AS src, b AS dst, overlap AS weight FROM e UNION ALL SELECT b, a, overlap FROM e),
near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM arcs WHERE src = 1 QUALIFY k <= 50),
far AS (SELECT * FROM arcs WHERE src IN (SELECT dst FROM near WHERE k <= 10) QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 20),
every AS (SELECT src, dst, weight, 1 AS hop FROM near UNION ALL SELECT src, dst, weight, 2 FROM far)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS weight, min(hop) AS hop FROM every GROUP BY 1, 2""")
def graph_two_hop(spark, d):
    edges = _edges(spark, d).select("a", "b", F.col("overlap").alias("weight"))
    return graph.expand(edges, spark.createDataFrame([(1,)], "node bigint"))


@register("""WITH RECURSIVE arcs AS (SELECT o_orderkey AS src, o_orderkey * 2 AS dst FROM orders UNION SELECT o_orderkey, o_orderkey + 7 FROM orders), walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT a.dst, w.depth + 1 FROM walk w JOIN arcs a ON a.src = w.node WHERE w.depth < 4)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""")
def bfs_depth(spark, d):
    o = table(spark, d, "orders")
    arcs = o.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") * 2).alias("dst")).union(o.select("o_orderkey", F.col("o_orderkey") + 7)).distinct()
    return graph.reach(arcs, spark.createDataFrame([(1,)], "node bigint"), 4)


# --- quality and verification ---


@register("""SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'quarantine' WHEN coalesce(trim(d.lang), '') = '' THEN 'quarantine' WHEN coalesce(trim(d.source), '') = '' THEN 'quarantine' ELSE 'pass' END AS status, CASE WHEN d.doc_id % 11 = 0 THEN 0.10e0 WHEN coalesce(trim(d.lang), '') = '' THEN 0e0 WHEN coalesce(trim(d.source), '') = '' THEN 0.2e0 ELSE 1e0 END AS score FROM documents d""")
def quality_gate(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", quality.ingestion_gate(F.col("lang"), F.col("doc_id"), F.col("source"), F.col("doc_id") % 11 == 0).alias("g")).select("doc_id", "g.status", "g.score")


@register(f"SELECT d.source, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (toxic = 1) AS n_toxic, {_r('count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE)', 3)} AS pass_rate FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def quality_metrics_pivot(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), N.rnd(F.count_if(F.col("quality") == 1) / F.count("*"), 3).alias("pass_rate"))


@register("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked' WHEN c_custkey % 5 = 0 THEN 'quarantine' WHEN c_custkey % 3 = 0 THEN 'reverify' ELSE 'pass' END AS status FROM customer""")
def bundle_worst_of(spark, d):
    k = F.col("c_custkey")
    gates = [F.when(F.col("c_acctbal") < 0, "blocked").otherwise("pass"), F.when(k % 5 == 0, "quarantine").otherwise("pass"), F.when(k % 3 == 0, "reverify").otherwise("pass")]
    return table(spark, d, "customer").select("c_custkey", quality.worst(*gates).alias("status"))


@register(f"""WITH x AS (SELECT c_custkey, CAST(c_custkey % 10 AS DOUBLE) / 10.0 AS i, CASE WHEN c_acctbal > 0 THEN 1e0 ELSE 0.4e0 END AS t FROM customer)
SELECT c_custkey, {_r("greatest(0e0, least(1e0, 0e0 + 0.8e0 * 0.25e0 + i * 0.25e0 + 0.7e0 * 0.2e0 + t * 0.2e0 + 1e0 * 0.1e0 - 0.05e0))", 3)} AS confidence, {_r("least(i, t, 0.8e0) * 0.4e0 + (0e0 + i + t + 0.8e0) / 3e0 * 0.6e0", 3)} AS blended FROM x""")
def verification_confidence(spark, d):
    i, t = (F.col("c_custkey") % 10).cast("double") / 10.0, F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.4)
    return table(spark, d, "customer").select("c_custkey", quality.verification_confidence(F.lit(0.8), i, F.lit(0.7), t, F.lit(1.0), F.lit(0.05)).alias("confidence"), quality.blend(F.array(i, t, F.lit(0.8))).alias("blended"))


@register("""SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_custkey % 13 = 0 THEN 'BLOCK' WHEN c_custkey % 7 = 0 THEN 'REVERIFY' WHEN c_custkey % 5 = 0 THEN 'ALLOW_WITH_RISK' ELSE 'ALLOW' END AS decision FROM customer""")
def verification_gate(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", quality.verification_gate(F.when(F.col("c_acctbal") < 0, "unreachable").otherwise("verified"), F.lit("verified"), F.when(k % 7 == 0, "stale").otherwise("verified"), F.when(k % 13 == 0, "suppressed").otherwise("verified"), k % 5 == 0, F.lit(False)).alias("decision"))


@register("""WITH a AS (SELECT o_orderkey, (epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate)) / 86400.0 AS age FROM orders) SELECT o_orderkey, CASE WHEN age / 700e0 <= 0.5 THEN 'fresh' WHEN age / 700e0 <= 1.0 THEN 'aging' WHEN age / 700e0 <= 1.5 THEN 'stale' ELSE 'expired' END AS state FROM a""")
def freshness_state(spark, d):
    return table(spark, d, "orders").select("o_orderkey", N.freshness(N.age_days(F.col("o_orderdate"), _at(ORDERS_AS_OF)), F.lit(700.0)).alias("state"))


@register("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'blocked' WHEN c_custkey % 17 = 0 THEN 'blocked' WHEN c_custkey % 6 = 0 THEN 'reverify' WHEN c_custkey % 5 = 0 THEN 'limited' WHEN c_custkey % 7 = 0 THEN 'limited' WHEN c_acctbal < 0 THEN 'reverify' ELSE 'pass' END AS status FROM customer""")
def outreach_gate(spark, d):
    k = F.col("c_custkey")
    email = F.when(k % 4 == 0, "").otherwise("ann@firm.com")
    gate = quality.outreach_gate(email, k % 17 == 0, F.when(F.col("c_acctbal") < 0, "unverified").otherwise("verified"), k % 5 == 0, k % 7 == 0, F.when(k % 6 == 0, "stale").otherwise("verified"))
    return table(spark, d, "customer").select("c_custkey", gate["status"].alias("status"))


@register("""SELECT c_custkey, least(100, (CASE c_mktsegment WHEN 'BUILDING' THEN 20 ELSE 10 END) + (CASE WHEN c_nationkey = 7 THEN 10 ELSE 0 END) + 15 + (CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 0 END) + (CASE c_custkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 10 ELSE 0 END) + (CASE WHEN c_acctbal > 0 THEN 5 ELSE 0 END) + 5 + (CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 0 END)) AS score FROM customer""")
def lead_score(spark, d):
    k = F.col("c_custkey")
    tier = F.when(k % 4 == 0, "Tier 1").when(k % 4 == 1, "Tier 2").when(k % 4 == 2, "Tier 3")
    score = scoring.lead_score(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment"), F.col("c_nationkey") == 7, F.lit(True), k % 2 == 0, tier, [F.col("c_acctbal") > 0, F.lit(True)], [k % 3 == 0])
    return table(spark, d, "customer").select("c_custkey", score.alias("score"))


# --- roll-ups ---


@register(f"SELECT CAST(quality AS VARCHAR) AS kind, count(*) AS n, {_r('count(*) FILTER (toxic = 0) / CAST(count(*) AS DOUBLE)', 3)} AS accuracy FROM labels GROUP BY quality")
def feedback_summary(spark, d):
    return rollups.feedback(table(spark, d, "labels").withColumn("k", F.col("quality").cast("string")), "k", F.col("toxic") == 0)


@register("SELECT s AS status, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('unseen')) t(s) LEFT JOIN events ON event_type = s GROUP BY s")
def queue_depth_zero_filled(spark, d):
    return rollups.counts_by_status(table(spark, d, "events"), "event_type", ("click", "error", "purchase", "signup", "view", "unseen"))


@register("""WITH w AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = least(CAST(floor(n * 0.5e0) AS BIGINT), n - 1)) AS p50, max(value) FILTER (i = least(CAST(floor(n * 0.95e0) AS BIGINT), n - 1)) AS p95, max(value) FILTER (i = least(CAST(floor(n * 0.99e0) AS BIGINT), n - 1)) AS p99 FROM w GROUP BY event_type""")
def latency_percentiles(spark, d):
    return rollups.nearest_rank(table(spark, d, "events"), "event_type", "value")


@register(f"""WITH w AS (SELECT event_id, sum(1 + event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events)
SELECT event_id, {_r("spent", 2)} AS spent, CASE WHEN spent / 150e0 > 1.0 THEN 'stopped' WHEN spent / 150e0 >= 0.80 THEN 'light' WHEN spent / 150e0 >= 0.60 THEN 'standard' ELSE 'full' END AS mode FROM w""")
def budget_cumulative_degrade(spark, d):
    return rollups.budget(table(spark, d, "events"), "user_id", "event_id", 1 + F.col("event_id") % 5, 150.0).select("event_id", "spent", "mode")


@register("""WITH s(place, stage) AS (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')), r AS (SELECT DISTINCT user_id FROM events)
SELECT CAST(r.user_id AS VARCHAR) AS run_id, (SELECT min_by(s.stage, s.place) FROM s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = r.user_id AND e.event_type = s.stage AND e.value > 150)) AS stage FROM r""")
def resume_stage(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"), F.when(F.col("value") > 150, "completed").otherwise("failed").alias("status"))
    return rollups.resume_stage(rows, ("click", "error", "purchase", "signup", "view"))


@register("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rate_limit_window(spark, d):
    return rollups.sliding_rate(table(spark, d, "events"), "user_id", "ts", 3600, 3).select("event_id", "in_window")


@register("SELECT user_id, event_id, CAST(row_number() OVER w AS INT) AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) QUALIFY row_number() OVER w <= 50")
def ring_buffer_50(spark, d):
    return rollups.last_of_each(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "place")


@register("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND value >= 50 GROUP BY ROLLUP (user_id, event_type)")
def rollup_counts(spark, d):
    return table(spark, d, "events").where("event_type IN ('click', 'view') AND value >= 50").rollup("user_id", "event_type").agg(F.count("*").alias("n"))


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    orders = table(spark, d, "orders")
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey").exceptAll(orders.where("o_orderstatus = 'F'").select("o_custkey").distinct())


@register("SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100e0 AS total FROM events GROUP BY ALL")
def tumbling_events(spark, d):
    rows = streams.tumbling(table(spark, d, "events"), "1 day", ["user_id", "event_type"])
    return rows.withColumn("total", N.rnd(F.col("total"), 2))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    return streams.sessions(table(spark, d, "events"), "2 hours", "user_id")


@register("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, floor(list_cosine_similarity(q.v, e.v) * 1e4 + 0.5) / 1e4 AS similarity FROM e q, e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, similarity FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""")
def embedding_cosine_topk(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 10)


@register("SELECT n_name, count(*) AS n_leads, count(*) FILTER (c_acctbal >= 5000) AS n_large FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def leads_by_place(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_leads"), F.count_if(F.col("c_acctbal") >= 5000).alias("n_large"))


@register("SELECT l_returnflag, l_linestatus, count(*) AS n, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= _at("1998-09-02 00:00:00"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.floor(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) + 0.5).cast("double").alias("revenue"))


@register("""WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL), nxt AS (SELECT a.user_id, a.ts, min(b.ts) AS next_ts FROM e a JOIN e b ON a.user_id = b.user_id AND a.ts + INTERVAL 2 HOUR <= b.ts GROUP BY ALL),
walk AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT w.user_id, n.next_ts FROM walk w JOIN nxt n ON n.user_id = w.user_id AND n.ts = w.ts)
SELECT v.event_id, v.user_id, v.ts, w.ts IS NOT NULL AND v.event_id = e.event_id AS dispatched FROM events v JOIN e ON e.user_id = v.user_id AND e.ts = v.ts LEFT JOIN walk w ON w.user_id = v.user_id AND w.ts = v.ts""")
def throttled_alerts(spark, d):
    return rollups.throttle(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 7200, "event_id")


# --- extraction and the nightly run ---


@register(r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\+?\d[\d\-\s().]{6,16}\d)', 1)) AS raw FROM documents), d AS (SELECT doc_id, regexp_replace(raw, '[^0-9+]', '', 'g') AS x FROM f WHERE length(regexp_replace(raw, '[^0-9]', '', 'g')) BETWEEN 7 AND 15),
n AS (SELECT doc_id, CASE WHEN starts_with(x, '00') THEN '+' || substr(x, 3) WHEN starts_with(x, '0') AND length(x) = 11 THEN '+91' || substr(x, 2) WHEN length(x) = 10 AND NOT starts_with(x, '+') THEN '+91' || x ELSE x END AS phone FROM d)
SELECT DISTINCT doc_id, phone FROM n WHERE length(phone) >= 7""")
def phone_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(extract.phones(F.col("text"))).alias("phone"))


@register("""SELECT page_id, regexp_matches(lower(html), 'add to cart|checkout|shopify|woocommerce') AS has_shop, regexp_matches(lower(html), 'catalogue|catalog|brochure') AS has_catalogue, regexp_matches(lower(html), 'wa\\.me|api\\.whatsapp\\.com') AS has_chat, contains(lower(html), '<form') AS has_form, contains(lower(html), '<script') AS has_script FROM pages""")
def digital_presence(spark, d):
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in extract.presence(F.col("html")).items()])


@register("SELECT page_id, length(trim(html)) < 150 OR " + " OR ".join(f"contains(lower(html), '{t}')" for t in extract.CHALLENGES) + " AS is_challenge FROM pages")
def challenge_pages(spark, d):
    return table(spark, d, "pages").select("page_id", extract.challenge(F.col("html")).alias("is_challenge"))


@register("""SELECT c_custkey, list_transform(list_sort(list({'k': o_orderkey, 's': o_orderstatus})), lambda o: o.k || o.s) AS children FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def child_hydrate(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    full = pipeline.hydrate(table(spark, d, "customer").select("c_custkey"), "c_custkey", {"orders": orders}, "o_orderkey").where("orders IS NOT NULL")
    return full.select("c_custkey", F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), o["o_orderstatus"])).alias("children"))


@register(f"""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 60 DAY)""")
def fresh_skip(spark, d):
    seen = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return pipeline.not_fresh(table(spark, d, "customer").select("c_custkey"), seen, "c_custkey", "o_orderdate", _at(ORDERS_AS_OF), 60)


@register(f"""SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'P0' WHEN c_acctbal / 10000 >= 0.8 OR c_custkey % 6 = 0 THEN 'P1' WHEN c_custkey % 3 = 0 THEN 'P2' ELSE 'P3' END AS tier FROM customer""")
def priority_tiers(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", pipeline.priority(k % 20 == 0, F.lit(False), F.col("c_acctbal") / 10000, k % 6 == 0, k % 3 == 0).alias("tier"))


@register(f"""SELECT o_orderkey, (epoch(TIMESTAMP '{ORDERS_AS_OF}') - epoch(o_orderdate)) / 86400.0 >= 700 AS is_stale FROM orders""")
def refresh_candidates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", pipeline.stale(F.col("o_orderdate"), _at(ORDERS_AS_OF), F.lit(700)).alias("is_stale"))


@register("""SELECT event_type AS model, count(*) AS calls, floor(sum(event_id % 1000 / 1e6 * CASE event_type WHEN 'click' THEN 0.5e0 ELSE 0.2e0 END + event_id % 300 / 1e6 * CASE event_type WHEN 'click' THEN 1.5e0 ELSE 0.8e0 END) * 1e4 + 0.5) / 1e4 AS usd FROM events GROUP BY event_type""")
def cost_rollup(spark, d):
    price = N.cost(F.col("event_type"), F.col("event_id") % 1000, F.col("event_id") % 300, {"click": (0.5, 1.5)})
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), N.rnd(F.sum(price), 4).alias("usd"))


@register("""SELECT user_id, began, last_beat, beats FROM (SELECT user_id, lease, min(ts) AS began, max(ts) AS last_beat, count(*) AS beats FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS lease FROM (SELECT user_id, ts, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) <= 7200 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, lease)""")
def worker_leases(spark, d):
    return rollups.leases(table(spark, d, "events"), "user_id", "ts", 7200).select("user_id", "began", "last_beat", "beats")


@register()
def circuit_breaker(spark, d):
    calls = table(spark, d, "events").select("event_id", "event_type", "ts", (F.col("value") > 20).alias("ok"))
    return pipeline.circuit(calls, "event_type", "ts", "ok")


@register("""SELECT n_name, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), 'nation_1') AND c_acctbal >= 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def lead_filter(spark, d):
    rows = table(spark, d, "customer").where((F.col("c_acctbal") >= 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return rows.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where(F.lower("n_name").contains("nation_1")).select("n_name", "c_custkey", "c_acctbal")


@register("""SELECT p.n_name AS customer_nation, s.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation p ON c_nationkey = p.n_nationkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2""")
def relationship_volume(spark, d):
    nation = table(spark, d, "nation")
    named = lambda key, name: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = pairs.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return pairs.join(named("c_nationkey", "customer_nation"), "c_nationkey").join(named("s_nationkey", "supplier_nation"), "s_nationkey").groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("n"))
