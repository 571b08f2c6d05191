"""Set-level operators on small tables."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from vantor.functions import markup
from vantor.operators import extract, facts, graph, history, icp, identity, pages, pipeline, resolution, rollups, search, vectors
from vantor.sources import tables
from vantor.streaming import events as streams

T0 = dt.datetime(2026, 1, 1)


def test_fold_keeps_conflicts_and_sources(spark):
    rows = [
        ("c1", "p", "a", "s1", "official", 0.8, T0, 1), ("c1", "p", "a", "s2", "third_party", 0.5, T0, 2), ("c1", "p", "b", "s3", "third_party", 0.9, T0, 3), ("c1", "p", "b", "s3", "official", 0.9, T0, 4),
        ("c1", "m", "x", "s1", "third_party", 0.5, T0, 5), ("c1", "m", "y", "s1", "third_party", 0.5, T0, 6),
    ]
    frame = spark.createDataFrame(rows, "subject string, predicate string, value string, source string, authority string, confidence double, at timestamp, seq long")
    got = {(r.predicate, r.value): (r.status, r.confidence, r.n_sources, r.n_conflicts) for r in facts.fold(frame, [facts.Predicate("m", "string", many=True)]).collect()}
    assert got == {("p", "b"): ("active", 0.9, 1, 1), ("m", "x"): ("active", 0.5, 1, 0), ("m", "y"): ("active", 0.5, 1, 0)}


def test_redirects_stop_at_cycles(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("x", "y", 1), ("y", "x", 1), ("a", "z", 0)], "source string, target string, at int")
    got = {r.source: r.target for r in resolution.follow_redirects(rows).collect()}
    assert got["a"] == "c" and got["b"] == "c" and got["x"] == "y" and got["y"] == "x"


def test_pairs_are_symmetric_and_distinct(spark):
    rows = spark.createDataFrame([(1, "acme"), (2, "acme"), (3, "acmee"), (4, "zzz")], "id int, k string")
    pairs = resolution.candidate_pairs(rows, "id", resolution.blocking_keys(F.lit(""), F.col("k"))).collect()
    assert sorted((p.a, p.b) for p in pairs) == [(1, 2), (1, 3), (2, 3)]


def test_merge_takes_first_known_values(spark):
    rows = spark.createDataFrame([(1, "a.com", None, "x"), (2, "a.com", "+1", "y"), (3, None, "+1", "x")], "n int, domain string, phone string, found string")
    got = {r.dedupe_key: r for r in resolution.merge_by_priority(rows, [F.col("domain"), F.col("phone")], "n", ["phone"], ["found"]).collect()}
    assert got["a.com"].phone == "+1" and got["a.com"].founds == ["x", "y"] and got["+1"].n_merged == 1


def test_state_as_of(spark):
    rows = spark.createDataFrame([("c", 120, dt.datetime(2026, 1, 1), 1), ("c", 180, dt.datetime(2026, 6, 1), 2)], "k string, v int, ts timestamp, n int")
    at = lambda m: history.state_as_of(rows, ["k"], "ts", "n", F.lit(dt.datetime(2026, m, 1)), ["v"]).first().v
    assert at(3) == 120 and at(9) == 180
    change = history.changes(rows, ["k"], "ts", "v", "n").first()
    assert (change.delta, change.pct) == (60.0, 50.0)


def test_set_changes(spark):
    frame = spark.createDataFrame([(["SAP", "Oracle"], ["Oracle"]), (["Oracle"], ["Oracle", "SAP"])], "a array<string>, b array<string>")
    got = [[(x.event, x.value) for x in r[0]] for r in frame.select(history.set_changes(F.col("a"), F.col("b"), "technology")).collect()]
    assert got == [[("technology_removed", "SAP")], [("technology_added", "SAP")]]


def test_unknown_values_lower_confidence(spark):
    frame = spark.createDataFrame([("x", None), ("y", 5.0)], "a string, b double")
    got = icp.score(frame, [icp.Criterion("a", "equals", "x", 2.0, "required"), icp.Criterion("b", "gt", 3)]).orderBy("a").collect()
    assert got[0].fit_score == 0.8 and got[0].data_confidence == 0.775
    assert got[1].fit_score == 0.25 and got[1].data_confidence == 1.0


def test_expand_is_bounded(spark):
    edges = spark.createDataFrame([(1, i, 1.0 / i) for i in range(2, 30)], "a int, b int, weight double")
    assert graph.expand(edges, spark.createDataFrame([(1,)], "node int"), depth=1, first=5).count() == 5


def test_throttle_counts_from_dispatched(spark):
    rows = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s)) for s in (0, 100, 299, 301, 500, 700)], "k string, ts timestamp")
    got = [r.dispatched for r in rollups.throttle(rows, "k", "ts").orderBy("ts").collect()]
    assert got == [True, False, False, True, False, True]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("name,website\nA,www.foo.com/x\nB,https://foo.com\nC,bar.org\n")
    assert [r.url for r in tables.csv_seeds(spark, str(tmp_path / "seeds.csv")).collect()] == ["https://www.foo.com/x", "https://bar.org"]
    (tmp_path / "seeds.txt").write_text("# list\n\nfoo.com\nhttps://bar.org\n")
    assert [r.host for r in tables.text_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["foo.com", "bar.org"]
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tables.write_jsonl(frame, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    again = [[r.idempotency_key for r in tables.push_batches(f, "job", "k", 10).collect()] for f in (frame, frame.orderBy(F.desc("k")))]
    assert again[0] == again[1]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u" + str(i % 2), T0 + dt.timedelta(minutes=10 * i), 1.0) for i in range(30)], "event_id int, user_id string, ts timestamp, value double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), rows.schema)
    query = streams.once_an_hour(stream, [F.col("user_id")]).select("event_hash").writeStream.format("memory").queryName("hourly").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hourly").distinct().count() == streams.once_an_hour(rows, [F.col("user_id")]).count()
    query = streams.tumbling(stream, "1 hour", ["user_id"]).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, streams.tumbling(rows, "1 hour", ["user_id"]).collect()))


def test_extraction(spark):
    frame = spark.createDataFrame([('<a href="https://www.linkedin.com/company/Acme"></a><script type="application/ld+json">{"a": 1}</script>', "Sure: ```json\n{'x': None, \"y\": [1,],}\n```", "1 Main St,  Springfield , 12345", "User-agent: *\nDisallow: /private\nUser-agent: bad\nDisallow: /\nSitemap: https://a.b/s.xml")], "html string, answer string, address string, robots string")
    got = frame.select(
        extract.profiles(F.col("html")).alias("p"), F.size(extract.json_ld(F.col("html"))).alias("n"), extract.json_block(F.col("answer")).alias("j"), extract.address_parts(F.col("address")).alias("a"), extract.robots(F.col("robots")).alias("r"), extract.phones(F.lit("call 98765 43210 or +1 415 555 0100")).alias("t"),
    ).first()
    assert [tuple(x) for x in got.p] == [("linkedin", "acme")] and got.n == 1
    assert got.j == "{'x': null, \"y\": [1]}"
    assert tuple(got.a) == ("1 Main St, Springfield, 12345", "Springfield", "12345")
    assert got.r.disallow == ["/private"] and got.r.sitemaps == ["https://a.b/s.xml"]
    assert got.t == ["+919876543210", "+14155550100"]


def test_circuit_opens_and_tries_again(spark):
    calls = [("m", T0 + dt.timedelta(seconds=s), ok) for s, ok in [*((i, False) for i in range(5)), (6, True), (40, True), (41, True)]]
    got = [r.state for r in pipeline.circuit(spark.createDataFrame(calls, "m string, ts timestamp, ok boolean"), "m", "ts", "ok").orderBy("ts").collect()]
    assert got == ["closed"] * 5 + ["open", "half_open", "closed"]


def test_keep_first_is_sequential(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["", None, *"abcdef"]), r.choice(["", *"uvwxyz"]), f"{r.randrange(30)}") for i in range(150)]
    seen, kept = [set(), set(), set()], []
    for i, *keys in rows:
        known = [k for k in keys]
        if not any(k and k in s for k, s in zip(known, seen, strict=True)):
            kept.append(i)
            for k, s in zip(known, seen, strict=True):
                if k:
                    s.add(k)
    frame = spark.createDataFrame(rows, "i int, a string, b string, c string")
    assert sorted(x.i for x in identity.keep_first(frame, "i", [F.col("a"), F.col("b"), F.col("c")]).collect()) == kept


def test_pairs_of_a_least_overlap_are_exact(spark, monkeypatch):
    monkeypatch.setattr(graph, "DIRECT", 0)
    r = random.Random(6)
    sets = {k: {r.randrange(40) for _ in range(r.randrange(1, 20))} | {99} for k in range(40)}  # all have one item
    frame = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "k int, i int")
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    for least in (0.0, 0.2, 0.5):
        got = {(x.a, x.b): x.n_shared for x in graph.shared_pairs(frame, "k", "i", least).collect()}
        assert got == {(a, b): n for (a, b), n in want.items() if n and n / len(sets[a] | sets[b]) >= least}


def test_reach_stops_where_nothing_is_new(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    got = {x.node: x.depth for x in graph.reach(arcs, spark.createDataFrame([(1,)], "node long"), 50).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_selectors():
    root = markup.parse("""<html><head><title> A &amp; B </title></head><body><div id="x" class="card big"><a href="/one">One <b>1</b></a><p>p1<p>p2</div>
        <ul><li><a href='/two' data-k="v">Two</a><li>plain</ul><script>no</script></body>""")
    for path, want in {
        "title::text": ["A & B"], "div.card > a::attr(href)": ["/one"], "#x p": ["p1", "p2"], "body > a": [], "ul a[data-k=v]::text": ["Two"], "a[href^='/t']": ["Two"], "li": ["Two", "plain"],
        "//div[@id='x']/a/@href": ["/one"], "//a/text()": ["One", "Two"], "//li[2]": ["plain"], "//a[contains(@href,'tw')]": ["Two"], ".none": [], "b, title": ["1", "A & B"],
    }.items():
        assert markup.select(root, path) == want, path
    assert markup.select(markup.parse(""), "a") == [] and markup.parse("<a" * 3000)


def test_selectors_without_decoding():
    html = """<title>&quot;a&quot; &amp;amp; &lt</title><a href="/x?a&amp;b">&#65;</a><script>1 &amp;&amp; 2 & 3</script>"""
    for decode, want in ((True, ['"a" &amp; <', "/x?a&b", "A"]), (False, ["&quot;a&quot; &amp;amp; &lt", "/x?a&amp;b", "&#65;"])):
        root = markup.parse(html, decode)
        assert [v for s in ("title::text", "a::attr(href)", "a") for v in markup.select(root, s)] == want
        assert markup.select(root, "script::text") == ["1 &amp;&amp; 2 & 3"]


def test_snippet_of_a_long_text(spark):
    """Before, the words of a text were taken apart again for each of its words."""
    text = "word " * 30_000 + "the License, " + "after " * 40
    frame = spark.createDataFrame([(0, text), (1, "word " * 30_000), (2, None), (3, "")], "i int, t string").coalesce(1)
    began = time.monotonic()
    shown = [r[0] for r in frame.orderBy("i").select(search.snippet(F.col("t"), ("license",), 8, F.lit("none"))).collect()]
    assert shown == ["word the <mark>License,</mark> " + " ".join(["after"] * 5), "none", "none", "none"]
    assert time.monotonic() - began < 60


def test_cards_and_features(spark):
    html = "<div class='Team-member'><h3>Ann Lee</h3><span>Co-Founder &amp; CEO</span></div><div class=profile>Bo Ray <i>Store Manager</i></div><h2>Short</h2><h2>What the product does for you</h2><h3>Our cookie rules are long</h3>"
    got = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(markup.contact_cards("h").alias("c"), markup.features("h").alias("f")).collect()
    assert [(c.name, c.title, c.tier) for c in got[0].c] == [("Ann Lee", "Founder", "Tier 1"), ("Bo Ray", "Store Manager", "Tier 2")]
    assert got[0].f == ["What the product does for you"] and got[1].c == [] and got[2].f == []


def test_links_keep_fragments_quotes_and_folders(spark):
    html = """<a href="/a#top">x</a><A class=b href='c.html'>y</A><a href=//o.org/d>z</a><a href="#only">n</a><a href="mailto:x@y.z">m</a><a href="?q=1">q</a><a href="http://p.net/e">e</a>"""
    rows = pages.link_rows(spark.createDataFrame([(1, "https://www.s.com/f/g?h", html)], "i int, u string, h string"), "i", "u", "h").orderBy("place").collect()
    assert [x.to_url for x in rows] == ["https://www.s.com/a", "https://www.s.com/f/c.html", "https://o.org/d", "https://www.s.com/f/g?q=1", "http://p.net/e"]
    assert pages.frontier(pages.link_rows(spark.createDataFrame([(1, "https://s.com/", '<a href="/about-us">x</a><a href="/z">')], "i int, u string, h string"), "i", "u", "h")).count() == 1


def test_search_with_stems_phrases_and_upserts(spark):
    rows = [(1, "a.org", "Running shoes", "", "He was running in new shoes. The résumé."), (2, "b.org", "Runs", "", "Nothing runs here"), (3, "www.a.org", None, None, "new running"), (4, "c.org", "", "", None)]
    docs = spark.createDataFrame(rows, "id int, domain string, title string, description string, content string")
    index = search.build_index(docs, "id", {f: F.col(f) for f in search.FIELDS}, stems=True, shards=4)
    ids = lambda q, **o: sorted(r.id for r in search.matches(index, search.parse_query(q), **o).collect())
    assert ids("runs") == [1, 2, 3] and ids('"running shoes"') == [1] and ids("running site:a.org") == [1, 3] and ids("running NOT shoe") == [2, 3]
    assert ids("resume OR nothing") == [1, 2] and ids("missing") == [] and ids("new shoes", domain="a.org") == [1] and ids("") == []
    assert index.n == 4 and [r.id for r in search.browse(index, "len", limit=1).collect()] == [1]
    old, new = docs.select("id", "domain"), spark.createDataFrame([(9, "b.org"), (1, "z.org")], "id int, domain string")
    assert sorted((r.id, r.domain) for r in search.upsert(old, new, "id", "domain").collect()) == [(1, "z.org"), (3, "www.a.org"), (4, "c.org"), (9, "b.org")]
    links = spark.createDataFrame([("a/1", "a", "b/1", "b", "first")], "from_url string, from_domain string, to_url string, to_domain string, anchor string")
    found = spark.createDataFrame([("a/1", "a", "b/1", "b", "again"), ("c/1", "c", "b/2", "b", ""), ("b/3", "b", "b/2", "b", "")], links.schema)
    every, counted = search.upsert_links(links, found, spark.createDataFrame([("b", 0), ("q", 7)], "domain string, inbound_links long"))
    assert every.count() == 3 and every.where("anchor = 'first'").count() == 1 and {r.domain: r.inbound_links for r in counted.collect()} == {"b": 2, "q": 7}


def test_presence_and_caches(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("b", 5), ("c", 1)], "k string, p int")
    got = sorted((r.k, r.period, r.event) for r in rollups.presence_changes(rows, "k", "p").collect())
    assert got == [("a", 1, "appeared"), ("a", 3, "disappeared"), ("a", 5, "reappeared"), ("b", 5, "appeared"), ("c", 1, "appeared"), ("c", 2, "disappeared")]
    entries = spark.createDataFrame([("a", T0, 1), ("a", T0 + dt.timedelta(seconds=50), 2), ("b", T0 - dt.timedelta(seconds=500), 3)], "k string, t timestamp, v int")
    assert [(r.k, r.v) for r in rollups.cached(entries, ["k"], "t", F.lit(T0 + dt.timedelta(seconds=60)), 100).collect()] == [("a", 2)]


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 1)
    monkeypatch.setattr(vectors, "ROWS", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 1.0])], "i long, v array<float>").repartition(3)
    got = {(r.query_id, r.i): r.similarity for r in vectors.nearest(rows.where("i in (1, 3)"), rows, "i", "v", 2).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (3, 3): 1.0, (3, 6): 0.7071}
    assert vectors.nearest(rows.limit(0), rows, "i", "v", 2).count() == 0


def test_content_backup_and_migration(spark, tmp_path):
    pages_ = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "k string, html string")
    path = f"file://{tmp_path}/store"
    first = tables.write_content(pages_, path, ["k"], "html").collect()
    assert len({r.object_key for r in first}) == 2 and spark.read.parquet(path).count() == 2
    tables.write_content(pages_, path, ["k"], "html").collect()
    assert spark.read.parquet(path).count() == 2
    tables.backup({"p": pages_}, f"file://{tmp_path}/b")
    assert tables.restore(spark, f"file://{tmp_path}/b", ["p"])["p"].count() == 3
    old = spark.createDataFrame([("Acme Inc", "https://acme.com"), ("ACME", "www.acme.com/x"), ("Other", None), ("", "z.com")], "n string, w string")
    companies, domains = tables.migrate_companies(old, "n", "w")
    assert sorted((r.primary_domain or "", r.n_merged) for r in companies.collect()) == [("", 1), ("acme.com", 2)] and domains.count() == 1
