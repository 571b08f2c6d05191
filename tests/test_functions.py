"""Literal expectations of the column functions."""

import pytest
from pyspark.sql import functions as F

from vantor.functions import numeric as N
from vantor.functions import stemming
from vantor.functions import text as T
from vantor.operators import facts, history, quality, scoring, search


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], ["i", *"abcdef"[: len(rows[0]) if isinstance(rows[0], tuple) else 1]]).orderBy("i").select(column).collect()]


def test_company_names(spark):
    given = ["Siemens AG & Co. KG", "Delivery Hero SE & Co. KGaA", "Acme Pvt. Ltd.", "Foo-Bar, Inc.", "Ltd", "Plain Name"]
    assert values(spark, given, T.company_name(F.col("a"))) == ["siemens", "delivery hero", "acme", "foo bar", "ltd", "plain name"]


def test_person_names(spark):
    given = ["Dr. Rahul K. Sharma", "  Ms Ann   Lee ", "Cher"]
    assert values(spark, given, F.lower(T.person_name(F.col("a")))) == ["rahul k. sharma", "ann lee", "cher"]
    assert values(spark, given, T.first_name(F.col("a"))) == ["Rahul", "Ann", "Cher"]
    assert values(spark, given, T.last_name(F.col("a"))) == ["K. Sharma", "Lee", ""]


def test_hosts(spark):
    given = ["http://uk.store.example.com/", "SUBDOMAIN.CO.UK", "https://www.a.b.co.in:8080/x?y", "x.gen.in"]
    assert values(spark, given, T.host(F.col("a"))) == ["uk.store.example.com", "subdomain.co.uk", "a.b.co.in", "x.gen.in"]
    assert values(spark, given, T.registrable(F.col("a"))) == ["example.com", "subdomain.co.uk", "b.co.in", "x.gen.in"]
    assert values(spark, given, T.registrable_by_rule(F.col("a"))) == ["example.com", "subdomain.co.uk", "b.co.in", "gen.in"]


def test_urls(spark):
    assert values(spark, ["HTTPS is not this", "https://www.Foo.com/A/b/?x=1#y", "foo.com/"], T.url(F.col("a")))[1:] == ["https://foo.com/A/b", "https://foo.com"]
    assert values(spark, ["https://x.com/a", "https://yelp.com/b", "https://foo.com/blog/c", "https://foo.com/d"], T.site_kind(F.col("a"))) == ["social_profile", "directory", "article", "company_website"]
    assert values(spark, ["https://a.com/", "https://a.com/about-us", "https://a.com/x"], T.page_kind(F.col("a"), F.lit("Our Team"))) == ["homepage", "about", "leadership"]


def test_phones(spark):
    given = ["98765 43210", "0044 20 7946 0000", "09876543210", "12-34", "+1 (415) 555-0100"]
    assert values(spark, given, T.phone(F.col("a"))) == ["+919876543210", "+442079460000", "+919876543210", None, "+14155550100"]
    assert values(spark, given, T.country_code(F.col("a"))) == ["+91", "+44", "+91", "+91", "+1"]


def test_emails(spark):
    assert values(spark, ["a@b.com", "info@b.com", "x@gmail.com", "no", ""], T.email_kind(F.col("a"))) == ["corporate", "role", "free", "invalid", "missing"]
    assert values(spark, ["Mail A@b.com or a@B.com, c@d.io"], T.emails(F.col("a"))) == [["a@b.com", "c@d.io"]]
    assert values(spark, ["a@b.com c@example.com"], T.emails(F.col("a"), ("example",))) == [["a@b.com"]]


def test_folding_and_ratio(spark):
    assert values(spark, ["Café Zürich"], T.fold_unicode("a")) == ["Cafe Zurich"]
    assert values(spark, [("abcd", "bcde"), ("", "x")], T.sequence_ratio("a", "b")) == [0.75, 0.0]


def test_numbers(spark):
    assert values(spark, [2.675, 0.0005], N.rnd(F.col("a"), 2)) == [2.68, 0.0]
    assert values(spark, [10, 60, 100, 181], N.step_decay(F.col("a"))) == [1.0, 0.7, 0.35, 0.0]
    assert values(spark, [1.0, 2.0, 3.0, 4.0], N.freshness(F.col("a"), F.lit(2.0))) == ["fresh", "aging", "stale", "expired"]


def test_fact_values(spark):
    got = values(spark, ["50-200 employees", "10+", "1,500", "none"], facts.employee_range(F.col("a")))
    assert [(g and (g["min"], g["max"])) for g in got] == [(50, 200), (10, None), (1500, 1500), None]
    money = values(spark, ["₹10-50 Cr", "$2.5M"], facts.money(F.col("a")))
    assert [(m["min"], m["max"], m["currency"]) for m in money] == [(1e8, 5e8, "INR"), (2.5e6, 2.5e6, "USD")]
    assert values(spark, [("integer", "1,500"), ("integer", "not-a-number"), ("email", "x"), ("json", "{}")], facts.rejected(F.col("a"), F.col("b"))) == [None, "invalid_integer", "invalid_email", None]


def test_significance(spark):
    rows = [("technology_added", None, 10.0, 1.0), ("technology_added", "company.headquarters", 60.0, 1.0), ("x", None, 60.0, 0.4)]
    frame = spark.createDataFrame(rows, "a string, b string, c double, d double")
    assert [r[0] for r in frame.select(history.significance(*(F.col(c) for c in "abcd"))).collect()] == ["medium", "critical", "medium"]


def test_scores(spark):
    assert values(spark, ["VP Sales", "intern", "Director", ""], scoring.seniority(F.col("a"))) == [0.95, 0.40, 1.0, 0.5]
    assert values(spark, ["Director"], scoring.seniority(F.col("a"), whole_words=True)) == [0.85]
    assert values(spark, [("verified", "stale"), ("invalid", "stale"), ("verified", "current")], quality.verification_gate(F.col("a"), F.lit("verified"), F.col("b"), F.lit("verified"), F.lit(False), F.lit(False))) == ["REVERIFY", "BLOCK", "ALLOW"]


def test_query_parser():
    q = search.parse_query('site:foo.com "AI product studio" python NOT java react OR vue')
    assert q.domain == "foo.com" and q.units == (("ai", "product", "studio"), ("python",), ("java",), ("react",), ("vue",))
    assert q.tree == ("OR", ("AND", ("AND", 0, ("NOT", 1, 2)), 3), 4)
    assert search.parse_query("résumé-forge").units == (("resume", "forge"),)
    assert search.parse_query("github.com/trending").domain == "github.com" and search.parse_query("github.com/trending").units == (("trending",),)
    assert search.parse_query("https://a.org/x-y").units == (("x",), ("y",)) and search.parse_query("www.a.org OR").tree is not None
    assert search.parse_query("").tree is None and search.parse_query("NOT").tree is None and search.parse_query("a -b").tree == ("NOT", 0, 1)


def test_stems():
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "rate": "rate", "cease": "ceas", "controlling": "control", "sky": "sky", "été": "été"}
    assert {w: stemming.stem(w) for w in words} == words


@pytest.mark.parametrize("column", [T.host, T.url, T.phone, T.company_name])
def test_normalizers_are_stable(spark, column):
    once = column(F.col("a"))
    given = ["https://www.Foo.com/a", "Acme GmbH & Co. KG", "+49 30 1234567", ""]
    for a, b in zip(values(spark, given, once), values(spark, given, column(once)), strict=True):
        assert a == b
