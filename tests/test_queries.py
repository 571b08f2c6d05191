"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vantor.plans import catalog, entities  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x.isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DATA)
    rows = frame.collect()
    assert frame.columns
    if name in catalog.SQL:
        found = duck.execute(catalog.SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(frame.columns)
        place = [names.index(c) for c in frame.columns]
        want = sorted((tuple(norm(r[i]) for i in place) for r in found.fetchall()), key=repr)
        assert sorted((tuple(map(norm, r)) for r in rows), key=repr) == want


def test_css_select_of_references(spark, tmp_path):
    """Titles with references that the SQL leaves as they are, pages without a title or links, and no page at all."""
    pages = ["<title>a &amp; b &quot;c&quot; d &amp</title><p><nav><a href=\"/x?1&amp;2\">x</a></nav>", "<p>none", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = entities.css_select(spark, str(tmp_path)).orderBy("page_id").toArrow()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"select * from ({catalog.SQL['css_select']}) order by page_id").fetchall()
    assert [tuple(r.values()) for r in got.to_pylist()] == want
