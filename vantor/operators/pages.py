"""Web pages: links, metadata, contact details, site audits and authority from landed HTML."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from vantor.functions.numeric import authority
from vantor.functions.text import host, url_path

#: The target of a link in double, single or no quotes, without its fragment.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>#]+)"""
DROPPED = frozenset({"script", "style", "noscript", "svg", "header", "footer", "nav", "aside", "form"})


def hrefs(html: Column) -> Column:
    """Targets of links in order, without those of scripts, mail and phones."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.filter(found, lambda h: ~F.lower(h).rlike("^(javascript|mailto|tel|data):"))


def title(html: Column) -> Column:
    """The title, else the first heading."""
    clean = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, p, 1), r"<[^>]+>|\s+", " ")), F.lit(""))
    return F.coalesce(clean(r"(?is)<title[^>]*>(.*?)</title>"), clean(r"(?is)<h1[^>]*>(.*?)</h1>"))


def link_rows(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """One row for each link, with absolute targets: of the scheme, of the site, or of the folder that the page is in."""
    u, h = F.col("from_url"), F.col("href")
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("from_url"), F.posexplode(hrefs(F.col(html))).alias("place", "href"))
    scheme, site = F.regexp_extract(u, "^(?i)(https?:)", 1), F.regexp_extract(u, r"^(?i)(https?://[^/?#]+)", 1)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(u, r"^(?i)https?://[^/?#]+(/[^?#]*/|/)", 1), F.lit("")), F.lit("/")))
    target = (
        F.when(h.rlike("^(?i)https?://"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(site, h))
        .when(h.startswith("?"), F.concat(F.regexp_extract(u, "^([^?#]*)", 1), h)).otherwise(F.concat(folder, F.regexp_replace(h, r"^(\./)+", "")))
    )
    return found.withColumn("to_url", target).withColumn("from_host", host(u)).withColumn("to_host", host(target))


def inbound(links: DataFrame) -> DataFrame:
    """``host, inbound, boost``: links from other hosts, and what they add to a rank."""
    counted = links.where("from_host <> to_host").groupBy(F.col("to_host").alias("host")).agg(F.count("*").alias("inbound"))
    return counted.withColumn("boost", authority(F.col("inbound")))


class _Reader(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.skip, self.inside = base, 0, None
        self.words: list[str] = []
        self.out = {"title": "", "h1": "", "description": "", "canonical": "", "og_title": "", "og_image": "", "headings": 0, "images": 0, "links": []}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        elif tag in ("title", "h1"):
            self.inside = tag
        if tag in ("h1", "h2", "h3"):
            self.out["headings"] += 1
        if tag == "img":
            self.out["images"] += 1
        if tag == "meta" and (a.get("name") or a.get("property") or "").lower() in ("description", "og:description") and not self.out["description"]:
            self.out["description"] = a.get("content") or ""
        if tag == "meta" and (a.get("property") or "").lower() in ("og:title", "og:image"):
            self.out[a["property"].lower().replace(":", "_")] = a.get("content") or ""
        if tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.out["canonical"] = a.get("href") or ""
        if tag == "a" and a.get("href"):
            target = urljoin(self.base, a["href"])
            if urlsplit(target).scheme in ("http", "https"):
                self.out["links"].append(target)

    def handle_endtag(self, tag):
        if tag in DROPPED and self.skip:
            self.skip -= 1
        elif tag == self.inside:
            self.inside = None

    def handle_data(self, data):
        if self.inside and not self.out[self.inside]:
            self.out[self.inside] = " ".join(data.split())
        if not self.skip and self.inside != "title":
            self.words.extend(data.split())


PARSED = (
    types.StructType().add("title", "string").add("description", "string").add("text", "string").add("n_words", "integer").add("headings", "integer")
    .add("images", "integer").add("links", types.ArrayType(types.StringType())).add("canonical", "string").add("og_title", "string").add("og_image", "string")
)


def parser(most_links: int | None = None, most_chars: int | None = None):
    """A function of URL and HTML columns: title, description, visible text, links and further metadata; tolerant of broken markup.

    The reference keeps 150 links and 100,000 characters; here nothing is cut unless asked for.
    """

    @F.pandas_udf(PARSED)
    def run(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        rows = []
        for u, h in zip(url, html, strict=True):
            reader = _Reader(u or "")
            try:
                reader.feed(h or "")
                reader.close()
            except (AssertionError, ValueError):
                pass
            o, text = reader.out, " ".join(reader.words)
            about = o["description"] or text[:180] + ("..." if len(text) > 180 else "")
            rows.append((o["title"] or o["h1"], about, text[:most_chars], len(reader.words), o["headings"], o["images"], o["links"][:most_links], o["canonical"], o["og_title"], o["og_image"]))
        return pd.DataFrame(rows, columns=PARSED.names)

    return run


parse = parser()

#: Patterns of what an audit looks at.
TEXT_BETWEEN = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>"
_META = r"""(?i)<meta\s[^>]*(?:name|property)=["']{}["'][^>]*>"""


def _content(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, _META.format(name), 0)
    return F.trim(F.regexp_extract(tag, r"""(?i)content=["']([^"']*)""", 1))


def audit(html: Column) -> dict[str, Column]:
    """Points from 0 to 100 for what search engines and answering machines look for, their mean, and a rating."""
    has = lambda p: F.coalesce(html.rlike(p), F.lit(False))
    name = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    about = _content(html, "description")
    n_h1 = F.regexp_count(html, F.lit(r"(?i)<h1[\s>]"))
    n_og = sum((F.when(has(_META.format(f"og:{p}")), 1).otherwise(0) for p in ("title", "description", "image")), F.lit(0))
    images = F.regexp_count(html, F.lit(r"(?i)<img[\s>]"))
    without = images - F.regexp_count(html, F.lit(r"""(?i)<img\s[^>]*alt=["'][^"']"""))
    plain = F.regexp_replace(F.regexp_replace(html, TEXT_BETWEEN, " "), "<[^>]+>", " ")
    words = F.regexp_count(plain, F.lit(r"\S+"))
    asks = has(r"(?is)<h[23][^>]*>[^<]*\?\s*</h[23]>") | has("FAQPage")
    schema = has(r"""(?i)<script[^>]*type=["']application/ld\+json["']""")
    aeo = F.when(schema, 35).otherwise(0) + F.when(words >= 500, 25).when(words >= 200, 15).otherwise(0) + F.when(asks, 20).otherwise(0) + F.when(has(r"(?i)<(?:table|ul|ol)[\s>]"), 20).otherwise(0)
    points = {
        "title_score": F.when(F.length(name).between(10, 70), 100).when(name != "", 75).otherwise(0),
        "description_score": F.when(F.length(about).between(50, 165), 100).when(about != "", 70).otherwise(0),
        "h1_score": F.when(n_h1 == 1, 100).when(n_h1 > 1, 80).otherwise(0),
        "viewport_score": F.when(has(_META.format("viewport")), 100).otherwise(0),
        "canonical_score": F.when(has(r"""(?i)<link\s[^>]*rel=["']canonical["']"""), 100).otherwise(60),
        "og_score": F.when(n_og == 3, 100).when(n_og >= 1, 70).otherwise(30),
        "alt_score": F.when(without <= 0, 100).otherwise(F.greatest(F.lit(20), F.floor((1 - without / images) * 100).cast("int"))),
        "robots_score": F.when(F.lower(_content(html, "robots")).contains("noindex"), 50).otherwise(100),
        "aeo_score": F.least(aeo, F.lit(100)),
    }
    total = F.lit(0)
    for c in points.values():
        total = total + c
    score = F.floor(total / len(points)).cast("int")
    return {**points, "seo_score": score, "rating": F.when(score >= 90, "Excellent").when(score >= 70, "Good").otherwise("Needs Improvement")}


#: Signatures of technologies in markup.
TECHNOLOGIES = {
    "Stripe": ("stripe.com", "api.stripe.com"), "Shopify": ("cdn.shopify.com", "myshopify.com"), "HubSpot": ("js.hs-scripts.com", "hubspot"), "Intercom": ("widget.intercom.io",),
    "Google Analytics": ("googletagmanager.com", "google-analytics.com"), "React": ("react", "reactdom", "_next", "__next"), "Next.js": ("_next/static",), "Tailwind CSS": ("tailwind",),
    "Webflow": ("webflow.com", "assets.website-files.com"), "WordPress": ("wp-content", "wp-includes"), "Segment": ("cdn.segment.com",), "Mixpanel": ("cdn.mxpnl.com",),
}


def technologies(html: Column) -> Column:
    low = F.lower(html)
    found = []
    for name, texts in TECHNOLOGIES.items():
        any_of = F.lit(False)
        for t in texts:
            any_of = any_of | low.contains(t)
        found.append(F.when(any_of, F.lit(name)))
    return F.array_compact(F.array(*found))


#: Words of addresses that tell about a site.
TELLING = "about|contact|team|leader|people|management|company|store"


def frontier(links: DataFrame, most: int = 10, words: str = TELLING) -> DataFrame:
    """Up to ``most`` links of a page to pages of the same host that tell about it."""
    wanted = links.where((F.col("from_host") == F.col("to_host")) & F.lower(url_path(F.col("to_url"))).rlike(words))
    w = Window.partitionBy("page_id").orderBy("place")
    return wanted.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
