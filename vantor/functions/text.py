"""Names, hosts, URLs, phones, e-mails and tokens as column expressions; Unicode folding and sequence similarity as pandas functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

#: Legal forms at the end of a company name.
LEGAL_FORMS = ("private limited", "pvt ltd", "limited", "ltd", "incorporated", "inc", "corporation", "corp", "llc", "llp", "gmbh", "plc", "s a", "s r l", "co kg", "co kgaa", "kgaa", "ag", "se")
#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "gov.uk", "ac.uk", "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in", "com.au", "net.au", "org.au", "edu.au", "co.jp", "ne.jp", "ac.jp", "co.za", "org.za", "com.br", "net.br", "org.br", "com.sg", "edu.sg")
#: Mailboxes of roles, and free mail hosts.
ROLE_MAILBOXES = ("info", "sales", "contact", "support", "admin", "hello", "team", "marketing", "billing", "help", "office", "jobs", "careers", "press", "legal", "security", "inquiries", "general")
FREE_MAIL_HOSTS = ("gmail.com", "googlemail.com", "yahoo.com", "ymail.com", "outlook.com", "hotmail.com", "live.com", "msn.com", "icloud.com", "me.com", "aol.com", "protonmail.com", "proton.me", "zoho.com", "mail.com", "gmx.com")
#: What titles are written out to, in order; the last one also holds inside words.
TITLE_WORDS = {"vp ": "vice president ", "vp,": "vice president,", "dir ": "director ", "mgr ": "manager ", "sr.": "senior", "jr.": "junior", "it": "information technology"}
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_SUFFIX = "|".join(r"\s*".join(f.split()) if f in ("s a", "s r l") else r"\s+".join(f.split()) for f in sorted(LEGAL_FORMS, key=len, reverse=True))


@F.pandas_udf(types.StringType())
def fold_unicode(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return values.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)


@F.pandas_udf(types.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings, without case and outer space; for pairs that blocking has found."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, (x or "").lower().strip(), (y or "").lower().strip()).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def company_name(x: Column, folded: bool = False) -> Column:
    """Lower case without punctuation and trailing legal forms; a name of nothing else stays."""
    base = squeeze(F.regexp_replace(F.lower(F.trim(x if not folded else fold_unicode(x))), r"[.,\-_/]", " "))
    bare = F.regexp_replace(base, rf"(?<=\S)(?:\s+(?:&|and))?(?:\s+(?:&\s*)?(?:{_SUFFIX})(?:\s+(?:&|and))?)+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("")).otherwise(F.when(F.trim(bare) != "", F.trim(bare)).otherwise(F.lower(F.trim(x))))


def company_key(x: Column) -> Column:
    """Letters a-z and digits of a name without legal forms."""
    cleaned = F.regexp_replace(F.lower(x), r"\b(pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|inc\.?|llp|corporation|corp\.?)\b", "")
    key = F.regexp_replace(cleaned, "[^a-z0-9]", "")
    return F.when(key != "", key).otherwise(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))


def person_name(x: Column) -> Column:
    return squeeze(F.regexp_replace(F.trim(x), r"(?i)^(mr|mrs|ms|dr|prof)\.?\s+", ""))


def first_name(x: Column) -> Column:
    return F.split_part(person_name(x), F.lit(" "), F.lit(1))


def last_name(x: Column) -> Column:
    return F.regexp_replace(person_name(x), r"^\S+\s?", "")


def host(x: Column) -> Column:
    """Lower-cased host without port and leading www."""
    bare = F.regexp_replace(F.lower(F.trim(x)), "^https?://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^([^/?#]*)", 1), ":.*$", ""), r"^www\.", "")


def url_path(x: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.trim(x), "^(?i)https?://", ""), r"^[^/?#]*([^?#;]*)", 1)


def url(x: Column) -> Column:
    """Scheme, host without www and path without trailing slashes."""
    full = F.when(F.trim(x).rlike("^https?://"), F.trim(x)).otherwise(F.concat(F.lit("https://"), F.trim(x)))
    scheme = F.regexp_extract(full, "^(https?)://", 1)
    site = F.regexp_replace(F.lower(F.regexp_extract(full, "^https?://([^/?#]*)", 1)), r"^www\.", "")
    return F.concat(scheme, F.lit("://"), site, F.regexp_replace(F.regexp_extract(full, r"^https?://[^/?#]*([^?#;]*)", 1), "/+$", ""))


def registrable(x: Column) -> Column:
    """The last two labels of a host, or three if the last two are a known public suffix."""
    labels = F.split(host(x), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(F.size(labels) <= 2, host(x)).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def registrable_by_rule(x: Column) -> Column:
    """As :func:`registrable`, by the form of the last labels instead of a list."""
    labels = F.split(host(x), r"\.")
    n = F.size(labels)
    country = (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin("co", "com", "org", "gov", "ac", "net")
    take = F.when(country & (n >= 3), 3).otherwise(2)
    return F.when(n <= 2, host(x)).otherwise(F.array_join(F.slice(labels, n - take + 1, take), "."))


def phone(x: Column) -> Column:
    """Digits and plus signs with a country code; fewer than seven characters give null."""
    d = F.regexp_replace(x, r"[^\d+]", "")
    full = (
        F.when(d.startswith("00"), F.concat(F.lit("+"), F.substring(d, 3, 1000)))
        .when(d.startswith("0") & (F.length(d) == 11), F.concat(F.lit("+91"), F.substring(d, 2, 1000)))
        .when((F.length(d) == 10) & ~d.startswith("+"), F.concat(F.lit("+91"), d))
        .otherwise(d)
    )
    return F.when(F.length(full) >= 7, full)


def country_code(x: Column) -> Column:
    p = phone(x)
    known = F.when(p.startswith("+91"), "+91").when(p.startswith("+1"), "+1").when(p.startswith("+44"), "+44")
    return F.coalesce(known, F.nullif(F.regexp_extract(p, r"^(\+\d{1,3})", 1), F.lit("")), F.lit("+91"))


def emails(text: Column, blocked: tuple[str, ...] = ()) -> Column:
    """Distinct lower-cased addresses in order, without those that contain a blocked word."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1)), lambda e: F.lower(e)))
    return F.filter(found, lambda e: ~e.rlike("|".join(w.replace(".", r"\.") for w in blocked))) if blocked else found


def email_kind(x: Column) -> Column:
    mail = F.lower(F.trim(x))
    return (
        F.when(F.coalesce(mail, F.lit("")) == "", "missing")
        .when(~mail.rlike(f"^{EMAIL}$") | (F.length(mail) > 254), "invalid")
        .when(F.split_part(mail, F.lit("@"), F.lit(1)).isin(*ROLE_MAILBOXES), "role")
        .when(F.split_part(mail, F.lit("@"), F.lit(2)).isin(*FREE_MAIL_HOSTS), "free")
        .otherwise("corporate")
    )


def email_guesses(first: Column, last: Column, domain: Column) -> Column:
    f, s = F.lower(first), F.lower(last)
    at = F.concat(F.lit("@"), domain)
    return F.array(F.concat(f, F.lit("."), s, at), F.concat(f, at), F.concat(F.substring(f, 1, 1), s, at), F.concat(f, F.lit("_"), s, at), F.concat(f, s, at))


def tokens(x: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with a mark, and the letters without it."""
    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


MARKED, PLAIN = _plain_letters()


def folded_tokens(x: Column) -> Column:
    """Runs of letters and digits in lower case, Latin letters without their marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(x, F.lit(""))), MARKED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def title_words(x: Column) -> Column:
    """A job title in lower case with its abbreviations written out."""
    out = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    for short, long in TITLE_WORDS.items():
        out = F.replace(out, F.lit(short), F.lit(long))
    return squeeze(out)


def iso_time(x: Column) -> Column:
    """The time of an ISO text; without a zone it is UTC, and what isn't a time is null."""
    text = F.trim(x)
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.concat(text, F.lit("Z"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
    return zoned.try_cast("timestamp")


def iso_text(x: Column) -> Column:
    return F.date_format(x.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def id_time(x: Column) -> Column:
    """The milliseconds that an id of the form prefix_hex_random holds, or null."""
    parts = F.split(x, "_")
    return F.when((F.size(parts) >= 3) & F.get(parts, F.lit(1)).rlike("^[0-9a-fA-F]{1,15}$"), F.conv(F.get(parts, F.lit(1)), 16, 10).cast("long"))


def json_hash(x: Column) -> Column:
    """The SHA-256 of a JSON document with its keys in order; null for what isn't JSON."""
    return F.sha2(F.to_json(F.try_parse_json(x)).cast("binary"), 256)


def phrase_tokens(items: Column) -> Column:
    """Lower-cased phrases, and the longer words of those that have several."""
    low = F.transform(items, lambda i: F.lower(F.trim(i)))
    words = F.flatten(F.transform(low, lambda i: F.when(F.size(F.split(i, r"\s+")) > 1, F.filter(F.split(i, r"\s+"), lambda w: F.length(w) > 2)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(low, words))


def fingerprint(*parts: Column, length: int = 32) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by bars; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, length)


def classify(value: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], default: Column) -> Column:
    """The label of the first rule of which the value contains a word."""
    out = default
    for label, words in reversed(rules):
        out = F.when(value.rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(label)).otherwise(out)
    return out


#: What hosts and paths say about a URL, in order.
SITE_KINDS = (
    ("social_profile", ("instagram.com", "facebook.com", "linkedin.com", "youtube.com", "twitter.com", "x.com", "whatsapp.com", "pinterest.com")),
    ("directory", ("yellowpages.com", "justdial.com", "indiamart.com", "tradeindia.com", "sulekha.com", "yelp.com", "tripadvisor.com", "glassdoor.com", "crunchbase.com", "kompass.com")),
    ("marketplace", ("amazon.com", "amazon.in", "flipkart.com", "ebay.com", "etsy.com", "myntra.com", "ajio.com")),
    ("article", ("wikipedia.org", "medium.com", "news.google.com", "timesofindia.com", "thehindu.com", "economic-times.com", "quora.com", "reddit.com")),
)
#: What a path says about a page, in order.
PAGE_KINDS = (
    ("about", ("/about", "/company", "/story", "/who-we-are")),
    ("contact", ("/contact", "/reach-us", "/location", "/get-in-touch")),
    ("leadership", ("/team", "/leadership", "/management", "/founders", "/our-team", "/board")),
    ("product", ("/product", "/shop", "/catalog", "/collection", "/category", "/item")),
    ("service", ("/service", "/solution", "/what-we-do")),
    ("location", ("/store", "/branches", "/outlets", "/find-us")),
    ("legal", ("/privacy", "/terms", "/legal", "/disclaimer")),
    ("blog", ("/blog", "/news", "/press", "/articles")),
)


def site_kind(x: Column) -> Column:
    by_path = F.when(F.lower(url_path(x)).rlike("/news/|/blog/|/article/|/wiki/"), "article").otherwise("company_website")
    return F.when(F.coalesce(host(x), F.lit("")) == "", "unknown").otherwise(classify(host(x), SITE_KINDS, by_path))


def page_kind(x: Column, title: Column) -> Column:
    path, low = F.regexp_replace(F.lower(url_path(x)), "/+$", ""), F.lower(F.coalesce(title, F.lit("")))
    by_title = classify(low, (("about", ("about",)), ("contact", ("contact",)), ("leadership", ("team", "leadership", "management"))), F.lit("other"))
    return F.when(F.coalesce(x, F.lit("")) == "", "other").when(path.isin("", "/index.html", "/index.php"), "homepage").otherwise(classify(path, PAGE_KINDS, by_title))
