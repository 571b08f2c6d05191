"""Structured values from text and markup: phones, profiles, addresses, embedded JSON, crawl rules, presence and contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.functions.text import EMAIL, emails, phone

PHONE = r"(\+?\d[\d\-\s().]{6,16}\d)"
#: What profile addresses look like.
PROFILES = {"linkedin": r"linkedin\.com/(?:company|in)/([A-Za-z0-9_\-%]+)", "instagram": r"instagram\.com/([A-Za-z0-9_.]+)", "facebook": r"facebook\.com/([A-Za-z0-9_.\-]+)", "youtube": r"youtube\.com/(?:c/|channel/|@)?([A-Za-z0-9_\-]+)", "twitter": r"(?:twitter|x)\.com/([A-Za-z0-9_]+)"}


def phones(text: Column) -> Column:
    """Distinct numbers in order of their first place, normalised; 7 to 15 digits."""
    found = F.filter(F.regexp_extract_all(text, F.lit(PHONE), F.lit(1)), lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(7, 15))
    return F.array_distinct(F.filter(F.transform(found, phone), lambda p: p.isNotNull()))


def profiles(html: Column) -> Column:
    """platform and handle of the profiles that are linked, once each."""
    each = [F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), _named(n)) for n, p in PROFILES.items()]
    return F.array_distinct(F.flatten(F.array(*each)))


def _named(platform: str):
    return lambda handle: F.struct(F.lit(platform).alias("platform"), F.lower(handle).alias("handle"))


def address_parts(address: Column) -> Column:
    """The address on one line, its postal code (six digits, else five or nine) and city (the last part but one)."""
    line = F.regexp_replace(F.regexp_replace(F.trim(address), r"\s+", " "), r"\s*,\s*", ", ")
    parts = F.split(line, ", ")
    none = lambda c: F.nullif(c, F.lit(""))
    postal = F.coalesce(none(F.regexp_extract(line, r"\b(\d{6})\b", 1)), none(F.regexp_extract(line, r"\b(\d{5}(?:-\d{4})?)\b", 1)))
    return F.struct(line.alias("line"), F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2)).alias("city"), postal.alias("postal"))


def json_ld(html: Column) -> Column:
    """The embedded JSON documents as variants; those that don't parse are left out."""
    raw = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    return F.filter(F.transform(raw, F.try_parse_json), lambda v: v.isNotNull())


def json_block(text: Column) -> Column:
    """A fenced or braced JSON object in an answer, with Python's constants and trailing commas mended."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    out = F.regexp_replace(F.coalesce(fenced, braced), r",\s*([}\]])", "$1")
    for a, b in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return out


def presence(html: Column) -> dict[str, Column]:
    low = F.lower(html)
    return {
        "has_shop": low.rlike("add to cart|checkout|shopify|woocommerce"),
        "has_catalogue": low.rlike("catalogue|catalog|brochure"),
        "has_chat": low.rlike(r"wa\.me|api\.whatsapp\.com"),
        "has_form": low.contains("<form"),
        "has_script": low.contains("<script"),
    }


def with_base(html: Column, url: Column) -> Column:
    """Markup with a base address in its head, unless it has one."""
    tag = F.concat(F.lit('<base href="'), url, F.lit('">'))
    marked = F.regexp_replace(html, r"(?i)(<head[^>]*>)", "$1@@base@@")
    return F.when(html.rlike("(?i)<base\\s"), html).otherwise(F.replace(marked, F.lit("@@base@@"), tag))


#: What pages of checks for robots contain.
CHALLENGES = (
    "cf-browser-verification", "challenge-platform", "cloudflare turnstile", "cf-chl-bypass", "just a moment...", "datadome", "captcha-delivery.com", "px-captcha", "perimeterx", "_px3",
    "incapsula_resource", "_incap_", "akamai-bot-manager", "akamai ghost", "ddos-guard", "aws waf captcha", "google.com/recaptcha", "g-recaptcha", "grecaptcha", "hcaptcha.com", "h-captcha",
    "arkoselabs.com", "funcaptcha", "please verify you are a human", "unusual traffic from your computer network", "access denied", "attention required! | cloudflare",
)
#: Paths of a site that tell about its owner, cities and states that addresses name.
SEED_PATHS = ("/about", "/about-us", "/contact", "/contact-us", "/team", "/leadership", "/management", "/company", "/our-story")
CITIES = ("Hyderabad", "Secunderabad", "Bangalore", "Bengaluru", "Mumbai", "Delhi", "New Delhi", "Chennai", "Kolkata", "Ahmedabad", "Pune", "Jaipur", "Surat", "Kochi", "Coimbatore", "Visakhapatnam", "Vijayawada", "Lucknow")
STATES = ("Telangana", "Andhra Pradesh", "Karnataka", "Maharashtra", "Tamil Nadu", "Gujarat", "Rajasthan", "Delhi", "West Bengal", "Uttar Pradesh", "Kerala")


def challenge(html: Column) -> Column:
    """Whether a page is too short or a check for robots."""
    low = F.lower(html)
    found = F.lit(False)
    for text in CHALLENGES:
        found = found | low.contains(text)
    return (F.length(F.trim(F.coalesce(html, F.lit("")))) < 150) | found


def seed_pages(url: Column) -> Column:
    """The addresses on a site that are tried first."""
    site = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    return F.when(site != "", F.transform(F.array(*[F.lit(p) for p in SEED_PATHS]), lambda p: F.concat(site, p)))


def _first_of(text: Column, options: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(text.rlike(rf"(?i)\b{o}\b"), o) for o in options])


def place(text: Column) -> Column:
    """city, state and country that a text names; India for a known city or state."""
    t = F.coalesce(text, F.lit(""))
    city, state = _first_of(t, CITIES), _first_of(t, STATES)
    country = F.when(city.isNotNull() | state.isNotNull() | F.lower(t).contains("india"), "India").otherwise("International")
    return F.struct(city.alias("city"), state.alias("state"), country.alias("country"))


def industry(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("jewel|gold|diamond|gemstone|ornament"), "Jewellery").when(low.rlike("manufactur|factory|textile"), "Manufacturing").when(low.rlike("tech|software|solution|digital"), "Technology").otherwise("General")


def pricing_model(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("per month") | low.contains("/mo"), "Monthly Recurring Subscription (SaaS)").when(low.contains("free trial"), "Freemium / Free Trial with Tiered Upgrade")
        .when(low.contains("one-time") | low.contains("lifetime"), "One-time Purchase / License").otherwise("Custom / Enterprise Quote")
    )


def name_from_title(title: Column, host_: Column) -> Column:
    """What stands before " - " or " | " in a title if it is short, else the first label of the host."""
    label = F.initcap(F.split_part(host_, F.lit("."), F.lit(1)))
    cut = lambda sep: F.trim(F.split_part(F.coalesce(title, F.lit("")), F.lit(sep), F.lit(1)))
    short = lambda sep: F.when(title.contains(sep), F.when(F.length(cut(sep)) < 30, cut(sep)).otherwise(label))
    return F.coalesce(short(" - "), short(" | "), label)


def company_name_from(html: Column, title: Column, host_: Column) -> Column:
    """The name that embedded data, the site name, the logo, the copyright line or the title gives, in that order."""
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    kinds = ("Organization", "LocalBusiness", "Corporation", "JewelryStore", "Store")
    data = F.filter(json_ld(html), lambda v: F.try_variant_get(v, "$.@type", "string").isin(*kinds))
    named = none(F.try_variant_get(F.get(data, F.lit(0)), "$.name", "string"))
    site = none(F.regexp_extract(html, r"""(?i)<meta\s[^>]*property=["']og:site_name["'][^>]*content=["']([^"']+)""", 1))
    logo = none(F.regexp_replace(F.regexp_extract(html, r"""(?i)<img\s[^>]*class=["'][^"']*logo[^"']*["'][^>]*alt=["']([^"']+)""", 1), "(?i)logo", ""))
    right = none(F.regexp_extract(html, r"(?is)<footer.*?©\s*(?:\d{4})?\s*([A-Za-z0-9\s&,.'-]+?)(?:\.|All\s+Rights|\s*-\s|<)", 1))
    head = none(F.get(F.split(F.coalesce(title, F.lit("")), r"[|\-–—:]"), F.lit(0)))
    return F.coalesce(named, site, F.when(F.length(logo) > 2, logo), F.when(F.length(right).between(3, 50), right), F.when(F.length(head).between(2, 60), head), F.initcap(F.split_part(host_, F.lit("."), F.lit(1))))


def mail_addresses(html: Column) -> Column:
    """Addresses of mailto links first, then those in the text; pictures and style sheets that look like addresses are left out."""
    linked = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)mailto:([^\"'?\s>]+)"), F.lit(1)), lambda m: F.lower(m))
    every = F.array_distinct(F.concat(linked, emails(html)))
    return F.filter(every, lambda m: ~m.rlike(r"\.(png|jpe?g|gif|svg|webp|css|js)$") & m.rlike(f"^{EMAIL}$"))


def phone_links(html: Column) -> Column:
    """Numbers of tel links, normalised, in order."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)tel:([+\d\-\s().]+)"), F.lit(1)), phone)
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull()))


def robots(text: Column, agent: str = "*") -> Column:
    """The paths that an agent's group disallows and allows, its delay, and the site maps, of a robots file."""
    groups = F.regexp_extract_all(F.concat(text, F.lit("\nuser-agent: -")), F.lit(rf"(?is)user-agent:\s*{'[*]' if agent == '*' else agent}\s*\n(.*?)(?=\nuser-agent:)"), F.lit(1))
    body = F.array_join(groups, "\n")
    rules = lambda word: F.regexp_extract_all(body, F.lit(rf"(?im)^\s*{word}:[ \t]*(\S+)"), F.lit(1))
    maps = F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:[ \t]*(\S+)"), F.lit(1))
    delay = F.get(rules("crawl-delay"), F.lit(0)).try_cast("double")
    return F.struct(rules("disallow").alias("disallow"), rules("allow").alias("allow"), delay.alias("delay"), maps.alias("sitemaps"))


def allowed(path: Column, rules: Column) -> Column:
    """Whether a path may be fetched: the longest rule that begins it decides, and of equal ones the allowing."""
    longest = lambda of: F.coalesce(F.array_max(F.transform(F.filter(of, lambda r: path.startswith(r)), lambda r: F.length(r))), F.lit(-1))
    return longest(rules["allow"]) >= longest(rules["disallow"])


def tier(title: Column) -> Column:
    """How near a title is to decisions."""
    low = F.lower(title)
    return F.when(low.rlike("founder|owner|ceo|chief|president|managing director"), "Tier 1").when(low.rlike("director|head|vp|vice president|general manager"), "Tier 2").when(F.coalesce(title, F.lit("")) != "", "Tier 3")
