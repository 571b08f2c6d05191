"""A small tree of markup with CSS selectors and simple XPath, for values that patterns can't express."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types

VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: Elements that end where one of the same kind begins.
SIBLINGS = frozenset({"p", "li", "option", "tr", "td", "th", "dt", "dd"})


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """The elements below, in order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def texts(self):
        """The pieces of text below, in order, without those of scripts and styles."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                stack.extend(reversed(c.children))

    def text(self, between: str = " ") -> str:
        return between.join(" ".join(t.split()) for t in self.texts() if t.strip())


class _Builder(HTMLParser):
    def __init__(self, decode: bool):
        super().__init__(convert_charrefs=True)
        self.decode = decode
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in SIBLINGS and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if not self.decode and self.at.tag in self.CDATA_CONTENT_ELEMENTS:
            data = data.replace("&amp;", "&")
        self.at.children.append(data)


def parse(html: str, decode: bool = True) -> Node:
    """The tree of a page; without ``decode``, character references stay as they are written."""
    builder = _Builder(decode)
    try:
        builder.feed((html or "") if decode else (html or "").replace("&", "&amp;"))
        builder.close()
    except (AssertionError, ValueError):
        pass
    return builder.root


_PART = re.compile(r"([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]|([\w-]+|\*)")


def _fits(node: Node, part: str) -> bool:
    """Whether an element fits one compound selector such as ``div.card[data-x="1"]``."""
    for m in _PART.finditer(part):
        mark, name, attr, op, value, tag = m.groups()
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if mark == "#" and node.attrs.get("id") != name or mark == "." and name not in node.attrs.get("class", "").split():
            return False
        if attr:
            have = node.attrs.get(attr)
            if have is None:
                return False
            ok = {None: True, "=": have == value, "~=": value in have.split(), "^=": have.startswith(value or "\0"), "$=": have.endswith(value or "\0"), "*=": bool(value) and value in have, "|=": have == value or have.startswith(f"{value}-")}[op]
            if not ok:
                return False
    return True


def _css(root: Node, selector: str) -> list[Node]:
    steps = re.findall(r"\s*(>)?\s*((?:\[[^\]]*\]|[^\s>\[])+)", selector.strip())
    if not steps:
        return []
    found = []
    for node in root.walk():
        if not _fits(node, steps[-1][1]):
            continue
        # from the last step upwards; a descendant step takes the nearest ancestor that lets the rest fit
        def above(at: Node, k: int) -> bool:
            if k == 0:
                return True
            direct, part = steps[k][0] == ">", steps[k - 1][1]
            up = at.parent
            while up is not None and up.tag:
                if _fits(up, part) and above(up, k - 1):
                    return True
                if direct:
                    return False
                up = up.parent
            return False

        if above(node, len(steps) - 1):
            found.append(node)
    return found


_STEP = re.compile(r"(//?)(?:@([\w:-]+)|(text\(\))|([\w-]+|\*)((?:\[[^\]]*\])*))")


def _xpath(root: Node, path: str) -> list[str]:
    nodes: list[Node] = [root]
    for slash, attr, text, tag, tests in _STEP.findall(path.lstrip(".")):
        if attr:
            return [n.attrs[attr] for n in nodes if attr in n.attrs]
        if text:
            return [c for n in nodes for c in ((x for x in n.texts()) if slash == "//" else (x for x in n.children if isinstance(x, str)))]
        below = []
        for n in nodes:
            below += [c for c in (n.walk() if slash == "//" else (x for x in n.children if isinstance(x, Node))) if tag == "*" or c.tag == tag.lower()]
        for test in re.findall(r"\[([^\]]*)\]", tests):
            if m := re.fullmatch(r"\d+", test.strip()):
                below = below[int(m[0]) - 1 : int(m[0])]
            elif m := re.fullmatch(r"contains\(\s*@([\w:-]+)\s*,\s*[\"']([^\"']*)[\"']\s*\)", test.strip()):
                below = [c for c in below if m[2] in c.attrs.get(m[1], "")]
            elif m := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*[\"']([^\"']*)[\"'])?", test.strip()):
                below = [c for c in below if m[1] in c.attrs and (m[2] is None or c.attrs[m[1]] == m[2])]
        nodes = list(dict.fromkeys(below))
    return [n.text() for n in nodes]


def select(root: Node, selector: str) -> list[str]:
    """The values of a CSS selector (``::text`` and ``::attr(name)`` at its end), or of an XPath that begins with a slash or dot."""
    selector = selector.strip()
    if selector.startswith(("//", "./", "/")):
        values = _xpath(root, selector)
    else:
        out = []
        for one in selector.split(","):
            path, _, take = one.partition("::")
            for node in _css(root, path):
                if take.startswith("attr("):
                    out.append(node.attrs.get(take[5:-1], ""))
                elif take == "text":
                    out += [c for c in node.children if isinstance(c, str)]
                else:
                    out.append(node.text())
        values = out
    return [v.strip() for v in values if v and v.strip()]


def selector(fields: dict[str, str], decode: bool = True):
    """A function of an HTML column: an array of the values of each field; no value gives null. ``decode`` is that of :func:`parse`."""
    kind = types.StructType()
    for name in fields:
        kind = kind.add(name, types.ArrayType(types.StringType()))

    @F.pandas_udf(kind)
    def run(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            root = parse(h, decode)
            rows.append([select(root, s) or None for s in fields.values()])
        return pd.DataFrame(rows, columns=list(fields))

    return run


#: Titles that people cards name, in order, and the words that make a title of the first or second tier.
ROLES = ("Founder", "Co-Founder", "CEO", "Managing Director", "MD", "Director", "Owner", "Partner", "President", "Vice President", "General Manager", "Store Manager", "Head of Sales", "Operations Manager")
FIRST_TIER = ("Owner", "Founder", "CEO", "Managing Director", "MD", "Proprietor")
_CARD = re.compile("team|leadership|member|executive|profile|person", re.I)
CONTACTS = types.ArrayType(types.StructType().add("name", "string").add("title", "string").add("tier", "string"))


@F.pandas_udf(CONTACTS)
def contact_cards(html: pd.Series) -> pd.Series:
    """Names and titles of up to 20 cards of people: elements of a telling class, else any sections."""
    out = []
    for h in html:
        root, found = parse(h), []
        cards = [n for n in root.walk() if _CARD.search(n.attrs.get("class", ""))] or [n for n in root.walk() if n.tag in ("div", "section", "article")]
        for card in cards[:20]:
            pieces = [" ".join(t.split()) for t in card.texts() if t.strip()]
            low = " | ".join(pieces).lower()
            for role in ROLES:
                if role.lower() not in low:
                    continue
                heads = [n.text() for n in card.walk() if n.tag in ("h1", "h2", "h3", "h4", "h5", "strong", "b")]
                name = heads[0] if heads else next((p for p in pieces if 2 <= len(p.split()) <= 3 and not any(w in p for w in ("About", "Contact", "Team", role))), None)
                if name and len(name) <= 50:
                    found.append({"name": name, "title": role, "tier": "Tier 1" if any(w in role for w in FIRST_TIER) else "Tier 2"})
                    break
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(types.ArrayType(types.StringType()))
def features(html: pd.Series) -> pd.Series:
    """Up to five second and third headings of 11 to 79 characters that aren't about the page itself."""
    skipped = ("cookie", "footer", "menu", "privacy", "copyright")
    return html.map(lambda h: [t for t in (n.text("") for n in parse(h).walk() if n.tag in ("h2", "h3")) if 10 < len(t) < 80 and not any(s in t.lower() for s in skipped)][:5])
