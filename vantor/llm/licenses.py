"""Licence scans: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vantor.llm import _bytes as B

#: Notice phrases (as words) and the label that each gives.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: More notices, whose labels are added to those of the base phrases. Of notices inside one another the longest counts.
MORE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public licence": "gpl",
    "gnu library general public license": "lgpl",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3.0",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "mozilla public license v 2 0": "mpl-2.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "eclipse public license v 2 0": "epl-2.0",
    "eclipse public license 2 0": "epl-2.0",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "european union public licence": "eupl",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl-1.0",
    "business source license": "busl",
    "elastic license": "elastic",
    "commons clause": "commons-clause",
    "artistic license": "artistic",
    "artistic license 2 0": "artistic-2.0",
    "academic free license": "afl",
    "open software license": "osl",
    "boost software license": "bsl-1.0",
    "python software foundation license": "psf-2.0",
    "do what the fuck you want to public license": "wtfpl",
    "sil open font license": "ofl-1.1",
    "open database license": "odbl-1.0",
    "mit license": "mit",
    "isc license": "isc",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "apache license": "apache",
    "licensed under the apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "simplified bsd license": "bsd-2-clause",
    "new bsd license": "bsd-3-clause",
    "permission is hereby granted free of charge to any person": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons zero": "cc0-1.0",
    "creative commons cc0": "cc0-1.0",
    "cc0 1 0 universal": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution no derivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial share alike": "cc-by-nc-sa",
    "creative commons attribution non commercial share alike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution non commercial no derivatives": "cc-by-nc-nd",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "all-rights-reserved",
    "proprietary and confidential": "proprietary",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
}
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.:+\-]+")
#: Identifiers (fixed values of the public list of licence identifiers, lower-cased) that grant use, change and redistribution
#: with no more than notices, and labels of notices that do.
PERMISSIVE = frozenset("""
    0bsd afl-3.0 apache apache-1.1 apache-2 apache-2.0 artistic-2.0 beerware blueoak-1.0.0 bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent
    bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by cc-by-3.0 cc-by-4.0 cc-pddc cc0-1.0 curl ecl-2.0 fsfap ftl hpnd icu ijg
    isc libpng libpng-2.0 mit mit-0 mit-cmu ms-pl mulanpsl-2.0 ncsa ntp openssl pddl-1.0 php-3.01 postgresql psf-2.0 public-domain
    python-2.0 ruby tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split())
#: Further identifiers of that list that are known but not permissive.
RESTRICTED = frozenset("""
    agpl-1.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apsl-2.0 artistic-1.0 artistic-1.0-perl busl-1.1 cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-3.0
    cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0
    cddl-1.0 cddl-1.1 cecill-2.1 cpal-1.0 cpl-1.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.2-only gfdl-1.2-or-later
    gfdl-1.3 gfdl-1.3-only gfdl-1.3-or-later gpl-1.0 gpl-1.0-only gpl-1.0-or-later gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0
    gpl-3.0-only gpl-3.0-or-later ipl-1.0 lgpl-2.0 lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0
    lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-rl npl-1.1 odbl-1.0 ofl-1.1
    osl-3.0 polyform-noncommercial-1.0.0 qpl-1.0 rpl-1.5 sleepycat spl-1.0 sspl-1.0
""".split())
#: Exceptions that may stand after ``with``.
EXCEPTIONS = frozenset("""
    autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 font-exception-2.0 gcc-exception-2.0 gcc-exception-3.1
    linux-syscall-note llvm-exception openssl-exception qt-gpl-exception-1.0 swift-exception u-boot-exception-2.0 wxwindows-exception-3.1
""".split())
_RANK = {"or": 1, "and": 2, "with": 3}
_AS_WORDS = bytes(int(B.LOWER[c]) if B.ALNUM[B.LOWER[c]] else 0x20 for c in range(256))


def parse_expression(text: str) -> list[str]:
    """A licence expression in reverse Polish order; ``with`` binds before ``and``, ``and`` before ``or``.

    Reading stops at the first token that can't continue the expression; operators without operands are left out.
    """
    out: list[str] = []
    ops: list[str] = []
    operand = False
    for token in _TOKEN.findall(text):
        low = token.lower()
        if low in _RANK:
            if not operand:
                break
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            ops.append(token)
        elif token == ")":
            if not operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if operand:
                break
            out.append(low)
            operand = True
    if not operand and ops:  # an operator at the end has no right side
        while ops and ops[-1] == "(":
            ops.pop()
        if ops:
            ops.pop()
    out.extend(op for op in reversed(ops) if op != "(")
    return out


def evaluate(rpn: list[str], allowed=PERMISSIVE) -> tuple[bool, set[str]]:
    """Whether the expression can be met with allowed licences, and the licences it names. An exception doesn't change its licence."""
    stack: list[tuple[bool, set[str]]] = []
    for token in rpn:
        if token in _RANK:
            if len(stack) < 2:
                continue
            (b, names_b), (a, names_a) = stack.pop(), stack.pop()
            stack.append((a, names_a) if token == "with" else ((a or b) if token == "or" else (a and b), names_a | names_b))
        else:
            stack.append((token in allowed, {token}))
    return (all(x[0] for x in stack), set().union(*(x[1] for x in stack))) if stack else (False, set())


def known_expression(rpn: list[str]) -> bool:
    """Whether an expression names only known identifiers (``+``: or later; references to own texts count) and exceptions."""
    for k, token in enumerate(rpn):
        if token in _RANK or token.startswith(("licenseref-", "documentref-")):
            continue
        if rpn[k + 1 : k + 2] == ["with"] and token in EXCEPTIONS:
            continue
        if token.rstrip("+") not in PERMISSIVE and token.rstrip("+") not in RESTRICTED:
            return False
    return bool(rpn)


class Scanner:
    def __init__(self, base: Mapping[str, str] = BASE_PHRASES, more: Mapping[str, str] = MORE_PHRASES):
        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *more, TAG}:
            words = f" {phrase} "
            self.automaton.add_word(words, (len(words), phrase))
        self.automaton.make_automaton()
        self.base, self.more = dict(base), dict(more)

    def scan(self, raw: bytes) -> dict:
        """Counts and labels of one text, except for its number of words."""
        # every byte that isn't in a word ends one; the patterns are ASCII, so bytes can stand for characters
        line = b" " + b" ".join(raw.translate(_AS_WORDS).split()) + b" "
        places, base, notices, tagged = [], set(), [], False
        text = line.decode("latin-1")
        for end, (length, phrase) in self.automaton.iter(text):
            if phrase in self.base:
                places.append(end - length + 1)
                base.add(self.base[phrase])
            if phrase in self.more:
                notices.append((end - length + 1, end, phrase))
            tagged |= phrase == TAG
        longest, reach = [], -1  # a notice within a longer one says nothing of its own
        for start, end, phrase in sorted(notices, key=lambda x: (x[0], -x[1])):
            if end > reach:
                longest.append(self.more[phrase])
                reach = end
        grants, labels = [], set(longest)
        if tagged:
            for found in _TAG.finditer(raw.decode("utf-8", "replace")):
                rpn = parse_expression(found[1])
                if known_expression(rpn):
                    granted, names = evaluate([t.rstrip("+") for t in rpn])
                    grants.append(granted)
                    labels |= names
        evidence = len(places) + sum(x not in base for x in longest) + len(grants)
        at = [text.count(" ", 0, p) for p in (min(places), max(places))] if places else [None, None]
        every = base | labels
        # that rights are reserved is common beside a licence; alone it grants nothing
        named = base | (set(longest) - {"all-rights-reserved"})
        permissive = all(grants) and named <= PERMISSIVE and bool(grants or named)
        return {"n_base": len(places), "first_word": at[0], "last_word": at[1], "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(every)), "score": 1.0 - 0.5**evidence, "permissive": permissive if every else None}


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of ``docs`` and the licence evidence of each whole text.

    ``n_base`` counts the places where the words of a base phrase stand one after another, ``first_word`` and ``last_word``
    are the smallest and largest of their first words (null: none). ``base_labels`` and ``labels`` are sorted and joined by
    commas (none: empty); ``labels`` also has those of further notices and of tagged licence expressions. ``score`` is 0
    without evidence and nears 1 with each piece of it. ``permissive``: whether all tagged expressions can be met with
    permissive licences and every notice is permissive (null: no evidence). Of notices inside one another the longest counts;
    tagged expressions count if all their identifiers are known. Null and empty texts have no evidence. Repeated rows give
    repeated results. Columns that have a name of the result are replaced.
    """
    made = [c.split()[0] for c in RESULT.split(", ")]
    names = [c for c in (keep or docs.columns) if c not in made]
    schema = docs.select(*names).schema
    for c in RESULT.split(", "):
        schema = schema.add(*c.split())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in B.slices(batches, text_col):
            text = B.Text(batch.column(batch.schema.get_field_index(text_col)))
            starts, _ = text.lowered().words(B.ALNUM)
            rows = [scanner.scan(text.bytes_of(i)) for i in range(text.n)]
            words = np.bincount(text.owner(starts), minlength=text.n).astype(np.int64)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            arrays += [pa.array(words), *(pa.array([r[c] for r in rows], t) for c, t in zip(made[1:], [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.bool_()], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *made])

    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(scan, schema)
