"""Repeated byte strings: maximal repeats from the common-prefix interval trees of a distributed, sampled suffix array.

Every window of ``WINDOW`` bytes names one of its stretches of ``Q`` bytes, its anchor, by content alone, so equal windows
have equal anchors at equal places. Suffixes that start at anchors are dealt by the anchor's hash. Occurrences of an anchor with
equal surroundings are one class, of which only the first goes further; anchors with several classes have their suffixes sorted
and their trees scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm import _bytes as B
from vantor.llm._ids import numbered
from vantor.llm._store import written

WINDOW = 100
Q = 32
#: An anchor with more classes than this has its shared windows found by sorting and joining instead of in the memory of one task.
MOST_CLASSES = 20_000
_SLICE = 1 << 20
_HELD = 1 << 21
#: Surroundings whose trees a task scans together.
_TREE_ROWS = 20_000
_LAST = (1 << 63) - 1


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` values in a row, for every start that has as many."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text: B.Text, window: int = WINDOW, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: the number of its text, its start, its hash, and the hash of all windows around it."""
    n, span = len(text.data), window - q + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    sums = text.sums()
    x = B.mix((sums[q:] - sums[: n - q + 1]) * B.powers(B._BASE, n - q + 1, True))
    crossing, outside = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(1, window):
        at = text.at[1:] - k
        at = at[at >= 0]
        outside[at] = True
        if k < q:
            crossing[at] = True
    rank = np.maximum((x >> np.uint64(32)).astype(np.uint32), 1)
    rank[crossing[: len(rank)]] = 0xFFFFFFFF
    least = _sliding(rank, span, np.minimum)
    least[outside[: len(least)]] = 0
    padded = np.concatenate([np.zeros(span - 1, np.uint32), least, np.zeros(span - 1, np.uint32)])
    chosen = np.flatnonzero((_sliding(padded, span, np.maximum)[: len(rank)] == rank) & ~crossing[: len(rank)])
    who = text.owner(chosen)
    a, b = text.at[who], text.at[who + 1]
    low, high = np.maximum(a, chosen - (span - 1)), np.minimum(b, chosen + window)
    around = text.hashes(low, high, sums=sums) ^ B.mix((chosen - low).astype(np.uint64) + np.uint64(1 << 40))
    return who, chosen - a, x[chosen], around


def _rows(kind, x, c, doc, th, at, to) -> pa.RecordBatch:
    n = len(doc)
    full = lambda v, t: pa.array(np.full(n, v, t) if np.isscalar(v) else np.asarray(v).astype(t, copy=False))
    return pa.RecordBatch.from_arrays([full(kind, np.int8), full(x, np.int64), full(c, np.int64), full(doc, np.int64), full(th, np.int64), full(at, np.int32), full(to, np.int32)], ["kind", "x", "c", "doc", "th", "at", "to"])


_SCHEMA = "kind byte, x long, c long, doc long, th long, at int, to int"
_ANCHOR, _SPAN, _HEAD = 0, 1, 2
_SALTS = 8


def _merged(doc, th, at, to):
    """Spans that overlap or touch within a document, as one."""
    order = np.lexsort((at, th, doc))
    doc, th, at, to = doc[order], th[order], at[order], to[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]))
    group = np.zeros(len(doc), np.int64)
    group[edge] = 1
    group = np.cumsum(group)
    reach = np.maximum.accumulate(to.astype(np.int64) + (group << 33)) - (group << 33)  # of the document so far
    fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (at[1:] > reach[:-1])])
    first = np.flatnonzero(fresh)
    return doc[first], th[first], at[first], reach[np.append(first[1:], len(doc)) - 1]


def _first_of_classes(docs: DataFrame, window: int, q: int) -> DataFrame:
    """Anchor rows, one for each class and task, and spans of the occurrences that are not the first of their class in the task."""
    before = window - q

    def give(held):
        doc, th, at, x, c = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.lexsort((at, th, doc, c, x))
        doc, th, at, x, c = doc[order], th[order], at[order], x[order], c[order]
        first = np.concatenate([[True], (x[1:] != x[:-1]) | (c[1:] != c[:-1])])
        if not first.all():
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            other = (doc != doc[lead]) | (th != th[lead]) | (at != at[lead])
            if other.any():
                d, t, a, b = _merged(doc[other], th[other], np.maximum(at[other] - before, 0), at[other] + window)
                yield _rows(_SPAN, B.signed(B.mix(d.view(np.uint64))), 0, d, t, a, b)
        yield _rows(_ANCHOR, B.signed(x[first]), B.signed(c[first]), doc[first], th[first], at[first], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in B.slices(batches, "text", _SLICE):
            who, at, x, c = anchors(B.Text(batch.column(2)), window, q)
            held.append((batch.column(0).to_numpy()[who], batch.column(1).to_numpy()[who], at, x, c))
            n += len(who)
            if n > _HELD:
                yield from give(held)
                held, n = [], 0
        if n:
            yield from give(held)

    return docs.mapInArrow(run, _SCHEMA)


def _classes(rows: DataFrame, window: int, q: int) -> DataFrame:
    """Spans of all occurrences but the first of each class, and the first ones (``_HEAD``) of anchors that have several classes.

    Reads each partition once in order and holds one batch of it.
    """
    before = window - q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None  # first row of the last class
        waiting = None  # the same if its anchor has no other class yet
        for batch in batches:
            kind, x, c, doc, th, at, to = (batch.column(i).to_numpy() for i in range(7))
            passing = kind == _SPAN
            if passing.any():
                yield _rows(_SPAN, 0, 0, doc[passing], th[passing], at[passing], to[passing])
            x, c, doc, th, at = (v[~passing] for v in (x, c, doc, th, at))
            if not len(x):
                continue
            if lead is not None:
                x, c, doc, th, at = (np.concatenate([[p], v]) for p, v in zip(lead, (x, c, doc, th, at), strict=True))
            first = np.concatenate([[True], (x[1:] != x[:-1]) | (c[1:] != c[:-1])])
            heads = np.flatnonzero(first)
            own = heads[np.cumsum(first) - 1]
            again = (doc != doc[own]) | (th != th[own]) | (at != at[own])
            if again.any():
                d, t, a, b = _merged(doc[again], th[again], np.maximum(at[again] - before, 0), at[again] + window)
                yield _rows(_SPAN, 0, 0, d, t, a, b)
            hx = x[heads]
            prev = np.concatenate([[False], hx[1:] == hx[:-1]])
            following = np.concatenate([hx[1:] == hx[:-1], [False]])
            asked = prev | following
            if lead is not None and waiting is None:  # it has been asked for before
                asked[0] = False
            asked_heads = heads[asked]
            if len(asked_heads):
                yield _rows(_HEAD, x[asked_heads], 0, doc[asked_heads], th[asked_heads], at[asked_heads], -1)
            last = heads[-1]
            many = prev[-1] or (len(heads) == 1 and lead is not None and waiting is None)
            lead = (x[last], c[last], doc[last], th[last], at[last])
            waiting = None if many else lead

    return rows.repartition(F.col("x")).sortWithinPartitions("x", "c", "doc", "th", "at").mapInArrow(run, _SCHEMA)


def _several(heads: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The heads of anchors with two classes or more, and ``x, n`` of those anchors. Salts spread the heads of one anchor."""
    many = written(heads.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-anchors")
    salted = many.select("x", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<long>")).alias("salt"))
    asked = heads.withColumn("salt", F.pmod("c", F.lit(_SALTS))).join(salted, ["x", "salt"])
    return asked.select("x", "c", "doc", "th", "at"), many


def _surroundings(docs: DataFrame, asked: DataFrame, window: int, q: int) -> DataFrame:
    """``x, doc, th, at, left, right, c`` of the asked-for anchors: the bytes before (nearest first) and from the anchor on."""
    before = window - q
    per_doc = asked.groupBy("doc", "th").agg(F.collect_list("x").alias("xs"), F.collect_list("at").alias("ats"), F.collect_list("c").alias("cs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text", _SLICE):
            text = B.Text(batch.column(2))
            sizes = batch.column(3).value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at = batch.column(4).flatten().to_numpy().astype(np.int64)
            raw = text.data.tobytes()
            base, end = text.at[row], text.at[row + 1]
            here = base + at
            left = [raw[a:b][::-1] for a, b in zip(np.maximum(base, here - before).tolist(), here.tolist(), strict=True)]
            right = [raw[a:b] for a, b in zip(here.tolist(), np.minimum(end, here + window).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3).flatten(), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(4).flatten(), pa.array(left, pa.binary()), pa.array(right, pa.binary()), batch.column(5).flatten()], ["x", "doc", "th", "at", "left", "right", "c"])

    joined = docs.join(per_doc, ["doc", "th"]).select("doc", "th", "text", "xs", "ats", "cs")
    return joined.mapInArrow(run, "x long, doc long, th long, at int, left binary, right binary, c long")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of bytes, zero-padded, and their lengths."""
    text = B.Text(column)
    size = np.diff(text.at)
    out = np.zeros((text.n, width), np.uint8)
    out[np.arange(width) < size[:, None]] = text.data
    return out, size


def _order(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    pad = -rows.shape[1] % 8
    wide = np.pad(rows, ((0, 0), (0, pad))).view(">u8").astype(np.uint64)
    return np.lexsort([size, *(wide[:, k] for k in range(wide.shape[1] - 1, -1, -1)), group])


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows, ``most`` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The intervals (first, last, length) of the common-prefix tree with at least ``least`` bytes: one scan with a stack.

    ``lcp[i]`` is what entries i - 1 and i share.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        value, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            if length >= least:
                yield left, i - 1, length
        if not stack or stack[-1][0] < value:
            stack.append((value, left))


def maximal_repeats(x: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> Iterator[tuple[np.ndarray, int, int]]:
    """Groups of all occurrences (numbers of rows) of a repeat of ``window`` bytes or more, with its bytes before and from the anchor on.

    ``x`` numbers the anchors. The suffixes of each are sorted; an interval of their common-prefix tree is a set that can't be
    extended to the right. Its members are split by what stands to the left of them: a set with the same bytes there that has
    diverse ones next, and members in several branches of the interval, is a maximal repeat.
    """
    (lrows, lsize), (rrows, rsize) = left, right
    order = _order(x, rrows, rsize)
    r, rs, xs = rrows[order], rsize[order], x[order]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(xs[1:] == xs[:-1], _common(r[1:], r[:-1], np.minimum(rs[1:], rs[:-1])), 0)
    rank = np.empty(len(order), np.int64)
    rank[_order(x, lrows, lsize)] = np.arange(len(order))
    floor = window - lrows.shape[1]
    for first, last, length in intervals(lcp.tolist(), floor):
        members = order[first : last + 1]
        branch = np.cumsum(lcp[first : last + 1] == length)
        if len(members) == 2:
            i, j = members
            shared = int(_common(lrows[i : i + 1], lrows[j : j + 1], min(lsize[i], lsize[j]))[0])
            if shared + length >= window:
                yield members, shared, length
            continue
        by_left = np.argsort(rank[members])
        members, branch = members[by_left], branch[by_left]
        shared = np.zeros(len(members), np.int64)
        shared[1:] = _common(lrows[members[1:]], lrows[members[:-1]], np.minimum(lsize[members[1:]], lsize[members[:-1]]))
        least = window - length
        if least <= 0 and (shared[1:] == 0).any():
            yield members, 0, length
        hops = np.concatenate([[0], np.cumsum(branch[1:] != branch[:-1])])
        for a, b, extent in intervals(shared.tolist(), max(least, 1)):
            if hops[b] > hops[a]:
                yield members[a : b + 1], extent, length


def _by_anchor(around: DataFrame, scan, schema: str) -> DataFrame:
    """``scan`` of tables that hold all rows of their anchors, some _TREE_ROWS at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n <= _TREE_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = table.column(0).to_numpy()
            cut = int(np.searchsorted(x, x[-1], "left"))  # the last anchor may go on
            if cut:
                yield from scan(table.slice(0, cut))
            held, n = [table.slice(cut)], table.num_rows - cut
        if n:
            yield from scan(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return around.repartition(F.col("x")).sortWithinPartitions("x").mapInArrow(run, schema)


def _scan_trees(around: DataFrame, window: int, q: int) -> DataFrame:
    """Spans ``doc, th, at, to`` of all occurrences but the first of each maximal repeat, anchor by anchor."""
    before = window - q

    def scan(table: pa.RecordBatch):
        x, doc, th, at = (table.column(i).to_numpy() for i in range(4))
        order = np.lexsort((at, th, doc))
        d, t, a = doc[order], th[order], at[order]
        age = np.empty(len(x), np.int64)  # equal for the same place of a repeated row
        age[order] = np.cumsum(np.concatenate([[False], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1])]))
        out = []
        for members, a, b in maximal_repeats(x, _matrix(table.column(4), before), _matrix(table.column(5), window), window):
            later = members[age[members] != age[members].min()]
            out.append(np.stack([later, at[later] - a, at[later] + b]))
        if out:
            who, low, high = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in _merged(doc[who], th[who], low, high)], ["doc", "th", "at", "to"])

    return _by_anchor(around, scan, "doc long, th long, at long, to long")


def _scan_groups(around: DataFrame, window: int, q: int) -> DataFrame:
    """``g1, g2, length, x, c, back``: the classes of each maximal repeat, how far before the anchor it starts, and a hash of its bytes."""
    before = window - q

    def scan(table: pa.RecordBatch):
        x, c = table.column(0).to_numpy(), table.column(6).to_numpy()
        left, right = table.column(4).to_pylist(), table.column(5).to_pylist()
        members, backs, sizes, texts = [], [], [], []
        for who, a, b in maximal_repeats(x, _matrix(table.column(4), before), _matrix(table.column(5), window), window):
            members.append(who)
            backs.append(np.full(len(who), a))
            sizes.append(np.full(len(who), a + b))
            texts.append((left[who[0]][:a][::-1] + right[who[0]][:b], len(who)))
        if members:
            who = np.concatenate(members)
            text = B.Text(pa.array([t for t, _ in texts], pa.binary()))
            g1, g2 = (np.repeat(B.signed(h), [n for _, n in texts]) for h in text.hashes128(text.at[:-1], text.at[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (g1, g2, np.concatenate(sizes), x[who], c[who], np.concatenate(backs))], ["g1", "g2", "length", "x", "c", "back"])

    return _by_anchor(around, scan, "g1 long, g2 long, length long, x long, c long, back long")


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, q: int = Q, most_classes: int = MOST_CLASSES) -> DataFrame:
    """``g1, g2, length, doc, start``: every group of equal strings of ``window`` bytes or more, with all of its occurrences.

    Groups are the maximal repeats among the surroundings of an anchor: strings that some occurrences have in common and that
    can't be extended without losing one or leaving the surroundings (``window - q`` bytes before the anchor, ``window`` from it
    on). A longer repeat is given from each of its anchors; all its windows are in some group. ``g1, g2`` are a hash of the
    bytes; ``doc`` is the id, or its number in the order of ids that aren't integers. Of anchors with more than
    ``most_classes`` surroundings, the shared windows are the groups. Null and empty texts have no repeats; rows with the same
    id and text are one document; an empty table gives an empty result.
    """
    docs = numbered(docs, id_col, "_number")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce("_number", F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).dropDuplicates(["doc", "th"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text", _SLICE):
            who, at, x, c = anchors(B.Text(batch.column(2)), window, q)
            yield _rows(_ANCHOR, B.signed(x), B.signed(c), batch.column(0).to_numpy()[who], batch.column(1).to_numpy()[who], at, -1)

    every = written(keyed.mapInArrow(places, _SCHEMA).select("x", "c", "doc", "th", "at"), "groups-places")
    place = F.struct("doc", "th", "at")
    classes = written(every.groupBy("x", "c").agg(F.min(place).alias("first"), F.count("*").alias("n")).select("x", "c", "first.*", "n"), "groups-classes")
    heads = classes.select("x", "c", "doc", "th", "at")
    asked, many = _several(heads, "groups")
    dense = many.where(F.col("n") > most_classes).select("x")
    around = written(_surroundings(keyed, asked.join(dense, "x", "left_anti"), window, q), "groups-surroundings")
    # a class of several occurrences is a group by itself: its whole surroundings
    whole = written(_surroundings(keyed, classes.where("n > 1").select(*heads.columns), window, q), "groups-whole")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            text = B.Text(pa.array([a[::-1] + b for a, b in zip(table.column(4).to_pylist(), table.column(5).to_pylist(), strict=True)], pa.binary()))
            back = np.diff(B.Text(table.column(4)).at)
            g1, g2 = text.hashes128(text.at[:-1], text.at[1:])
            size = np.diff(text.at)
            found = pa.RecordBatch.from_arrays([pa.array(B.signed(g1)), pa.array(B.signed(g2)), pa.array(size), table.column(0), table.column(6), pa.array(back)], ["g1", "g2", "length", "x", "c", "back"])
            yield found.filter(pa.array(size >= window))

    schema = "g1 long, g2 long, length long, x long, c long, back long"
    found = written(_scan_groups(around, window, q).unionByName(whole.mapInArrow(full, schema)), "groups-found")
    out = found.join(every, ["x", "c"]).select("g1", "g2", "length", "doc", "th", (F.col("at") - F.col("back")).alias("start"))
    if dense.limit(1).count():
        thick = written(_windows_of_dense(_surroundings(keyed, every.join(dense, "x", "left_semi"), window, q).drop("c"), window, q), "groups-dense")
        shared = thick.groupBy("x", "c").agg(F.count("*").alias("n")).where("n > 1").select("x", "c")
        out = out.unionByName(thick.join(shared, ["x", "c"]).select(F.col("x").alias("g1"), F.col("c").alias("g2"), F.lit(window).cast("long").alias("length"), "doc", "th", F.col("at").alias("start")))
    return out.distinct().select("g1", "g2", "length", F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc"), "start")


def _neighbours(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows, one by one to the end, with the most that each shares with a row of its anchor: that is with the one before or after it."""
    held, share_before = None, 0
    for batch in batches:
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        x = table.column(0).to_numpy()
        rows, size = _matrix(table.column(column), width)
        share = np.zeros(len(x), np.int64)
        share[0] = share_before
        share[1:] = np.where(x[1:] == x[:-1], _common(rows[1:], rows[:-1], np.minimum(size[1:], size[:-1])), 0)
        if len(x) > 1:
            yield table.slice(0, len(x) - 1), np.maximum(share[:-1], share[1:])
        held, share_before = table.slice(len(x) - 1), int(share[-1])
    if held is not None:
        yield held, np.array([share_before])


def _windows_of_dense(around: DataFrame, window: int, q: int) -> DataFrame:
    """``x, c, doc, th, at, to``: the hashes of those windows around anchors of many classes that may occur again.

    A window can only be shared if some other class of the anchor shares as much to the right, and some class as much to the
    left; sorting by either side tells how much that is, as rows stream by.
    """
    before = window - q

    def to_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, share in _neighbours(batches, 5, window):
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(share.astype(np.int32))], [*table.schema.names, "reach"])

    def to_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, share in _neighbours(batches, 4, before):
            doc, th, at = (table.column(i).to_numpy() for i in range(1, 4))
            least = np.maximum(window - table.column(6).to_numpy().astype(np.int64), 0)
            n = np.maximum(np.minimum(share, before) - least + 1, 0)
            for lo in range(0, len(n), 4096):  # bounds the windows at hand
                part = slice(lo, lo + 4096)
                row = np.repeat(np.arange(len(n))[part], n[part])
                if not len(row):
                    continue
                back = least[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                cut = table.slice(lo, 4096)
                joined = B.Text(pa.array([a[::-1] + b for a, b in zip(cut.column(4).to_pylist(), cut.column(5).to_pylist(), strict=True)], pa.binary()))
                room = np.diff(B.Text(cut.column(4)).at)
                start = joined.at[row - lo] + room[row - lo] - back
                h1, h2 = joined.hashes128(start, start + window)
                begin = at[row] - back
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(h1)), pa.array(B.signed(h2)), pa.array(doc[row]), pa.array(th[row]), pa.array(begin), pa.array(begin + window)], ["x", "c", "doc", "th", "at", "to"])

    sides = "x long, doc long, th long, at int, left binary, right binary"
    ranked = around.repartition(F.col("x")).sortWithinPartitions("x", "right").mapInArrow(to_right, sides + ", reach int")
    return ranked.repartition(F.col("x")).sortWithinPartitions("x", "left").mapInArrow(to_left, "x long, c long, doc long, th long, at long, to long")


def _later_windows(rows: DataFrame) -> DataFrame:
    """Spans of windows that also start earlier, for windows given one by one."""
    place = F.struct("doc", "th", "at")
    first = rows.groupBy("x", "c").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("x", "c", "first")
    return rows.join(first, ["x", "c"]).where(place > F.col("first")).select("doc", "th", "at", "to")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, q: int = Q, most_classes: int = MOST_CLASSES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of ``docs`` with ``kept`` (the remaining bytes), ``n_bytes, n_removed, n_spans``.

    A byte is removed if a string of ``window`` bytes that covers it also starts earlier: in a document with a smaller id, or
    before in the same one (ids of any type that has an order). Strings are judged on the input and don't cross documents; ``n_spans`` counts the maximal removed
    runs. Null texts are empty. Null ids come last. Rows that share an id come in the order of a hash of their texts; equal
    rows are one document and get equal results. Columns that have a name of the result are replaced; an empty table gives an
    empty result. Strings of equal 128-bit hashes count as equal where an anchor's classes are formed.
    """
    made = ("kept", "n_bytes", "n_removed", "n_spans")
    names = [c for c in (keep or docs.columns) if c not in made]
    docs = numbered(docs, id_col, "_number")
    doc = F.coalesce("_number", F.lit(_LAST))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(doc.alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = written(_classes(_first_of_classes(keyed, window, q), window, q), "repeat-classes")
    asked = found.where(F.col("kind") == _HEAD).select("x", "c", "doc", "th", "at")
    around = written(_surroundings(keyed, asked, window, q), "repeat-surroundings")
    dense = written(around.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > most_classes).select("x"), "repeat-dense")
    spans = found.where(F.col("kind") == _SPAN).select("doc", "th", F.col("at").cast("long").alias("at"), F.col("to").cast("long").alias("to"))
    spans = spans.unionByName(_scan_trees(around.join(dense, "x", "left_anti"), window, q))
    if dense.limit(1).count():
        spans = spans.unionByName(_later_windows(_windows_of_dense(around.join(dense, "x", "left_semi").drop("c"), window, q)))
    per_doc = spans.groupBy("doc", "th").agg(F.collect_list("at").alias("ats"), F.collect_list("to").alias("tos"))
    cols = {f"_{i}": F.col(c) for i, c in enumerate(names)}
    aliases = list(cols)
    every = docs.select(*[c.alias(k) for k, c in cols.items()], doc.alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    joined = every.join(per_doc, ["doc", "th"], "left").select(*cols, "text", "ats", "tos")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, "text"):
            text = B.Text(batch.column(len(aliases)))
            ats, tos = batch.column(len(aliases) + 1), batch.column(len(aliases) + 2)
            n = np.diff(text.at)
            row = np.repeat(np.arange(text.n), ats.value_lengths().fill_null(0).to_numpy())
            low = text.at[row] + np.maximum(ats.flatten().to_numpy(), 0)
            high = np.minimum(text.at[row] + tos.flatten().to_numpy(), text.at[row + 1])
            depth = np.zeros(len(text.data) + 1, np.int64)
            np.add.at(depth, low, 1)
            np.add.at(depth, high, -1)
            gone = np.cumsum(depth[:-1]) > 0
            upto = np.concatenate([[0], np.cumsum(gone)])
            fresh = gone.copy()
            fresh[1:] &= ~gone[:-1]
            edge = text.at[:-1][n > 0]
            fresh[edge] = gone[edge]
            runs = np.concatenate([[0], np.cumsum(fresh)])
            stay = text.data[~gone]
            at = text.at - upto[text.at]
            kept = [stay[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            arrays = [*batch.columns[: len(aliases)], pa.array(kept, pa.binary()), pa.array(n), pa.array(np.diff(upto[text.at])), pa.array(np.diff(runs[text.at]))]
            yield pa.RecordBatch.from_arrays(arrays, [*aliases, *made])

    schema = docs.select(*[c.alias(k) for k, c in cols.items()]).schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    out = joined.mapInArrow(cut, schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(cols, names, strict=True)], *made)
