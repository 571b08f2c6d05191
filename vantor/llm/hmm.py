"""Language-model scores: exact sequence likelihoods of a hidden Markov model trained by Baum-Welch over all training documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.llm import _bytes as B
from vantor.llm._store import Table, forget, written

STATES = 8
#: Baum-Welch makes at least and at most so many passes; between, it stops when a pass gains less than TOLERANCE a token (log10).
LEAST_PASSES, MOST_PASSES, TOLERANCE = 5, 12, 0.01
#: While the states are learnt, so many of the most frequent tokens have emissions of their own and all others share one. The
#: last pass then gives every token of the vocabulary its own.
SYMBOLS = 1 << 14
#: Counts and emissions of so many frequent tokens are broadcast (44 bytes each); those of all others are joined.
FREQUENT = 1 << 18
#: How many occurrences of the average token a token's own occurrences are weighed against when its states are estimated.
PRIOR = 2.0
#: Tokens that a task reads together, and puts through the model at once; texts of like lengths go together, as a step is taken
#: for each token of the longest.
GROUP, PIECE = 1 << 22, 3 << 19
END = np.uint64(0)
_PART = 1 << 10
#: Tokens whose expected counts a task holds.
_HELD = 1 << 19


def tokens(text: B.Text) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's text, and the hash of the token: the lower-cased words, then one end for each text."""
    low = text.lowered()
    starts, ends = low.words(B.NON_SPACE)
    who = low.owner(starts)
    n = np.bincount(who, minlength=text.n)
    at = np.arange(len(starts)) + who
    out, owner = np.full(len(starts) + text.n, END, np.uint64), np.empty(len(starts) + text.n, np.int64)
    out[at] = low.hashes(starts, ends)
    owner[at] = who
    owner[np.cumsum(n + 1) - 1] = np.arange(text.n)
    return owner, out


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, c``: the count of every token of ``docs``, summed in the tasks before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def give():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(B.signed(h)), pa.array(c)], ["h", "c"])

        for batch in B.slices(batches, text_col):
            held.append(tokens(B.Text(batch.column(0)))[1])
            n += len(held[-1])
            if n > 2 * PIECE:
                yield give()
                held, n = [], 0
        if n:
            yield give()

    return docs.select(text_col).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Unigrams:
    """Totals of the training tokens, and the counts of the frequent ones sorted by hash; ``symbols`` numbers them by falling count.

    The first ``own`` symbols have emissions of their own while the states are learnt.
    """

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    own: int

    @property
    def denominator(self) -> float:
        return float(self.total + self.distinct + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places among the frequent tokens; -1: not one of them."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def symbol_shares(self) -> np.ndarray:
        """The probability of each symbol with an emission of its own; the last is that of all other tokens, unknown ones included."""
        shares = np.zeros(self.own + 1)
        mine = self.symbols < self.own
        shares[self.symbols[mine]] = (self.counts[mine] + 1) / self.denominator
        shares[self.own] = max(1.0 - shares.sum(), 1.0 / self.denominator)
        return shares


def unigrams(counts: DataFrame, frequent: int = FREQUENT, symbols: int = SYMBOLS) -> Unigrams:
    """Totals, and the tokens with counts from the least one on for which at most ``frequent`` tokens are there.

    The bound is found from a histogram of a few hundred rows, so no task sorts the vocabulary.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("c") * 16)
    bound, so_far = None, 0
    for at, n in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        so_far += n
        if so_far > frequent:
            break
        bound = at
    top = counts.where(step >= bound if bound is not None else F.lit(False)).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    rank = np.lexsort((h, -c))
    symbol = np.empty(len(h), np.int64)
    symbol[rank] = np.arange(len(h))
    order = np.argsort(h)
    return Unigrams(int(total), int(distinct), h[order], c[order].astype(np.int64), symbol[order], min(symbols, len(h)))


def _pieces(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents of like lengths with about PIECE tokens together, and the places of their tokens."""
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    upto = np.cumsum(lengths[order])
    lo = 0
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECE, "right")))
        docs = order[lo:hi]
        n = lengths[docs]
        yield docs, np.repeat(begin[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        lo = hi


def _stretches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring sizes together, up to about ``most``."""
    lo, n = 0, 0
    for k, size in enumerate(sizes):
        n += size
        if n >= most or k + 1 == len(sizes):
            yield lo, k + 1
            lo, n = k + 1, 0


@dataclass
class HiddenMarkov:
    """``emit`` has a state's probabilities relative to the symbols' overall shares, one row for each symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    shares: np.ndarray

    @classmethod
    def fresh(cls, shares: np.ndarray, states: int, seed: int = 11) -> HiddenMarkov:
        rng = np.random.default_rng(seed)
        emit = np.exp(rng.normal(0, 0.7, (len(shares), states)))
        emit /= shares @ emit
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit, shares)

    def _layout(self, lengths: np.ndarray):
        """Documents by falling length, so that those that have a step are the first ones."""
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        at = (np.cumsum(lengths) - lengths)[order]
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left") if len(sizes) else np.zeros(0, np.int64)
        return order, at, live

    def forward(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each document's likelihood relative to the shares of its symbols; scaled at each step."""
        found = np.empty(len(lengths))
        for docs, mine in _pieces(lengths):
            found[docs] = self._forward(symbols[mine], lengths[docs])
        return found

    def _forward(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order, at, live = self._layout(lengths)
        ones = np.ones(len(self.start), self.emit.dtype)
        out, alpha = np.zeros(len(lengths)), None
        for t, n in enumerate(live.tolist()):
            alpha = (self.start if alpha is None else alpha[:n] @ self.move) * self.emit[symbols[at[:n] + t]]
            scale = alpha @ ones
            alpha /= scale[:, None]
            out[:n] += np.log10(scale)
        found = np.empty(len(lengths))
        found[order] = out
        return found

    def expect(self, symbols: np.ndarray, lengths: np.ndarray, cells: np.ndarray | None = None, n_cells: int = 0) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood and expected counts of starts, moves and emissions; those of emissions by the tokens' ``cells`` if given, else by symbol.

        Forward probabilities are scaled at each step. Going back, those of the states given the whole text follow from them
        and from what each step had predicted for the next one, so emissions are looked up once.
        """
        if cells is None:
            cells, n_cells = symbols, len(self.shares)
        states = len(self.start)
        total, starts, moves, emits = 0.0, np.zeros(states), np.zeros((states, states)), np.zeros((n_cells, states))
        half = tuple(v.astype(np.float32) for v in (self.start, self.move, self.emit))
        for docs, mine in _pieces(lengths):
            total += self._expect(half, symbols[mine], lengths[docs], cells[mine], starts, moves, emits)
        return total, starts, moves * self.move, emits

    def _expect(self, half, symbols, lengths, cells, starts, moves, emits) -> float:
        """Adds the expected counts (of moves without the model's own) to the arrays; the log-likelihood."""
        start, move, emit = half
        states, n_cells = len(start), len(emits)
        _, at, live = self._layout(lengths)
        steps = live.tolist()
        ones, total = np.ones(states, np.float32), 0.0
        alphas, predicted = [], []
        pred = np.broadcast_to(start, (steps[0], states))
        for t, n in enumerate(steps):
            if t:
                pred = alphas[-1][:n] @ move
            alpha = pred * emit[symbols[at[:n] + t]]
            scale = alpha @ ones
            alpha /= scale[:, None]
            total += float(np.log10(scale, dtype=np.float64).sum())
            alphas.append(alpha)
            predicted.append(pred)
        back = np.ascontiguousarray(move.T)
        for t in range(len(steps) - 2, -1, -1):
            m = steps[t + 1]
            ratio = alphas[t + 1] / predicted[t + 1]
            predicted[t + 1] = None
            moves += alphas[t][:m].T @ ratio
            alphas[t][:m] *= ratio @ back
        starts += alphas[0].sum(0, dtype=np.float64)
        for lo, hi in _stretches(steps, 1 << 18):
            gamma = np.concatenate(alphas[lo:hi]).T
            place = np.concatenate([cells[at[:n] + t] for t, n in enumerate(steps[lo:hi], lo)])
            for k in range(states):
                emits[:, k] += np.bincount(place, gamma[k], n_cells)
        return total

    def updated(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> HiddenMarkov:
        """The next model; a few counts of the overall shares keep every probability above zero."""
        move = moves + 1.0
        emits = emits + 20.0 * self.shares[:, None]
        emit = emits / emits.sum(0) / self.shares[:, None]
        start = starts + 1.0
        return HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), emit, self.shares)


def encode(docs: DataFrame, known: Unigrams, text_col: str = "text") -> DataFrame:
    """``docs`` without the text but with ``row`` (a number of the row), its symbols, sums over its frequent tokens, and its other tokens with their counts.

    A symbol of -1 - k stands for the row's k-th other token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    names = [c for c in numbered.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni = shared.value
        logs = np.log10((uni.counts + 1) / uni.denominator)
        for batch in B.slices(batches, text_col):
            text = B.Text(batch.column(batch.schema.get_field_index(text_col)))
            who, h = tokens(text)
            place = uni.find(h)
            seen = place >= 0
            symbol = np.empty(len(h), np.int32)
            if seen.any():
                symbol[seen] = uni.symbols[place[seen]]
            n = np.bincount(who, minlength=text.n)
            sums = np.bincount(who[seen], logs[place[seen]] if seen.any() else None, text.n)
            rare_who, rare = who[~seen], h[~seen]
            order = np.lexsort((rare, rare_who))
            rare_who, rare = rare_who[order], rare[order]
            fresh = np.concatenate([[True], (rare[1:] != rare[:-1]) | (rare_who[1:] != rare_who[:-1])])[: len(rare)]
            edge = np.flatnonzero(fresh)
            times = np.diff(np.append(edge, len(rare))).astype(np.int32)
            begin = np.searchsorted(rare_who[edge], np.arange(text.n + 1))
            number = np.empty(len(rare), np.int64)
            number[order] = np.cumsum(fresh) - 1 - begin[rare_who]
            symbol[~seen] = -1 - number
            cut = pa.array(begin.astype(np.int32))
            arrays = [
                pa.array(n), pa.array(np.bincount(who[seen], minlength=text.n)), pa.array(sums.astype(np.float64)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(symbol)),
                pa.ListArray.from_arrays(cut, pa.array(B.signed(rare[edge]))), pa.ListArray.from_arrays(cut, pa.array(times)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *arrays], [*names, "n_tokens", "n_frequent", "frequent_log", "symbols", "rare", "times"])

    schema = numbered.drop(text_col).schema
    for c, t in (("n_tokens", "long"), ("n_frequent", "long"), ("frequent_log", "double"), ("symbols", T.ArrayType(T.IntegerType())), ("rare", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.IntegerType()))):
        schema = schema.add(c, t)
    return numbered.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Symbols and lengths of rows together up to the size of a group."""
    held, n = [], 0
    for batch in batches:
        row = 0
        sizes = batch.column(column).value_lengths().to_numpy()
        upto = np.concatenate([[0], np.cumsum(sizes)])
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(upto, upto[row] + GROUP - n, "right")) - 1)
            held.append(batch.slice(row, end - row))
            n += int(upto[end] - upto[row])
            row = end
            if n >= GROUP:
                yield _joined(held, column)
                held, n = [], 0
    if held:
        yield _joined(held, column)


def _joined(held: list[pa.RecordBatch], column: int):
    parts = [b.column(column) for b in held]
    return np.concatenate([p.flatten().to_numpy() for p in parts]), np.concatenate([p.value_lengths().to_numpy() for p in parts]).astype(np.int64), held


def _core(symbols: np.ndarray, own: int) -> np.ndarray:
    """Symbols with those that have no emissions of their own yet as one."""
    return np.where((symbols < 0) | (symbols >= own), own, symbols)


def baum_welch(encoded: DataFrame, shares: np.ndarray, states: int = STATES, least: int = LEAST_PASSES, most: int = MOST_PASSES, tolerance: float = TOLERANCE) -> tuple[HiddenMarkov, list[float]]:
    """The model after some passes over all ``symbols``, and the log10 likelihoods (relative to the shares) before each.

    Tasks send their expected counts in parts of fixed size, which are summed by part; the driver gets one model's worth.
    """
    spark, model, course, own = encoded.sparkSession, HiddenMarkov.fresh(shares, states), [], len(shares) - 1
    for _ in range(most):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for symbols, lengths, _ in _groups(batches, 0):
                log, starts, moves, emits = shared.value.expect(_core(symbols, own), lengths)
                flat = np.concatenate([[log], starts, moves.ravel(), emits.ravel()])
                total = flat if total is None else total + flat
            if total is not None:
                cut = np.append(np.arange(0, len(total), _PART * states), len(total)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut) - 1, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(total))], ["part", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = x.values.to_numpy()
                    sums[part] = sums[part] + x if part in sums else x
            for part, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x], pa.list_(pa.float64()))], ["part", "sums"])

        schema = "part int, sums array<double>"
        rows = encoded.select("symbols").mapInArrow(expect, schema).repartition(F.col("part")).mapInArrow(add, schema).toArrow().sort_by("part")
        shared.unpersist()
        if not rows.num_rows:
            break
        flat = rows.column("sums").combine_chunks().flatten().to_numpy()
        course.append(float(flat[0]))
        starts, moves, emits = np.split(flat[1:], [states, states + states * states])
        model = model.updated(starts, moves.reshape(states, states), emits.reshape(-1, states))
        if len(course) >= max(least, 2) and course[-1] - course[-2] < tolerance * emits.sum():
            break
    return model, course


def token_states(encoded: DataFrame, model: HiddenMarkov, known: Unigrams) -> tuple[np.ndarray, Table]:
    """The expected counts of every training token in each state, from one more pass: of the frequent ones by symbol, and a table that has ``h, g`` of all others (where ``part`` is below 0).

    Tasks sum before they send: the frequent ones as arrays in parts of fixed size, the others one row a token and task. One
    shuffle brings equal parts and equal tokens together, sorted, where they are summed as they stream by.
    """
    spark, own, states, frequent = encoded.sparkSession, len(model.shares) - 1, len(model.start), len(known.hashes)
    shared = spark.sparkContext.broadcast(model)
    width = _PART * states

    def lists(g: np.ndarray, of: int):
        flat = g.ravel().astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(flat), of), len(flat)).astype(np.int32)), pa.array(flat))

    def rows(part, h, g):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(part, len(g)).astype(np.int32)), pa.array(np.broadcast_to(h, len(g)).astype(np.int64)), g], ["part", "h", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = np.zeros((frequent, states))
        held_h, held_g = np.zeros(0, np.uint64), np.zeros((0, states))
        some = False
        for symbols, lengths, held in _groups(batches, 0):
            others = [b.column(1) for b in held]
            sizes = np.concatenate([x.value_lengths().to_numpy() for x in others]).astype(np.int64)
            rare = np.concatenate([x.flatten().to_numpy() for x in others]).view(np.uint64)
            at = np.flatnonzero(symbols < 0)
            base = np.repeat(np.cumsum(sizes) - sizes, lengths)[at]
            one, place = np.unique(rare[base - 1 - symbols[at]], return_inverse=True)
            cells = symbols.astype(np.int64)
            cells[at] = frequent + place
            _, _, _, emits = model.expect(_core(symbols, own), lengths, cells, frequent + len(one))
            dense += emits[:frequent]
            some = True
            held_h, place = np.unique(np.concatenate([held_h, one]), return_inverse=True)
            g = np.concatenate([held_g, emits[frequent:]])
            held_g = np.stack([np.bincount(place, g[:, k], len(held_h)) for k in range(states)], 1)
            if len(held_h) > _HELD:
                yield rows(-1, B.signed(held_h), lists(held_g, states))
                held_h, held_g = held_h[:0], held_g[:0]
        if len(held_h):
            yield rows(-1, B.signed(held_h), lists(held_g, states))
        if some and frequent:
            parts = lists(dense.astype(np.float32), width)
            yield rows(np.arange(len(parts)), 0, parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        last_h, last_g = np.zeros(0, np.int64), np.zeros((0, states))
        for batch in batches:
            part, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in np.flatnonzero(part >= 0).tolist():
                x = batch.column(2)[k].values.to_numpy().astype(np.float64)
                parts[int(part[k])] = parts[int(part[k])] + x if int(part[k]) in parts else x
            mine = batch.filter(pa.array(part < 0))
            if not mine.num_rows:
                continue
            h = np.concatenate([last_h, mine.column(1).to_numpy()])
            g = np.concatenate([last_g, mine.column(2).flatten().to_numpy().reshape(-1, states)])
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, g = h[edge], np.add.reduceat(g, edge, axis=0)
            if len(h) > 1:
                yield rows(-1, h[:-1], lists(g[:-1], states))
            last_h, last_g = h[-1:], g[-1:]
        if len(last_h):
            yield rows(-1, last_h, lists(last_g, states))
        for k, x in parts.items():
            yield rows(k, 0, lists(x, len(x)))

    sent = encoded.select("symbols", "rare").mapInArrow(run, "part int, h long, g array<float>")
    table = Table(sent.repartition(F.xxhash64("part", "h")).sortWithinPartitions("part", "h").mapInArrow(add, "part int, h long, g array<float>"), "hmm-states")
    dense = table.df.where("part >= 0").select("part", "g").toArrow().sort_by("part").column("g").combine_chunks()  # FREQUENT tokens at most
    flat = dense.flatten().to_numpy().astype(np.float64) if len(dense) else np.zeros(0)
    return (flat.reshape(-1, states) if len(flat) else np.zeros((frequent, states))), table


def emissions(frequent: np.ndarray, tokens: DataFrame, counts: DataFrame, known: Unigrams, prior: float = PRIOR) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Each token's probabilities in each state relative to its overall share: of the frequent ones by symbol, ``h, c, e`` of all others, and of unknown ones.

    A token's states are estimated from its expected counts and ``prior`` occurrences of the average token. Together with
    one unknown token the probabilities of a state sum to one.
    """
    states = frequent.shape[1]
    first = tokens.agg(*[F.sum(F.get("g", F.lit(k))).alias(f"s{k}") for k in range(states)]).first()
    sums = frequent.sum(0) + np.array([x or 0.0 for x in first], float)
    overall = np.maximum(sums / sums.sum() if sums.sum() else np.full(states, 1 / states), 1e-9)
    by_symbol = np.empty(len(known.counts))
    by_symbol[known.symbols] = known.counts
    mine = (frequent + prior * overall) / (by_symbol + prior)[:, None] / overall
    raw = [(F.get("g", F.lit(k)) + F.lit(float(prior * overall[k]))) / (F.col("c") + F.lit(float(prior))) / F.lit(float(overall[k])) for k in range(states)]
    joined = tokens.join(counts, "h").select("h", "c", F.array(*raw).alias("r"))
    share = (F.col("c") + 1) / F.lit(known.denominator)
    norm = joined.agg(*[F.sum(share * F.get("r", F.lit(k))).alias(f"z{k}") for k in range(states)]).first()
    z = (by_symbol + 1) @ mine / known.denominator + np.array([x or 0.0 for x in norm], float) + 1.0 / known.denominator
    return mine / z, joined.select("h", "c", F.array(*[(F.get("r", F.lit(k)) / F.lit(float(z[k]))).cast("float") for k in range(states)]).alias("e")), 1.0 / z


def score(docs: DataFrame, training: Column, text_col: str = "text", keep: tuple[str, ...] | None = None, states: int = STATES, frequent: int = FREQUENT, symbols: int = SYMBOLS) -> DataFrame:
    """The kept columns of ``docs`` with ``n_tokens, n_known, train_tokens, base_score, score``; the rows where ``training`` holds are learnt from.

    ``base_score`` is the log10 probability under add-one unigrams of all training tokens, exact for every token. ``score`` is
    the log10 probability under the hidden Markov model, in which every token of the vocabulary has emissions of its own.
    Counts and emissions of frequent tokens are broadcast, those of all others joined. Null and empty texts are one end.
    Repeated rows are scored alike, and count again in training. Without training rows every token is unknown. Columns that
    have a name of the result are replaced; an empty table gives an empty result.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = [c for c in (keep or docs.columns) if c not in made]
    vocabulary_table = Table(vocabulary(docs.where(training), text_col), "hmm-vocabulary")
    counts = vocabulary_table.df
    uni = unigrams(counts, frequent, symbols)
    cols = {f"_{i}": F.col(c) for i, c in enumerate(names)}
    rows = docs.select(*[c.alias(n) for n, c in cols.items()], F.coalesce(training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    encoded = written(encode(rows, uni), "hmm-encoded")
    model, _ = baum_welch(encoded.where("training"), uni.symbol_shares(), states)
    forget(docs.sparkSession)  # the shuffles of the passes
    dense, states_table = token_states(encoded.where("training"), model, uni)
    tokens = states_table.df.where("part < 0").select("h", "g")
    common, table, unknown = emissions(dense, tokens, counts, uni)
    table = written(table, "hmm-emissions")
    vocabulary_table.drop()
    states_table.drop()
    forget(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.start, model.move, np.concatenate([common, unknown[None, :]])))
    denominator = uni.denominator

    pairs = encoded.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("k", "x")).select("row", "k", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(denominator))
    of_row = pairs.join(table, "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * log).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_rare"),
        F.collect_list(F.when(F.col("c") > 0, F.col("k"))).alias("ks"), F.flatten(F.collect_list("e")).alias("es"),
    )
    joined = encoded.join(of_row, "row", "left").select("symbols", "ks", "es", *cols, "n_tokens", "n_frequent", "frequent_log", "rare_log", "n_rare")

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = shared.value
        for syms, lengths, held in _groups(batches, 0):
            ks = [b.column(1).fill_null([]) if b.column(1).null_count else b.column(1) for b in held]
            sizes = np.concatenate([x.value_lengths().to_numpy() for x in ks]).astype(np.int64)
            k = np.concatenate([x.flatten().to_numpy() for x in ks]).astype(np.int64)
            e = np.concatenate([b.column(2).flatten().to_numpy() for b in held]).reshape(-1, len(start)).astype(np.float64)
            # a cell for each known other token of a row, after those of the symbols; all others are unknown
            row = np.repeat(np.arange(len(lengths)), sizes)
            most = np.zeros(len(lengths), np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            other = np.flatnonzero(syms < 0)
            np.maximum.at(most, owner[other], -syms[other].astype(np.int64))
            begin = np.cumsum(most) - most
            cell = np.full(int(most.sum()), len(emit) - 1)
            cell[begin[row] + k] = len(emit) + np.arange(len(k))
            index = syms.astype(np.int64)
            index[other] = cell[begin[owner[other]] - 1 - syms[other]]
            gain = HiddenMarkov(start, move, np.concatenate([emit, e]), np.zeros(0)).forward(index, lengths)
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(gain[at : at + b.num_rows])], [*b.schema.names[3:], "gain"])
                at += b.num_rows

    found = joined.mapInArrow(likelihood, joined.drop("symbols", "ks", "es").schema.add("gain", "double"))
    base = F.col("frequent_log") + F.coalesce("rare_log", F.lit(0.0))
    return found.select(
        *[F.col(k).alias(n) for k, n in zip(cols, names, strict=True)],
        "n_tokens", (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(uni.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )
