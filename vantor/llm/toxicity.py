"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.llm import _bytes as B
from vantor.llm._store import forget, trim, written

#: Terms are hashed to 2 ** BITS places.
BITS = 18
RANK = 4
#: Bytes of the stems that are terms besides whole words.
STEMS = (4, 6)
#: The machine is fitted on at most this many labelled documents, those with the smallest hash of their id, and on fewer where
#: they have more than ``TRAIN_TERMS`` terms together.
TRAIN_ROWS = 16_000
TRAIN_TERMS = 1 << 24
EPOCHS = 12
#: Standard errors from which on a term counts as telling the classes apart.
LUCK = 3.0


def terms(text: B.Text, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text, sorted: the text's number and the term.

    Terms are the lower-cased words, and the first bytes of longer words, as languages build many forms on one stem.
    """
    low = text.lowered()
    starts, ends = low.words(B.ALNUM)
    owner, sums = low.owner(starts) << bits, low.sums()
    found = [owner | (low.hashes(starts, ends, sums=sums) >> np.uint64(64 - bits)).astype(np.int64)]
    for stem in STEMS:
        longer = np.flatnonzero(ends - starts > stem)
        at = starts[longer]
        h = low.hashes(at, at + stem, sums=sums) ^ np.uint64(0x5555555555555555)
        found.append(owner[longer] | (h >> np.uint64(64 - bits)).astype(np.int64))
    once = np.unique(np.concatenate(found))
    return once >> bits, once & ((1 << bits) - 1)


@dataclass
class FactorizationMachine:
    """``bias + sum w[i] + sum over pairs <v[i], v[j]>`` of a document's terms, through the logistic function."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(owner, self.linear[term], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return out

    def score(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(owner, term, n), -35, 35)))


def fit(sets: list[np.ndarray], labels: np.ndarray, bits: int = BITS, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 0.3, batch: int = 256, seed: int = 7) -> FactorizationMachine:
    """Minimises the logistic loss by AdaGrad over shuffled batches; classes are weighed equally.

    Every place has parameters. A term's steps shrink with the chance that it tells the classes apart by luck alone: those of
    a term in few documents, or in as many of both classes as all terms are, stay near zero.
    """
    size = 1 << bits
    machine = FactorizationMachine(0.0, np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    if not len(sets):
        return machine

    def of(who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some documents, and which of them each belongs to; all terms at once would fill the driver."""
        return np.concatenate([sets[k] for k in who]), np.repeat(np.arange(len(who)), [len(sets[k]) for k in who])

    seen, marked = np.zeros(size, np.int64), np.zeros(size)
    for at in range(0, len(sets), batch):
        who = np.arange(at, min(at + batch, len(sets)))
        term, mine = of(who)
        seen += np.bincount(term, minlength=size)
        marked += np.bincount(term, labels[who][mine], size)
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    # the difference of a term's share of labelled documents from the overall share, in standard errors
    pull = np.abs(marked - share * seen) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9) + 1.0)
    trust = (1 / (1 + np.exp(-2 * (pull - LUCK)))).astype(np.float32)
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(size, np.float32), rng.normal(0, 0.01, (size, rank)).astype(np.float32) * trust[:, None], 0.0
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, rank), 1e-6, np.float32), 1e-6
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(sets))
        for at in range(0, len(order), batch):
            who = order[at : at + batch]
            term, mine = of(who)
            here, local = np.unique(term, return_inverse=True)
            vt = v[term]
            sums = np.stack([np.bincount(mine, vt[:, f], len(who)) for f in range(rank)], 1)
            squares = np.bincount(mine, (vt * vt).sum(1), len(who))
            raw = bias + np.bincount(mine, w[term], len(who)) + 0.5 * ((sums**2).sum(1) - squares)
            error = weight[who] * (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[who]) / len(who)
            e = error[mine]
            t = trust[here]
            d = np.bincount(local, e, len(here)) + decay * w[here] / len(who)
            gw[here] += d * d
            w[here] -= rate * t * d / np.sqrt(gw[here])
            for f in range(rank):
                d = np.bincount(local, e * (sums[mine, f] - vt[:, f]), len(here)) + decay * v[here, f] / len(who)
                gv[here, f] += d * d
                v[here, f] -= 0.2 * rate * t * d / np.sqrt(gv[here, f])
            d = error.sum()
            gb += d * d
            bias -= rate * d / np.sqrt(gb)
    return FactorizationMachine(float(bias), w, v)


def bucket_of(id_col: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``."""
    return F.crc32(id_col.cast("string").cast("binary")) % buckets


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """The machine fitted on the labelled documents, of which ``rows`` at most are read (the smallest hashes of their ids).

    Rows without id or label are left out. The sample's hashed terms are what the driver gets: of the documents in the order of
    their hashes, as many as have ``TRAIN_TERMS`` terms together.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(id_col, F.col(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col, "_label").limit(rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, text_col):
            owner, term = terms(B.Text(batch.column(batch.schema.get_field_index(text_col))))
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32)))], ["id", "label", "terms"])

    joined = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.xxhash64(id_col).alias("id"), F.col("_label").alias("label"), text_col)
    extracted = written(joined.mapInArrow(extract, "id long, label int, terms array<int>"), "toxicity-sample")
    # the smallest hashes whose sizes fit, from 256 sums
    step = F.shiftright("id", 56)
    upto, bound = 0, None
    for at, n in sorted((r[0], r[1]) for r in extracted.groupBy(step.alias("step")).agg(F.sum(F.size("terms"))).collect()):
        upto += n
        if upto > TRAIN_TERMS:
            break
        bound = at
    sample = extracted.where(step <= bound if bound is not None else F.lit(False)).toArrow()
    forget(docs.sparkSession)  # the JVM's copy of the sample, before the fit takes room
    machine = _fitted(sample)
    del sample
    trim()
    return machine


def _fitted(sample: pa.Table) -> FactorizationMachine:
    if not sample.num_rows:
        return fit([], np.zeros(0))
    ids, y = sample.column("id").to_numpy(), sample.column("label").to_numpy()
    # the terms stay where they are; only the documents are put in order
    sets = [one.values.to_numpy() for one in sample.column("terms")]
    order = np.lexsort((y, ids))
    return fit([sets[k] for k in order], y[order])


def score(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Whole texts are scored; null and empty texts get the score of no terms. Repeated rows get equal scores. Columns that have
    a name of the result are replaced; an empty table gives an empty result.
    """
    names = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, text_col):
            text = B.Text(batch.column(batch.schema.get_field_index(text_col)))
            p = shared.value.score(*terms(text), text.n)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*dict.fromkeys([*names, text_col])).mapInArrow(run, schema)
