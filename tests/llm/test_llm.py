"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vantor.llm import _bytes as B
from vantor.llm import _store, decontaminate, hmm, licenses, linededup, mixing, quality, repeats, shingles, simhash, toxicity, urlfilter
from vantor.llm._xxh import xxh64

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "Of", "and", "été", "naïve", "über", "data", "x#y", "$$$", "longerword", "a"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def corpus(n=60, seed=3):
    """Random texts with shared passages, copies, odd white space, nulls, an empty, a blank and a long one."""
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", str(r.randrange(50))]) for _ in range(k))
    shared = [sentence(30) for _ in range(3)]
    texts = []
    for _ in range(n):
        lines = [r.choice([sentence(r.randrange(0, 15)), r.choice(shared), " \t " + r.choice(shared).upper() + "\r"]) for _ in range(r.randrange(1, 6))]
        texts.append("\n".join(lines))
    texts += [None, "", " \n\t ", texts[0], texts[1], texts[1], sentence(4000), "é" * 300, "tiny"]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s1", "s2", None]), None) for i, t in enumerate(texts)]
    return rows + [rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_lines_and_hashes(rows):
    texts = [r[1] for r in rows]
    t = B.Text(pa.array(texts))
    starts, ends = t.words(B.NON_SPACE)
    assert [t.data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == [w for x in texts for w in words(x)]
    a, b, who = t.lines()
    assert [(int(k), t.data[x:y].tobytes().decode()) for x, y, k in zip(a, b, who, strict=True)] == [(i, line) for i, x in enumerate(texts) for line in (x or "").split("\n")]
    by_hash = {}
    for h, x, y in zip(t.hashes(starts, ends).tolist(), starts, ends, strict=True):
        assert by_hash.setdefault(h, t.data[x:y].tobytes()) == t.data[x:y].tobytes()
    data = bytes(random.Random(1).randrange(256) for _ in range(3000))
    at, n = np.arange(0, 2500, 7), np.arange(0, 2500, 7) % 131
    assert xxh64(np.frombuffer(data, np.uint8), at, n, 42).tolist() == [xxhash.xxh64_intdigest(data[i : i + k], 42) for i, k in zip(at, n, strict=True)]


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs, (5, 2, 1)).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(words(r[1])) for r in rows)
    total = Counter()
    for r in rows:
        total[r[3]] += len(words(r[1]))
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and left * weight[s] > 3 * total[s] * share}
        if not over:
            break
        full |= over
    want = {s: 3 * total[s] if s in full else left * weight[s] / share for s in order}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.taken in (r.size * math.floor(r.rate), r.size * math.ceil(r.rate))
    assert mixing.emit(mixing.mix(docs, (5, 2, 1))).count() == sum(r.copies for r in got)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs, (5, 2, 1)).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mix(none, (5, 2, 1)).count() == 0
    by_name = {r.source: r.target for r in mixing.mix(docs.withColumn("rate", F.lit("x")), {"s1": 1}).collect()}
    assert by_name["s2"] == 0


def test_salted_mix_equals_broadcast(docs, monkeypatch):
    plain = sorted((r.doc_id, r.taken) for r in mixing.mix(docs, (5, 2, 1)).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(docs, (5, 2, 1)).collect()) == plain


def brute_simhash(text, width):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("bucket", "small"), [(1 << 20, 1024), (1 << 20, 8), (8, 8)])
def test_simhash(spark, docs, rows, none, bucket, small):
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("x")).withColumn("_root", F.lit(1)), 4, bucket=bucket, small=small).collect()
    fp = {r[0]: brute_simhash(r[1], 4) for r in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", find(r.doc_id))
    assert simhash.near_duplicates(none, 4).count() == 0


def test_links_are_complete(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b for x in base for b in [x, *(x ^ sum(1 << p for p in r.sample(range(64), k)) for k in (1, 2, 3, 4, 5, 6))]}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket, small in ((1 << 20, 1024), (1 << 20, 4), (4, 4)):
        found = simhash.components(simhash.links(frame, bucket=bucket, small=small)).collect()
        label = {r.node & (1 << 64) - 1: r.root for r in found}
        for a in fps:
            for b in fps:
                if a != b and (a ^ b).bit_count() <= 4:
                    assert label[a] == label[b]


def test_links_of_a_bucket_are_a_forest():
    r = random.Random(9)
    for n, flips, small in ((300, 1, 1024), (300, 2, 64), (1500, 2, 64), (400, 9, 8)):
        base = r.getrandbits(64)
        fps = np.array(sorted({base ^ sum(1 << p for p in r.sample(range(64), r.randint(0, flips))) for _ in range(n)}), np.uint64)
        keys = np.zeros(len(fps), np.int64)
        a, b = simhash._linked(keys, fps, 4, small)
        assert len(a) <= len(fps) - 1
        label = {int(f): int(f) for f in fps}

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 4 and find(x) != find(y)
            label[find(x)] = find(y)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
        assert all(find(int(fps[i])) == find(int(fps[k])) for i, k in zip(*np.nonzero(near), strict=True))


def test_chunks_cover_every_bucket():
    r = np.random.default_rng(2)
    for _ in range(50):
        keys = np.sort(r.integers(0, 12, 60))
        cuts = list(simhash._chunks(keys, 8))
        assert [lo for lo, _ in cuts] == [0, *(hi for _, hi in cuts[:-1])] and cuts[-1][1] == len(keys)
        assert all(keys[hi - 1] != keys[hi] for _, hi in cuts[:-1])
    assert not list(simhash._chunks(keys[:0], 8))


def test_keep_one(spark):
    frame = spark.createDataFrame([(2, "a b c d e f"), (1, "A b c d e f"), (3, "other words are here now yes"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id for r in simhash.keep_one(frame).collect()), key=str) == [1, 3, None]


def brute_shingles(text, width=5):
    w = words(lower(text))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("chunk", [1 << 21, 700])
def test_near_copies_of_similarity_80(spark, chunk):
    r = random.Random(8)
    rows = []
    for changes in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12):  # of 300 words: similarities from 0.97 to below 0.8
        for _ in range(6):
            w = [f"w{r.randrange(5000)}" for _ in range(300)]
            x = list(w)
            for k in r.sample(range(300), changes):
                x[k] = "changed"
            rows += [" ".join(w), " ".join(x)]
    # copies of one text that are similar to it and often not to each other
    base = [f"v{r.randrange(5000)}" for _ in range(300)]
    for _ in range(25):
        x = list(base)
        for k in r.sample(range(300), 5):
            x[k] = f"x{r.randrange(5000)}"
        rows.append(" ".join(x))
    rows += [" ".join(base), None, "", " \n", "Two Words", "two  words"]
    sets, root = [brute_shingles(t) for t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            common, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * common >= 4 * every:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted({find(i) for i in range(len(rows))})
    frame = spark.createDataFrame([*enumerate(rows), (None, rows[0])], "doc_id long, text string").repartition(3)
    got = sorted(x.doc_id for x in shingles.keep_one(frame, chunk=chunk).collect() if x.doc_id is not None)
    assert got == want and len(want) < len(rows) - 60
    far = [i for i in range(0, 120, 2) if i + 1 not in got and (brute_simhash(rows[i], 5) ^ brute_simhash(rows[i + 1], 5)).bit_count() > 4]
    assert len(far) > 10  # those that fingerprints at most four bits apart leave
    assert shingles.keep_one(frame).where("doc_id IS NULL").count() == 1 and shingles.keep_one(frame.limit(0)).count() == 0


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "x.com", ""), ("allow", "x.com", "/ok/"), ("allow", "same.net", "/a"), ("block", "same.net", "/a")]
URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/123?x", "http://example.org/en/2", "http://foo.org", "http://foo.org/", "http://b.com/fr/x#y", "http://b.com/de/", "http://b.com/dex", "http://y.x.com/ok/1", "http://y.x.com/no", "http://notx.com/", "http://same.net/abc", None, "", "no scheme", "http://", "http://org:80/", "://org/x", "a://b?c/d", "http://x.com/ok/?://org/"]


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        host = lower(re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    want = [brute_url(u) for u in URLS]
    for given in (RULES, rules):
        got = urlfilter.filter_urls(pages, given).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 0)
    got = urlfilter.filter_urls(pages, rules).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
    assert urlfilter.filter_urls(pages.limit(0), RULES).count() == 0


def test_quality_statistics(docs, rows, none):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, text, *_ in rows:
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        count, again = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k in range(len(w) - 2):
            if count[tuple(w[k : k + 3])] > 1:
                again |= {k, k + 1, k + 2}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (failed and r.kept)
    assert quality.judge(none).count() == 0


def brute_kneser_ney(texts, least):
    """log10 p(w | u, v) of an interpolated modified Kneser-Ney model of three words with rare n-grams cut, as a function."""
    tri = Counter()
    for t in texts:
        w = [None, None, *words(lower(t))]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    before, times, left, right = Counter(), Counter(), Counter(), Counter()
    for (_, v, w), c in tri.items():
        before[v, w] += 1
        times[v, w] += c
    for (v, w), n in before.items():
        left[v] += n
        right[w] += 1

    def cut(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        d = quality.discounts(n)
        return lambda c: d[min(c, 3) - 1]

    d1, d2, d3 = cut(right), cut(before), cut(tri)
    total, size = sum(right.values()), len(right)
    flat = sum(d1(c) for c in right.values()) / total / (size + 1)
    p1 = {w: (c - d1(c)) / total + flat for w, c in right.items()}
    rare = [w for w, c in right.items() if c < least]
    share = sum(p1[w] for w in rare) / len(rare) if rare else flat
    p1 = {w: share if w in set(rare) else x for w, x in p1.items()}
    kept2 = {k: (c - d2(c)) / left[k[0]] for k, c in before.items() if c >= least}
    kept3 = {k: (c - d3(c)) / times[k[:2]] for k, c in tri.items() if c >= least and times[k[:2]] >= least}
    g2, g3 = Counter(), Counter()
    for (v, _), x in kept2.items():
        g2[v] += x
    for (u, v, _), x in kept3.items():
        g3[u, v] += x

    def p(u, v, w):
        two = kept2.get((v, w), 0) + (1 - g2[v]) * p1.get(w, share)
        return kept3.get((u, v, w), 0) + (1 - g3[u, v]) * two

    return p, list(p1), lambda u, v: (1 - g3[u, v]) * (1 - g2[v]) * flat


def passes(text):
    w = words(text)
    count, again = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for k in range(len(w) - 2):
        if count[tuple(w[k : k + 3])] > 1:
            again |= {k, k + 1, k + 2}
    return not (len(w) < 50 or 100 * len(again) > 50 * len(w))


@pytest.mark.parametrize(("least", "small"), [(1, True), (2, True), (3, False)])
def test_perplexity_is_that_of_kneser_ney(docs, rows, least, small, monkeypatch):
    if not small:
        monkeypatch.setattr(quality, "BROADCAST_NGRAMS", 0)
    monkeypatch.setattr(quality, "copies", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))  # each row counts
    p, vocabulary, unknown = brute_kneser_ney([r[1] for r in rows if passes(r[1])], least)
    for u, v in ((None, None), (None, "the"), ("the", "of"), ("a", "data"), ("never", "seen")):
        assert sum(p(u, v, w) for w in vocabulary) + unknown(u, v) == pytest.approx(1)
    got = {r.doc_id: r for r in quality.judge(docs.withColumn("kept", F.lit("x")), size=quality.Size(32, 8, least)).collect()}
    some = 0
    for i, text, *_ in rows:
        w = [None, None, *words(lower(text))]
        if len(w) == 2:
            assert got[i].log_ppl is None
            continue
        want = -sum(math.log10(p(*x)) for x in zip(w, w[1:], w[2:], strict=False)) / (len(w) - 2)
        assert got[i].log_ppl == pytest.approx(want, rel=1e-4), (i, text[:80])
        some += passes(text)
    assert some > 20


def test_quality_does_not_depend_on_the_amount_of_text(spark, docs, monkeypatch):
    small, large = quality.Size.of(1), quality.Size.of(1 << 40)
    assert (small.bits, small.least) == (large.bits, large.least) and small.shards < large.shards
    r = random.Random(4)
    base = [[f"w{r.randrange(300)}" for _ in range(90)] for _ in range(30)]
    near = [" ".join(w if r.random() < 0.98 else f"w{r.randrange(300)}" for w in one) for one in base for _ in range(7)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(near)], "doc_id long, text string, lang string").unionByName(docs.select(F.col("doc_id") + 1000, "text", "lang").toDF("doc_id", "text", "lang"))
    judged = lambda size: [(x.doc_id, x.kept, x.log_ppl and round(x.log_ppl, 9)) for x in quality.judge(frame, size=size).orderBy("doc_id", "log_ppl").collect()]
    want = judged(None)
    assert quality.copies(frame, small)[0].value[1].max() >= 5
    for name, value in (("_HELD", 500), ("MOST_SIGNATURES", 40), ("PART_NGRAMS", 100), ("BROADCAST_NGRAMS", 0)):
        monkeypatch.setattr(quality, name, value)
        assert judged(quality.Size(large.bits, 64, large.least)) == want, name


def test_quality_lets_go_of_shuffles_and_takes_turns(spark, docs, monkeypatch):
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))
    there, left, init = files(), [], _store.Table.__init__

    def opened(self, df, name, *rest):
        ends = time.time() + 5
        while files() - there and time.time() < ends:
            time.sleep(0.05)
        left.append((name, len(files() - there)))
        init(self, df, name, *rest)

    judged = lambda: [(x.doc_id, x.kept, x.log_ppl and round(x.log_ppl, 9)) for x in quality.judge(docs).orderBy("doc_id", "log_ppl").collect()]
    monkeypatch.setattr(_store.Table, "__init__", opened)
    since = _store.mark()
    want = judged()
    assert len(left) > 10 and not [x for x in left if x[1]]
    assert [x.name for x in _store._WRITTEN[since:]] == ["quality"]
    monkeypatch.setattr(_store.Table, "__init__", init)
    monkeypatch.setattr(quality, "COUNT_TURNS", 1)
    monkeypatch.setattr(quality, "JOIN_TURNS", 1)
    assert judged() == want


def test_coded_trigrams_come_back():
    r = np.random.default_rng(4)
    for n in (1, 7, 5000):
        x = r.zipf(1.3, (3, n)).astype(np.uint64) % np.uint64(1 << 32)
        p, u, c = quality._counted(x[0] << np.uint64(32) | x[1], x[2].astype(np.uint32), np.ones(n, np.int64) * quality.UNIT)
        back = quality._counted(*quality._decoded(*map(quality.packed, quality._coded(p, u, c, 32)), 32))
        assert all(a.tolist() == b.tolist() for a, b in zip((p, u, c), back, strict=True))


def test_thin_numbers_come_back():
    r = np.random.default_rng(5)
    for n in (0, 1, 5000):
        code, value = np.sort(r.integers(0, 1 << 64, n, np.uint64)), r.random(n).astype(np.float32)
        got = quality._table((*quality._thin(code), value))
        assert got[0].dtype == np.uint64 and got[0].tolist() == code.tolist() and got[1] is value


def test_the_fit_lets_the_sample_go(spark, monkeypatch):
    """Once the machine is fitted, the driver holds nothing of the sample of terms, and the freed memory is given back."""
    trimmed = []
    monkeypatch.setattr(toxicity, "trim", lambda: trimmed.append(pa.total_allocated_bytes()))
    before = pa.total_allocated_bytes()
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(2000))) for i in range(200)], "doc_id long, text string")
    toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert trimmed and trimmed[-1] - before < 200_000


def test_packed_numbers_come_back():
    r = np.random.default_rng(3)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            x = r.integers(0, 1 << 31, n).astype(kind)
            assert quality.unpacked(quality.packed(x), kind).tolist() == x.tolist()
    p = r.integers(0, 1 << 48, 1000).astype(np.uint64)
    assert quality.spread(quality.spread(p, 24), 24, back=True).tolist() == p.tolist()


def test_both_bands_reject(spark):
    r = random.Random(7)
    lexicon = [f"w{i}" for i in range(3000)]
    follow = {w: r.sample(lexicon, 12) for w in lexicon}

    def prose(n=200):
        w = [r.choice(lexicon[:50])]
        while len(w) < n:
            w.append(r.choice(follow[w[-1]]))
        return w

    stock = [[r.choice(lexicon) for _ in range(10)] for _ in range(40)]  # sentences that many texts have
    clean = [" ".join(prose(170) + [x for k in r.sample(range(40), 3) for x in stock[k]]) for _ in range(700)]
    dull = [" ".join(x for k in r.sample(range(40), 20) for x in stock[k]) for _ in range(8)]
    shuffled = []
    for _ in range(10):
        w = prose()
        r.shuffle(w)
        shuffled.append(" ".join(w))
    odd = [" ".join("".join(r.choice("#$%xyz") for _ in range(6)) for _ in range(200)) for _ in range(5)]
    near = []
    for _ in range(150):  # near copies of the first text
        w = clean[0].split()
        w[r.randrange(200)] = r.choice(lexicon)
        near.append(" ".join(w))
    texts = clean + near + [clean[1]] * 50 + shuffled + odd + dull
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = [x for x in quality.judge(frame).orderBy("doc_id").collect()]
    assert sum(x.kept for x in got[:900]) >= 885  # copies are no plainer than their originals
    assert all(not x.kept and not x.base_failed and x.log_ppl > x.upper for x in got[900:915])
    assert sum(not x.kept and not x.base_failed and x.log_ppl < x.lower for x in got[915:]) == 8


def test_quality_bands(spark):
    rows = [("en", 2.0 + k / 100, False) for k in range(101)] + [(None, 1.0, False), ("en", 99.0, True), ("de", 5.0, True)]
    got = {r.lang: (r.lower, r.upper) for r in quality.bands(spark.createDataFrame(rows, "lang string, log_ppl double, base_failed boolean"), below=2, above=1).collect()}
    assert got["en"] == pytest.approx((2.25 - 1.0, 2.75 + 0.5), abs=0.03) and got[None] == pytest.approx((0.8, 1.1)) and "de" not in got


def test_toxicity_learns_and_holds_out(spark, none):
    r = random.Random(4)
    clean = [f"w{i}" for i in range(300)]
    insults, groups = ["stupid", "worthless"], ["they", "folk"]
    rows = []
    for i in range(1500):
        bag = [r.choice(clean) for _ in range(40)]
        toxic = i % 3 == 0
        bag += [r.choice(insults), r.choice(groups)] if toxic else [r.choice([*insults, *groups])]
        r.shuffle(bag)
        rows.append((i, " ".join(bag), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels.where(toxicity.bucket_of(F.col("doc_id"), 5) != 0))
    got = {x.doc_id: x for x in toxicity.score(docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")), machine).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    # neither word alone is toxic: only pairs of them tell the classes apart
    assert sum(got[i].predicted == t for i, _, t in held) / len(held) > 0.9
    assert got[-1].score == got[-2].score and 0 <= got[-1].score <= 1
    assert toxicity.score(none, machine).count() == 0
    assert toxicity.score(docs.limit(1), toxicity.train(docs, labels.limit(0))).first().score == 0.5


def test_toxicity_of_long_repeated_and_clashing_rows(spark):
    rows = [(i, "stupid folk " * (20_000 if i == 0 else 1) if i % 2 else "kind words here", "x") for i in range(400)]
    rows += [(1, rows[1][1], "x"), (None, rows[1][1], "x"), (5000, "stupid folk " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs.withColumn("predicted", F.lit("y")).withColumn("_label", F.lit(0)), machine).collect()
    assert len(got) == len(rows) and {r.predicted for r in got if r.doc_id in (1, None, 5000)} == {1} and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_toxicity_fit_holds_no_copy_of_all_terms():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 18, 400)).astype(np.int32) for _ in range(8000)]
    labels = (r.random(8000) < 0.1).astype(np.int32)
    tracemalloc.start()
    toxicity.fit(sets, labels, epochs=1)
    assert tracemalloc.get_traced_memory()[1] < 60e6  # 112 MB before
    tracemalloc.stop()


def test_toxicity_sample_is_bounded_by_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i % 3}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda sets, y, f=toxicity.fit: sizes.append(sum(map(len, sets))) or f(sets, y))
    for most in (1 << 24, 300, 0):
        monkeypatch.setattr(toxicity, "TRAIN_TERMS", most)
        toxicity.train(docs, labels)
    assert sizes[0] >= 900 and 0 < sizes[1] <= 300 and sizes[2] == 0


def naive_forward(model, symbols):
    """The likelihood summed over all paths, by the unscaled recursion in whole numbers of Python floats."""
    alpha = model.start * model.emit[symbols[0]] * model.shares[symbols[0]]
    for s in symbols[1:]:
        alpha = (alpha @ model.move) * model.emit[s] * model.shares[s]
    return math.log10(alpha.sum())


def test_forward_is_exact_and_training_climbs(spark):
    r = np.random.default_rng(1)
    shares = r.dirichlet(np.ones(7))
    model = hmm.HiddenMarkov.fresh(shares, 3)
    assert (model.shares @ model.emit) == pytest.approx(np.ones(3))
    lengths = np.array([5, 1, 9, 5])
    symbols = r.integers(0, 7, lengths.sum())
    got = model.forward(symbols, lengths)
    for k, part in enumerate(np.split(symbols, np.cumsum(lengths)[:-1])):
        assert got[k] + np.log10(shares[part]).sum() == pytest.approx(naive_forward(model, part))
    log, starts, moves, emits = model.expect(symbols, lengths)
    assert starts.sum() == pytest.approx(4, abs=1e-3) and moves.sum() == pytest.approx(lengths.sum() - 4, abs=1e-2) and emits.sum() == pytest.approx(lengths.sum(), abs=1e-2)
    # alternating symbols are a chain that two states learn
    rows = [([k % 2, 2, 1 - k % 2] * 20,) for k in range(40)]
    frame = spark.createDataFrame(rows, "symbols array<int>")
    _, course = hmm.baum_welch(frame, np.array([0.33, 0.33, 0.34]), 3, 6, 6)
    assert all(b > a - 1e-3 for a, b in zip(course, course[1:], strict=False)) and course[-1] > course[0] + 50


def test_training_passes(spark):
    frame = spark.createDataFrame([([0, 1, 2] * 20,)], "symbols array<int>")
    assert len(hmm.baum_welch(frame, np.array([0.3, 0.3, 0.4]), 2)[1]) >= 5


def test_hmm_scores(spark, docs, rows, none, monkeypatch):
    trained = F.col("doc_id") % 3 != 0
    kept = {}
    for name in ("baum_welch", "emissions", "unigrams"):
        monkeypatch.setattr(hmm, name, lambda *a, name=name, f=getattr(hmm, name): kept.setdefault(name, f(*a)))
    # the tables behind the emissions go once they are written
    monkeypatch.setattr(hmm, "written", lambda df, name, f=hmm.written: kept.setdefault("rows", f(df, name).collect()) and f(df, name) if name == "hmm-emissions" else f(df, name))
    got = {r.doc_id: r for r in hmm.score(docs.withColumn("n_known", F.lit("x")), trained, frequent=20, symbols=10).collect()}
    model, (common, _, unknown), uni = kept["baum_welch"][0], kept["emissions"], kept["unigrams"]
    emit = {r.h: np.array(r.e, float) for r in kept["rows"]} | {int(h): common[k] for h, k in zip(B.signed(uni.hashes), uni.symbols, strict=True)}
    assert len(common) <= 20 < len(emit)
    hash_of = lambda w: 0 if w is None else int(B.signed(B.Text(pa.array([w])).hashes(np.array([0]), np.array([len(w.encode())])))[0])
    tokens = {i: [*words(lower(t)), None] for i, t, *_ in rows}
    count = Counter(w for i, *_ in rows if i % 3 for w in tokens[i])
    n, v = sum(count.values()), len(count)
    assert len(emit) == v > 100
    # every state's probabilities of all tokens and an unknown one sum to one
    assert sum((c + 1) / (n + v + 1) * emit[hash_of(w)] for w, c in count.items()) + unknown / (n + v + 1) == pytest.approx(np.ones(hmm.STATES), abs=1e-4)
    for i, *_ in rows:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i])
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        gain, alpha = 0.0, None
        for w in tokens[i]:
            alpha = (model.start if alpha is None else alpha @ model.move) * (emit[hash_of(w)] if count[w] else unknown)
            gain += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(base + gain, rel=1e-5)
    monkeypatch.undo()
    assert hmm.score(none, F.lit(True)).count() == 0
    assert hmm.score(docs, F.lit(False)).where("n_known > 0").count() == 0


def brute_hits(text, items):
    w, hit, found = alnum(text), set(), set()
    for item, t in items:
        x = alnum(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.mark.parametrize("small", [True, False])
def test_decontamination(spark, docs, rows, none, small, monkeypatch):
    if not small:
        for name in ("BROADCAST_NGRAMS", "BROADCAST_TEXTS"):
            monkeypatch.setattr(decontaminate, name, 0)
    long = next(r[1] for r in rows if r[1] and len(alnum(r[1])) > 60)
    items = [(1, " ".join(alnum(long)[5:30])), (10, " ".join(alnum(long)[12:22]).upper()), (2, "Tiny!"), (3, ""), (4, None), (5, "no such words are in any of the many texts here"), (1, "repeated id"), (None, " ".join(alnum(long)[40:55]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark(docs.withColumn("items", F.lit(1)), bench).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(text[r.doc_id], items)
    assert decontaminate.mark(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.mark(none, bench).count() == 0
    assert decontaminate.clean_documents(docs, bench).count() == sum(r.n_hit == 0 for r in got)
    cleaned = {r.doc_id: r.text for r in decontaminate.clean_spans(docs, bench).collect()}
    for r in got:
        assert len(alnum(cleaned[r.doc_id])) == r.n_words - r.n_hit
        if not r.n_hit:
            assert cleaned[r.doc_id] == text[r.doc_id]


def brute_repeats(rows, window):
    seen, out = {}, {}
    for i, text, *_ in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen.setdefault(b[k : k + window], (i, k)) != (i, k):
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (kept, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])))
    return out


@pytest.mark.parametrize("most_classes", [20_000, 1])
def test_repeats(docs, rows, none, most_classes):
    got = repeats.remove_repeats(docs, most_classes=most_classes).collect()
    want = brute_repeats(rows, 100)
    assert len(got) == len(rows) and sum(w[2] for w in want.values()) > 1000
    for r in got:
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == want[r.doc_id]
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_small_alphabet(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(0, 400))) * r.choice([1, 2]) + "c" * r.choice([0, 150])) for i in range(40)]
    got = repeats.remove_repeats(spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, kept string")).collect()
    want = brute_repeats(rows, 100)
    assert all((bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("most_classes", [20_000, 1])
def test_repeat_groups_have_all_occurrences(spark, most_classes):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passages = [" ".join(word() for _ in range(n)) for n in (16, 20, 40)]
    texts = [" ".join(r.choice([word(), word(), r.choice(passages)]) for _ in range(r.randrange(3, 25))) for _ in range(25)]
    texts += [texts[0], None, "", texts[1] + "x"]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    groups = {}
    for g in repeats.repeat_groups(frame, most_classes=most_classes).collect():
        groups.setdefault((g.g1, g.g2, g.length), set()).add((g.doc, g.start))
    raw = [(t or "").encode() for t in texts]
    for (_, _, n), places in groups.items():
        assert n >= 100 and len(places) > 1 and len({raw[d][a : a + n] for d, a in places}) == 1 and all(len(raw[d][a : a + n]) == n for d, a in places)
    windows = {}
    for d, t in enumerate(raw):
        for a in range(len(t) - 99):
            windows.setdefault(t[a : a + 100], set()).add((d, a))
    shared = [p for p in windows.values() if len(p) > 1]
    assert len(shared) > 500
    for places in shared:
        d0, a0 = min(places)
        # some group has this window in all of its places
        assert any(
            (d0, a0 - k) in found and all((d, a - k) in found for d, a in places)
            for (_, _, n), found in groups.items() for k in range(n - 99) if (d0, a0 - k) in found
        )
    assert repeats.repeat_groups(frame.limit(0)).count() == 0


def test_intervals_give_all_maximal_repeats():
    text = b"xabcyabcwabczzabqabq"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(text[a:], text[b:], strict=False)) if x != y), min(len(text) - a, len(text) - b))
    lcp = [0, *(common(a, b) for a, b in zip(order, order[1:], strict=False))]
    got = {(text[order[a] : order[a] + n], tuple(sorted(order[a : b + 1]))) for a, b, n in repeats.intervals(lcp, 1)}
    want = set()
    for a in range(len(text)):
        for n in range(1, len(text) - a):
            places = tuple(i for i in range(len(text)) if text[i : i + n] == text[a : a + n])
            if len(places) > 1 and len({text[i + n : i + n + 1] for i in places}) > 1:
                want.add((text[a : a + n], places))
    assert got == want


def test_licenses(docs, rows, none):
    assert licenses.parse_expression("MIT OR (GPL-2.0 AND Apache-2.0 WITH LLVM-exception)") == ["mit", "gpl-2.0", "apache-2.0", "llvm-exception", "with", "and", "or"]
    for text, granted in (("MIT", True), ("GPL-3.0 OR MIT", True), ("GPL-3.0 AND MIT", False), ("(GPL-3.0 OR MIT) AND Apache-2.0", True), ("", False), ("AND", False), ("MIT OR", True), ("((MIT", True)):
        assert licenses.evaluate(licenses.parse_expression(text))[0] is granted
    scan = licenses.Scanner().scan
    got = scan(b"Used UNDER the MIT-License, and under the mit license. CC BY-NC! Apache License, Version 2.0\n// SPDX-License-Identifier: MIT OR BSD-3-Clause")
    assert (got["n_base"], got["base_labels"]) == (4, "apache-2,cc-by-nc,mit") and {"bsd-3-clause", "cc-by-nc", "mit"} <= set(got["labels"].split(","))
    assert (got["first_word"], got["last_word"]) == (1, 13)
    assert scan(b"cc by nc cc by nc")["n_base"] == 2 and scan(b"undertheMITlicense")["n_base"] == 0
    for text, labels, permissive in (
        ("GNU General Public License. All rights reserved.", "all-rights-reserved,gpl", False),
        ("Creative Commons Attribution-NonCommercial-NoDerivs 3.0", "cc-by-nc-nd", False),
        ("Creative Commons Attribution 4.0", "cc-by-4.0", True),
        ("SPDX-License-Identifier: see the LICENSE file", "", None),
        ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", "gpl-2.0", False),
        ("SPDX-License-Identifier: (GPL-3.0-only OR MIT) AND Apache-2.0 */", "apache-2.0,gpl-3.0-only,mit", True),
        ("SPDX-License-Identifier: LicenseRef-Own", "licenseref-own", False),
        ("Redistribution and use in source and binary forms. All rights reserved.", "all-rights-reserved,bsd", True),
        ("All rights reserved", "all-rights-reserved", False),
        ("nothing here", "", None),
    ):
        got = scan(text.encode())
        assert (got["labels"], got["permissive"]) == (labels, permissive), text
    found = {r.doc_id: r for r in licenses.scan_licenses(docs.withColumn("score", F.lit("x"))).collect()}
    assert all(found[i].n_words == len(alnum(t)) and found[i].n_base == 0 and found[i].labels == "" and found[i].score == 0 for i, t, *_ in rows)
    assert licenses.scan_licenses(none).count() == 0
    phrases = ["Under The MIT-License", "x Apache License, Version 2", "CC by\nNC"]
    r = random.Random(12)
    texts = ["\n".join(r.choice([*phrases, "under the", "mit license", "cc by", "é", "word"]) for _ in range(r.randrange(12))) for _ in range(60)]
    frame = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for x in licenses.scan_licenses(frame).collect():
        w = alnum(texts[x.doc_id])
        at = sorted((k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        some += len(at)
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(at), ",".join(sorted({label for _, label in at})))
        assert (x.first_word, x.last_word) == ((at[0][0], at[-1][0]) if at else (None, None)) and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))
    assert some > 100


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (4, 2), (7, 3)])
def test_line_dedup(docs, rows, none, batches, fanout):
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    got = linededup.dedup_lines(docs.withColumn("n_lines", F.lit("x")), batches=batches, fanout=fanout).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        lines = (text[r.doc_id] or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and r.doc_id != min(holders[key(x)]))]
        assert (r.n_lines, r.n_dropped, r.text or "") == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert linededup.dedup_lines(none).count() == 0


def test_line_runs_are_read_in_order_and_kept(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    runs = linededup.LineRuns(spark)
    try:
        frame = lambda a, b: spark.createDataFrame([(i, f"a long enough line {i % 30}") for i in range(a, b)], "doc_id long, text string")
        assert linededup.dedup_lines(frame(0, 20), runs=runs).where("n_dropped > 0").count() == 0
        assert {r.doc_id for r in linededup.dedup_lines(frame(20, 70), runs=runs).where("n_dropped > 0").collect()} == set(range(30, 70))
        assert sum(r.count() for r in runs.runs()) == 30
        batch = spark.range(100).select(F.col("id").alias("k1"), F.col("id").alias("k2"))
        plan = batch.join(runs.runs()[0], ["k1", "k2"], "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1, plan
    finally:
        runs.drop()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_string_ids(spark):
    texts = ["a line that is long enough\n" + "x" * 150, "other\nA line that is long enough", None, "x" * 150]
    frame = spark.createDataFrame([(i, t) for i, t in zip("badc", texts, strict=True)] + [(None, texts[0])], "doc_id string, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(frame).collect()}
    assert got == {"a": (2, 0), "b": (2, 1), "c": (1, 1), "d": (1, 0), None: (2, 0)}
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(frame).collect()}
    assert got == {"a": 0, "b": 149, "c": 150, "d": 0, None: len(texts[0])}


def test_lines_of_null_ids_stay(spark):
    frame = spark.createDataFrame([(None, "a long enough line"), (1, "a long enough line"), (None, "a long enough line")], "doc_id long, text string")
    assert linededup.dedup_lines(frame).where("n_dropped > 0").count() == 0


def test_digests_of_queries(spark):
    import os

    from vantor.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    assert set(queries.oracle_sql()) <= set(queries.queries())
    got = queries.queries()["op8_repeat_dedup"](spark, folder).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_repeats(rows, 100)
    assert all(r.kept_sha256 == hashlib.sha256(want[r.doc_id][0]).hexdigest() for r in got)


def test_very_long_urls(spark):
    url = "http://" + "a." * 5000 + "example.org/en/1" + "/x" * 50_000 + "?q"
    pages = spark.createDataFrame([(1, url), (1, url), (2, "http://example.org" + "/" * 30_000)], "page_id long, url string")
    got = urlfilter.filter_urls(pages, RULES).collect()
    assert [(r.rule, r.verdict) for r in got] == [("example.org/en/1", "block")] * 2 + [("org/", "allow")] and len(got[0].path) > 100_000


def test_stages_take_empty_tables_nulls_and_further_columns(spark, tmp_path):
    import corpus_pipeline

    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = [(1, "clean words", "en", "s", 11), (2, None, None, None, None), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "x one two three four five six seven eight nine ten eleven", "en", None, 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for frame in (docs, docs.limit(0), docs.withColumn("score", F.lit("a")).withColumn("n_hit", F.lit("b")).withColumn("copies", F.lit("c")).withColumn("sig", F.lit("d"))):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, frame, folder)
            n = got.count()
            assert got.columns == [*corpus_pipeline.COLUMNS, *(["copy"] if name == "mixing" else [])], name
            if frame.isEmpty():
                assert n == 0
            elif name == "decontamination":
                assert n == 4


def test_pipeline(spark):
    import os

    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    before, items = docs, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder)
        if name != "mixing":
            assert after.columns == list(corpus_pipeline.COLUMNS) and ids(after) <= ids(before)
        if name == "line_dedup":
            assert ids(after) == ids(before)
        if name == "decontamination":
            assert ids(after) == {r.doc_id for r in before.collect() if not brute_hits(r.text, items)[1]}
        if name == "near_dedup":
            fps = [(r.doc_id, brute_simhash(r.text, 5)) for r in after.collect()]
            assert all((a[1] ^ b[1]).bit_count() > 4 for k, a in enumerate(fps) for b in fps[:k])
        before = spark.createDataFrame(after.collect(), after.schema)
    assert before.columns == [*corpus_pipeline.COLUMNS, "copy"]
