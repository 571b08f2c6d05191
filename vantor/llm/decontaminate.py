"""Benchmark decontamination with DataFrame functions alone: a broadcast hash set of benchmark n-grams against token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantor.llm._store import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words with A-Z, and with what stands before each.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to so many distinct n-grams (some 150 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_NGRAMS = 1_000_000
#: A window is looked up only if its first words are those of a benchmark window, by a table of one byte for each hash value.
LEAD = 4
#: Places of that table for each n-gram, and at most.
PLACES, MOST_PLACES = 16, 1 << 24
#: Texts with hits are broadcast up to so many, with so many spans and items; beyond, they are joined under salted keys.
BROADCAST_TEXTS, BROADCAST_SPANS = 200_000, 4_000_000
SALTS = 16
_BITMAP = 32768
#: The words of a text as it stands.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _windows(of: Column, n: Column, length: int) -> Column:
    """All stretches of ``length`` words, space-joined; none if there are fewer words."""
    starts = F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(of, i, F.lit(length)), " "))


def ngrams(benchmark: DataFrame, length: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram, len, items``: the distinct windows of the items; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    windows = F.when(F.col("n") < length, F.array(F.array_join("w", " "))).otherwise(_windows(F.col("w"), F.col("n"), length))
    grams = items.select("item", F.least("n", F.lit(length)).alias("len"), F.explode(windows).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))


def _lead(of: Column, at: Column, length: int) -> Column:
    """A hash of the first words of the window of ``length`` words that starts at the word ``at`` (from 1)."""
    return F.xxhash64(F.lit(length), *[F.get(of, at + (k - 1)) for k in range(min(LEAD, length))])


def _leads(grams: DataFrame, lengths: list[int], n_grams: int) -> tuple[Column, int]:
    """A table of one byte (``1`` or ``0``) for each hash value of first words, and its size.

    Spark sets the bits of bitmaps; the driver gets at most 512 of them, of 4 KB.
    """
    size = _BITMAP
    while size < PLACES * n_grams and size < MOST_PLACES:
        size *= 2
    own = F.split(F.col("gram"), " ")
    place = F.pmod(F.coalesce(*[F.when(F.col("len") == n, _lead(own, F.lit(1), n)) for n in lengths]), F.lit(size))
    bits = grams.select(place.alias("p")).groupBy(F.floor(F.col("p") / _BITMAP).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % _BITMAP).alias("bits")).collect()
    table = [b"0" * _BITMAP] * (size // _BITMAP)
    for k, found in bits:
        table[k] = format(int.from_bytes(found, "little"), f"0{_BITMAP}b")[::-1].encode()
    return F.lit(b"".join(table)), size


def hits(docs: DataFrame, grams: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_key, spans, items`` of each distinct text with a hit: the word spans (from 1) of all occurring windows, and their items.

    Null and empty texts have no windows; without n-grams, or without texts, there are no rows. A text that occurs twice is
    one row.
    """
    kept = written(grams, "ngrams")
    n_grams = kept.count()
    lengths = sorted(r[0] for r in kept.select("len").distinct().collect())  # at most the window's length
    if not lengths:
        return kept.select(F.unhex("gram").alias("text_key"), F.array(F.struct(F.lit(0).alias("at"), F.col("len"))).alias("spans"), "items")
    known, size = _leads(kept, lengths, n_grams)
    split = docs.select(F.unhex(F.md5(F.col(text_col))).alias("text_key"), words(F.col(text_col)).alias("w"))
    split = split.withColumn("n", F.size("w"))

    def near(length: int) -> Column:
        """The windows of this length whose first words are those of an n-gram."""
        # no condition on the starts: it would be pushed below the split and have the words taken apart for each window
        every = F.when(F.col("n") >= length, F.sequence(F.lit(1), F.col("n") - (length - 1))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: F.substring(known, F.pmod(_lead(F.col("w"), i, length), F.lit(size)).cast("int") + 1, F.lit(1)) == F.lit(b"1"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), F.array_join(F.slice("w", i, F.lit(length)), " ").alias("gram")))

    grown = split.select("text_key", F.inline(F.concat(*[near(n) for n in lengths])))
    side = kept.select("gram", "items")
    if n_grams <= BROADCAST_NGRAMS:
        found = grown.join(F.broadcast(side), "gram")
    else:  # a window that very many texts have is spread over the salts
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")
        found = grown.withColumn("salt", F.pmod(F.xxhash64("text_key", "at"), F.lit(SALTS))).join(side.withColumn("salt", F.explode(salts)), ["gram", "salt"])
    found = found.select("text_key", F.struct("at", "len").alias("span"), "items")
    return found.groupBy("text_key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """The sorted spans merged: disjoint ``at`` and exclusive ``to``, in order."""
    start = F.array().cast("array<struct<at:int,to:int>>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        fresh = F.struct(s["at"].alias("at"), (s["at"] + s["len"]).alias("to"))
        joined = F.struct(last["at"].alias("at"), F.greatest(last["to"], s["at"] + s["len"]).alias("to"))
        apart = (F.size(acc) == 0) | (s["at"] > F.get(acc, F.size(acc) - 1)["to"])
        return F.when(apart, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(spans, start, step)


def count_covered(spans: Column) -> Column:
    """How many words the sorted spans cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))

    def step(acc, s):
        to = s["at"] + s["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), to - F.greatest(s["at"], acc["to"]))).alias("n"), F.greatest(acc["to"], to).alias("to"))

    return F.aggregate(spans, zero, step)["n"]


def mark(docs: DataFrame, benchmark: DataFrame, length: int = 10, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, spans``.

    A word is hit if it is inside any occurrence of a benchmark window of ``length`` words. ``items`` are the ids, in order as
    strings, of the items whose windows occur (null ids mark words but aren't listed); ``spans`` are the windows that occur.
    Texts are compared whole, so repeated rows get equal results; null and empty texts have no words. An empty benchmark
    marks nothing. Columns that have a name of the result are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans")]
    found = written(hits(docs, ngrams(benchmark, length, item_col, "text"), text_col), "hits").withColumnRenamed("text_key", "_text_key")
    n, n_spans, n_items = found.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    text = F.col(text_col)
    n_words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ANY_CASE)).cast("long")
    # hidden names, as a column of the result may have the name of the text
    every = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], n_words.alias("_n_words"), F.unhex(F.md5(text)).alias("_key"))
    if n <= BROADCAST_TEXTS and n_spans + n_items <= BROADCAST_SPANS:
        joined = every.join(F.broadcast(found), F.col("_key") == F.col("_text_key"), "left")
    else:  # copies of a text are spread over the salts, and so are texts without words, which match nothing
        spread = every.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        key = F.when(F.col("_n_words") > 0, F.col("_key")).otherwise(F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 14, "0")))
        salted = found.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        joined = spread.withColumn("_key", key).join(salted, (F.col("_key") == F.col("_text_key")) & (F.col("_salt") == F.col("_of")), "left")
    listed = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda x: x.cast("string")))
    hit = F.coalesce(count_covered(F.col("spans")), F.lit(0)).cast("long")
    return joined.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], F.col("_n_words").alias("n_words"), hit.alias("n_hit"), listed.alias("items"), "spans")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that have a hit. Null and empty texts have none; repeated rows go or stay together."""
    return mark(docs, benchmark, **options).where("n_hit = 0").select(*docs.columns)


def clean_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all hit words, and what stands before each, taken out of the texts.

    Texts without a hit stay as they are: null stays null, empty stays empty. Repeated rows get equal texts.
    """
    marked = mark(docs, benchmark, text_col=text_col, **options)
    text = F.col(text_col)
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    gone = covered(F.col("spans"))
    edges = F.concat(F.array(F.struct(F.lit(1).alias("at"), F.lit(1).alias("to"))), gone, F.array(F.struct((F.size(pieces) + 1).alias("at"), F.lit(0).alias("to"))))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.slice(pieces, F.get(edges, k - 1)["to"], F.get(edges, k)["at"] - F.get(edges, k - 1)["to"])))
    tail = F.expr(f"substring(`{text_col}`, length(array_join(regexp_extract_all(`{text_col}`, r'{PIECE}', 0), '')) + 1)")
    cleaned = F.when(F.col("n_hit") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(text)
    return marked.withColumn(text_col, cleaned).select(*docs.columns)
