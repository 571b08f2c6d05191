"""Allow and block lists of URLs as one trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast as a trie (some 400 bytes each); more are joined by host.
BROADCAST_RULES = 500_000
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
_HOST, _PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_LOWER), _PATH.match(url, host.end())[0]


@dataclass
class _Paths:
    """Rules whose path continues here: ``tails`` are the last, possibly unfinished, segments."""

    below: dict[str, _Paths] = field(default_factory=dict)
    tails: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: tuple[int, ...] = ()


@dataclass
class _Hosts:
    below: dict[str, _Hosts] = field(default_factory=dict)
    paths: _Paths | None = None
    whole: tuple[str, str] | None = None


class UrlTrie:
    """Longest match: a rule of a deeper host goes first, then one of a longer path; of equal allow and block rules, block holds."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Hosts()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block") or path and not path.startswith("/"):
                raise ValueError(f"not a rule: {verdict} {host}{path}")
            node, hit = self.root, (f"{host}{path}", verdict)
            for label in reversed(host.translate(_LOWER).split(".")) if host else ():
                node = node.below.setdefault(label, _Hosts())
            if not path:
                if node.whole is None or verdict == "block":
                    node.whole = hit
                continue
            node.paths = place = node.paths or _Paths()
            *segments, tail = path[1:].split("/")
            for segment in segments:
                place = place.below.setdefault(segment, _Paths())
            if tail not in place.tails or verdict == "block":
                place.tails[tail] = hit
                place.lengths = tuple(sorted({*place.lengths, len(tail)}, reverse=True))

    @staticmethod
    def _along(place: _Paths, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path[1:].split("/"):
            best = next((place.tails[t] for n in place.lengths if (t := segment[:n]) in place.tails), best)
            if (place := place.below.get(segment)) is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule and the verdict that hold for a host and a path, or None."""
        node, best = self.root, None
        labels = iter(reversed(host.split("."))) if host else iter(())
        while node is not None:
            found = self._along(node.paths, path) if node.paths and path.startswith("/") else None
            best = found or node.whole or best
            label = next(labels, None)
            node = node.below.get(label) if label is not None else None
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    ``rules`` are (verdict, host, path): a rule fits its host and all subdomains if the URL's path starts with the rule's
    (without a path: any). ``rule`` is the host and path of the rule that holds, or null; then ``verdict`` is ``default``.
    Null or malformed URLs have an empty host and path, which only rules without host fit. Repeated rows are judged alike;
    columns of ``pages`` that have a name of the result are replaced. An empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    if isinstance(rules, DataFrame):
        if rules.count() > BROADCAST_RULES:
            return join_rules(pages.select(*keep), rules, url_col, default)
        rules = [(r[0], r[1] or "", r[2] or "") for r in rules.select("verdict", "host", "path").collect()]
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    if url_col not in keep:
        raise ValueError(f"no column {url_col}")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [split_url(u) for u in batch.column(batch.schema.get_field_index(url_col)).to_pylist()]
            hits = [match(*p) for p in parts]
            made = {"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": [h and h[0] for h in hits], "verdict": [h[1] if h else default for h in hits]}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.string()) for v in made.values())], [*batch.schema.names, *made])

    schema = pages.select(*keep).schema
    for name in ("host", "path", "rule", "verdict"):
        schema = schema.add(name, "string")
    return pages.select(*keep).mapInArrow(judge, schema)


def join_rules(pages: DataFrame, rules: DataFrame, url_col: str, default: str) -> DataFrame:
    """The same judgement for rule lists that are too large to broadcast: an equality join on the suffixes of each distinct host."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring({_quoted(url_col)}, instr({_quoted(url_col)}, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    known = pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    labels = F.split("host", r"\.")
    suffixes = F.concat(F.array(F.lit("")), F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).otherwise(F.array().cast("array<string>")))
    asked = known.select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes))
    side = rules.select(F.translate(F.coalesce("host", F.lit("")), upper, lower).alias("_rule_host"), F.coalesce("path", F.lit("")).alias("_rule_path"), "verdict", F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("rule"))
    depth = F.when(F.col("_rule_host") == "", 0).otherwise(F.size(F.split("_rule_host", r"\.")))
    best = (
        asked.join(side, (F.col("_suffix") == F.col("_rule_host")) & F.col("path").startswith(F.col("_rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(depth.alias("d"), F.length("_rule_path").alias("l"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))).alias("_best"))
    )
    return known.join(best, ["host", "path"], "left").select(*pages.columns, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
