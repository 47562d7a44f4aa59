"""URL filters: allow and block rules in a trie of reversed host labels and path segments.

A rule names a host and a path prefix. It fits its host and every subdomain,
where the URL's path starts with the rule's path. Of all rules that fit, the
longest (host and path characters together; then the longer host) decides.

Up to ``MAX_TRIE_RULES`` rules of ``MAX_TRIE_CHARS`` characters go to the tasks
as one broadcast trie. Of a larger set no task holds more than one way down the
trie: the rules of each host, and the URLs that have this host as a suffix, are
sorted by path, which is the trie's pre-order, and a stack holds the rules that
begin the path at hand. A host that very many URLs ask for is dealt over tasks,
and each distinct URL asks once.

Defined cases: a null URL or one without ``://`` has empty host and path and
fits only rules with an empty host; a URL that no rule fits gets ``default``;
of equal rules that disagree, block wins; other columns pass through, and an
input column called like the result column is replaced. A URL's cost grows with
its length and that of the rules, never with the square.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import checkpointed, free_names, join_hot, written

MAX_TRIE_RULES, MAX_TRIE_CHARS = 100_000, 10_000_000
#: Questions about one host beyond which its rules are sent to several tasks.
HOT_HOST = 1 << 20
RESULT = "host string, path string, rule string, verdict string"


class UrlRule(NamedTuple):
    action: str
    host: str
    path: str = ""


def _ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return _ascii_lower(host), slash + path


class _Node:
    __slots__ = ("below", "ends", "lengths", "paths")

    def __init__(self) -> None:
        self.below: dict[str, _Node] = {}  # by next host label, or next whole path segment
        self.paths: _Node | None = None  # of a host node: where its paths begin
        self.ends: dict[str, UrlRule] = {}  # by the started last segment of a rule
        self.lengths: list[int] = []  # of the keys of ``ends``, longest first


class UrlTrie:
    """Longest match over reversed host labels, then path segments."""

    def __init__(self, rules: Iterable[UrlRule]) -> None:
        self.root = _Node()
        for rule in rules:
            rule = rule._replace(host=_ascii_lower(rule.host))
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, started = rule.path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            held = node.ends.get(started)
            if held is None or held.action != "block":
                node.ends[started] = rule
            if len(started) not in node.lengths:
                insort(node.lengths, len(started), key=lambda n: -n)

    def _paths(self, node: _Node | None, segments: list[str]) -> UrlRule | None:
        best = None
        for segment in segments:
            if node is None:
                break
            for k in node.lengths:
                if k <= len(segment) and segment[:k] in node.ends:
                    best = node.ends[segment[:k]]  # deeper is longer
                    break
            node = node.below.get(segment)
        return best

    def match(self, host: str, path: str) -> UrlRule | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            found = self._paths(node.paths, segments)
            if found and (best is None or len(found.host) + len(found.path) >= len(best.host) + len(best.path)):
                best = found
        return best


def _by_trie(df: DataFrame, url: Column, rules: list[UrlRule], default: str, out: str) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = UrlTrie(held.value)
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                rule = trie.match(host, path)
                rows.append((host, path, rule and rule.host + rule.path, rule.action if rule else default))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return df.withColumn(out, judge(url))


_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules and URLs of one host after another, by path: each URL's longest rule."""
    at, stack = None, []
    for batch in batches:
        found = []
        for key, deal, path, url, action in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if (key, deal) != at:
                at, stack = (key, deal), []
            while stack and not path.startswith(stack[-1][0]):
                stack.pop()
            if url is None:
                stack.append((path, action))
            elif stack:
                found.append((url, key, *stack[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*found) if found else [[]] * 4)], names=["url", "host", "path", "action"])


def _by_walk(df: DataFrame, url: Column, rules: DataFrame, default: str, out: str, hot_host: int) -> DataFrame:
    rules = (
        rules.select(F.translate("host", *_LOWER).alias("key"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .groupBy("key", "path")
        .agg(F.max("action").alias("action"))  # block sorts after allow
    )
    names = free_names("__url", "__parts", "__rule", "__verdict", "__times", beside=df)
    key, parts, rule, verdict, times = names
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.regexp_extract(F.substring(url, mark + 3, F.length(url)), r"(?s)^([^?#]*+)", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    cut = F.instr(rest, "/")
    host = F.translate(F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest), *_LOWER)
    path = F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise("")
    asking = df.withColumn(parts, F.struct(host.alias("host"), path.alias("path"))).withColumn(key, F.md5(F.concat(f"{parts}.host", F.lit("\n"), f"{parts}.path")))
    urls = written(asking.groupBy(key).agg(F.first(F.col(parts)).alias("p"), F.count("*").alias(times)), "urls")
    labels = F.split("p.host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select(F.explode(suffixes).alias("key"), F.col("p.path").alias("path"), F.col(key).alias("url"))
    hot_host = max(hot_host, asked.count() // 10_000)  # so that at most 10,000 hosts are hot
    hot = checkpointed(asked.groupBy("key").count().where(F.col("count") > hot_host).select("key", F.ceil(F.col("count") / hot_host).cast("int").alias("deals")))
    asked = asked.join(F.broadcast(hot), "key", "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("url"), F.col("deals")), F.lit(0)).cast("int"))
    sent = rules.join(F.broadcast(hot), "key", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1)))
    both = asked.select("key", "deal", "path", "url", F.lit(None).cast("string").alias("action")).union(sent.select("key", "deal", "path", F.lit(None).cast("string"), "action"))
    walked = both.repartition("key", "deal").sortWithinPartitions("key", "deal", "path", F.col("url").asc_nulls_first()).mapInArrow(_walk, "url string, host string, path string, action string")
    rank = F.struct(F.length("host") + F.length("path"), F.length("host"))
    best = walked.groupBy(F.col("url").alias(key)).agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "action"), rank).alias("best"))
    answers = urls.drop("p").join(best, key, "left").select(key, times, F.col("best.rule").alias(rule), F.coalesce("best.action", F.lit(default)).alias(verdict))
    joined = join_hot(asking, written(answers, "verdicts"), key, times, urls.agg(F.sum(times)).first()[0] or 0, F.monotonically_increasing_id())
    result = F.struct(F.col(f"{parts}.host"), F.col(f"{parts}.path"), F.col(rule).alias("rule"), F.col(verdict).alias("verdict"))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c != out), result.alias(out))


def judge_urls(df: DataFrame, rules: Iterable[UrlRule] | DataFrame, url: str = "url", default: str = "allow", out: str = "url_verdict", hot_host: int = HOT_HOST) -> DataFrame:
    """``df`` with a struct column ``out``: host, path, rule (null: none) and verdict.

    ``rules``: UrlRule tuples, or a DataFrame (action, host, path) of any size.
    """
    schema = "action string, host string, path string"
    if isinstance(rules, DataFrame):
        rules = rules.where("host IS NOT NULL").select(*schema.replace(" string", "").split(", "))
        size = rules.agg(F.count("*").alias("n"), F.sum(F.length("host") + F.coalesce(F.length("path"), F.lit(0))).alias("chars")).first()
        if size["n"] > MAX_TRIE_RULES or (size["chars"] or 0) > MAX_TRIE_CHARS:
            return _by_walk(df, F.col(url), rules, default, out, hot_host)
        rules = [UrlRule(r["action"], r["host"], r["path"] or "") for r in rules.collect()]
    rules = list(rules)
    if len(rules) > MAX_TRIE_RULES or sum(len(r.host) + len(r.path) for r in rules) > MAX_TRIE_CHARS:
        frame = df.sparkSession.createDataFrame([tuple(r) for r in rules], schema)
        return _by_walk(df, F.col(url), frame, default, out, hot_host)
    return _by_trie(df, F.col(url), rules, default, out)
