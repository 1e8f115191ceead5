"""URL rules as a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts
with the rule's path. The host with its labels reversed, each followed by a
separator below every host character ("com", "example" -> "com\\x01example\\x01"),
makes "host or subdomain" a prefix test, that is, an interval of sorted keys, and
intervals of different hosts either nest or are disjoint. Pages are range
partitioned and sorted by that key; a sweep over each sorted partition walks the
sorted rules alongside and keeps the rules whose interval is open on a stack.
The winner is the fitting rule with the most characters in host + path (ties:
longer host, then the smaller action).

Range partitioning is by (key, path, id, place in the scan), so that a host, or
one url, with a third of all pages spreads over tasks. Rules are broadcast only
up to MAX_RULES of them; beyond that they stay a table and are partitioned with
the pages: a partition gets the rules whose interval meets that of its keys, so
those in between and the ancestors of its first key, and sweeps over rules and pages
in one sorted stream.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimspark.llm.common import cut

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
MAX_RULES = 50_000
SEP = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), SEP), F.lit(SEP)))


def host_key(host: str) -> str:
    return "".join(label + SEP for label in reversed(host.split("."))) if host else ""


class Host:
    """A host's rules by path: of equal ones the smaller action."""

    def __init__(self) -> None:
        self.paths: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def add(self, action: str, host: str, path: str) -> None:
        known = self.paths.get(path)
        if known is None and len(path) not in self.sizes:
            bisect.insort(self.sizes, len(path))
        if known is None or action < known[0]:
            self.paths[path] = (action, host)

    def longest(self, path: str) -> tuple[int, int, str, str] | None:
        """Of the rules that the path starts with: an order, smallest first, action, rule."""
        for n in reversed(self.sizes[: bisect.bisect_right(self.sizes, len(path))]):
            if found := self.paths.get(path[:n]):
                action, host = found
                return -len(host) - n, -len(host), action, host + path[:n]
        return None


class Sweep:
    """A pass over sorted keys with a stack of the hosts whose interval is open. Rules come with their key, before its pages."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Host]] = []
        self.seen: dict[str, tuple[str | None, str | None]] = {}
        self.last: str | None = None

    def move(self, key: str) -> None:
        if key != self.last:
            while self.stack and not key.startswith(self.stack[-1][0]):
                self.stack.pop()
            self.last, self.seen = key, {}

    def open(self, key: str, action: str, host: str, path: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, Host()))
        self.stack[-1][1].add(action, host, path)
        self.seen = {}

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.move(key)
        if path not in self.seen:
            if len(self.seen) > 10_000:
                self.seen.clear()
            best = min((fit for _, own in self.stack if (fit := own.longest(path))), default=None)
            self.seen[path] = (best[3], best[2]) if best else (None, None)
        return self.seen[path]


def sweep(rules: list[tuple[str, str, str]], keys: Iterable[tuple[str, str]]) -> Iterator[tuple[str | None, str | None]]:
    """(rule, verdict) for each (host key, path), which must come sorted by key."""
    waiting = sorted((host_key(host), action, host, path) for action, host, path in rules)
    at, now = 0, Sweep()
    for key, path in keys:
        while at < len(waiting) and waiting[at][0] <= key:
            if key.startswith(waiting[at][0]):
                now.open(*waiting[at])
            at += 1
        yield now.judge(key, path)


def filter_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES,
    default: str = DEFAULT,
    id_col: str = "page_id",
    url_col: str = "url",
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict for each row of pages; ids may be of any type that sorts.

    rules: (action, host, path) tuples, or a DataFrame with those columns; rows of
    it with a null don't count, and hosts are lower-cased, A-Z alone. Null urls
    and urls without "://" have empty host and path, fit no rule (other than one with empty
    host and path) and get the default. Urls are read whole, however long. Of
    rules that tie in characters the longer host wins, then the smaller action. Repeated
    rows give repeated rows; an empty table gives an empty one. Other columns of
    pages, whatever their names, aren't looked at.
    """
    spark = pages.sparkSession
    url = F.col(url_col)
    x = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("action", F.translate("host", UPPER, LOWER).alias("host"), "path").where("action is not null and host is not null and path is not null").distinct()
        few = rules.limit(max_rules + 1).collect()
        if len(few) > max_rules:
            return _merged(x, rules, default)
        listed = [tuple(r) for r in few]
    else:
        lower = str.maketrans(UPPER, LOWER)
        listed = [(a, h.translate(lower), p) for a, h, p in rules]
        if len(rules) > max_rules:
            return _merged(x, spark.createDataFrame(listed, "action string, host string, path string"), default)
    key = key_of(F.col("host"))
    # the place in the scan, last, parts rows that are alike in everything
    x = x.withColumn("key", key).withColumn("place", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartitionByRange(parts, "key", "path", "page_id", "place").drop("place").sortWithinPartitions("key")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sweep over the whole sorted partition, batch by batch
        waiting: list[tuple[str, str]] = []

        def feed():
            while True:
                yield waiting.pop()

        verdicts = sweep(listed, feed())
        for b in batches:
            names, found = [], []
            for pair in zip(b.column(3).to_pylist(), b.column(2).to_pylist()):
                waiting.append(pair)
                rule, verdict = next(verdicts)
                names.append(rule)
                found.append(verdict or default)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()), pa.array(found, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = x.schema["page_id"].dataType.simpleString()
    return x.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def _merged(x: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts with rules as a table of any size, in the pages' partitions."""
    spark = x.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = x.withColumn("key", key_of(F.col("host"))).withColumn("place", F.monotonically_increasing_id())
    x = x.repartitionByRange(parts, "key", "path", "page_id", "place").drop("place")
    x = cut(x.withColumn("part", F.spark_partition_id()), "pages")
    # a row for each partition
    ends = sorted((r.lo, r.hi, r.part) for r in x.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect())
    lows, highs, numbers = [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, to = [], []
            for i, host in enumerate(b.column(1).to_pylist()):
                key = host_key(host)
                # partitions that don't end before the key, up to the last that begins in its interval
                at = bisect.bisect_left(highs, key)
                while at < len(lows) and (lows[at] <= key or lows[at].startswith(key)):
                    rows.append(i)
                    to.append(numbers[at])
                    at += 1
            some = b.take(pa.array(rows, pa.int64()))
            keys = pa.array([host_key(h) for h in some.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), keys, *some.columns], ["part", "key", "action", "host", "path"])

    placed = rules.mapInArrow(place, "part int, key string, action string, host string, path string")
    kind = x.schema["page_id"].dataType.simpleString()
    none = F.lit(None).cast(kind).alias("page_id")
    stream = placed.select("part", "key", F.lit(False).alias("asks"), none, "host", "path", "action")
    stream = stream.union(x.select("part", "key", F.lit(True).alias("asks"), "page_id", "host", "path", F.lit(None).cast("string").alias("action")))
    stream = stream.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part", "key", "asks")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = Sweep(), None
        for b in batches:
            names, found = [], []
            asks = b.column(2).to_numpy(zero_copy_only=False)
            for own, key, page, host, path, action in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), asks, *(b.column(i).to_pylist() for i in (4, 5, 6))):
                if own != part:
                    now, part = Sweep(), own
                if page:
                    rule, verdict = now.judge(key, path)
                    names.append(rule)
                    found.append(verdict or default)
                else:
                    now.open(key, action, host, path)
            pages = b.take(pa.array(np.flatnonzero(asks)))
            yield pa.RecordBatch.from_arrays(
                [pages.column(3), pages.column(4), pages.column(5), pa.array(names, pa.string()), pa.array(found, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return stream.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
