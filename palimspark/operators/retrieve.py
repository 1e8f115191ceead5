"""Revisions back by index, id, time and position."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.functions.times import parse_iso
from palimspark.operators.compress import text_of


def _texts(compressed: DataFrame) -> DataFrame:
    return compressed.withColumn("text", text_of())


def in_range(start: int, length: int) -> Column:
    return F.col("idx").between(start, start + length)


def by_range(compressed: DataFrame, start: int, length: int) -> DataFrame:
    """start to start + length, both ends in; beyond a page's end it stops. Pages without start give nothing."""
    if length < 0:
        raise ValueError("length must not be negative")
    return _texts(compressed.where(in_range(start, length))).select("page_id", "idx", "text")


def checked_range(compressed: DataFrame, page_id: int, start: int, length: int) -> DataFrame:
    """by_range of one page; ValueError where start isn't one of its revisions."""
    page = compressed.where(F.col("page_id") == page_id)
    if page.where(F.col("idx") == start).isEmpty():
        raise ValueError(f"page {page_id} has no revision {start}")
    return by_range(page, start, length)


def half_open(compressed: DataFrame, start: int, length: int) -> DataFrame:
    """start to start + length - 1; nothing for a negative start or a length below 1."""
    inside = (F.col("idx") >= start) & (F.col("idx") < start + length) if start >= 0 and length > 0 else F.lit(False)
    return _texts(compressed.where(inside)).select("page_id", "idx", "text")


def by_indices(compressed: DataFrame, indices: list[int]) -> DataFrame:
    """pos, page_id, idx, text: in the order of the request, repeats kept."""
    if not indices:
        return _texts(compressed.where(F.lit(False))).select(F.lit(0).alias("pos"), "page_id", "idx", "text")
    some = _texts(compressed.where(F.col("idx").isin(*set(indices))))
    # a request is a short literal: each row is given as often as it is asked for
    at = f"filter(transform(array({','.join(map(str, indices))}), (x, i) -> if(x = idx, i, null)), i -> i is not null)"
    return some.withColumn("pos", F.explode(F.expr(at))).select("pos", "page_id", "idx", "text")


def by_revid(compressed: DataFrame, request: DataFrame, missing: str = "warn") -> DataFrame:
    """request: pos, revid (repeats kept). pos, revid, page_id, idx, text; an id that a page has twice gives the later one.

    missing: "error" raises on unknown ids, anything else leaves them out (missing_revids() lists them).
    """
    latest = compressed.groupBy("page_id", "revid").agg(F.max("idx").alias("idx"))
    found = request.join(latest, "revid", "left")
    if missing == "error":
        unknown = found.where("idx is null").limit(1).collect()
        if unknown:
            raise KeyError(unknown[0].revid)
    return _texts(found.where("idx is not null").join(compressed.drop("revid"), ["page_id", "idx"])).select("pos", "revid", "page_id", "idx", "text")


def missing_revids(compressed: DataFrame, request: DataFrame) -> DataFrame:
    return request.join(compressed.select("revid"), "revid", "left_anti")


def time_bounds(start: str | None, end: str | None, inclusive: bool = True, ts: Column | None = None) -> Column:
    """A bare start day begins at 00:00:00, a bare end day ends at 23:59:59 sharp. Fractions of its last second are out."""
    ts = F.col("ts") if ts is None else ts
    out = ts.isNotNull()
    if start is not None:
        low = _literal(start + "T00:00:00Z" if len(start) == 10 else start)
        out &= ts >= low if inclusive else ts > low
    if end is not None:
        high = _literal(end + "T23:59:59Z" if len(end) == 10 else end)
        out &= ts <= high if inclusive else ts < high
    return out


def _literal(value: str) -> Column:
    when = parse_iso(value)
    return F.lit(when.astimezone(datetime.timezone.utc))


def by_time(compressed: DataFrame, start: str | None = None, end: str | None = None, inclusive: bool = True) -> DataFrame:
    return _texts(compressed.where(time_bounds(start, end, inclusive))).select("page_id", "idx", "ts", "text")


def by_instance(compressed: DataFrame, number: int, k: int) -> DataFrame:
    """Revision by 1-based number in a k + 1 layout, with the number of its full copy."""
    near = (number - 1) // (k + 1) * (k + 1) + 1
    return _texts(compressed.where(F.col("idx") == number - 1)).select("page_id", F.lit(number).alias("instance"), F.lit(near).alias("full_instance"), "text")


def by_period(compressed: DataFrame, number: int, k: int) -> DataFrame:
    """Revision by 1-based number in a k layout, with the number of its full copy."""
    near = number - (number - 1) % k
    return _texts(compressed.where(F.col("idx") == number - 1)).select("page_id", F.lit(number).alias("instance"), F.lit(near).alias("full_instance"), "text")


def access(compressed: DataFrame, idx: int) -> DataFrame:
    """page_id, idx, text of one revision by 0-based index; pages that are shorter give nothing."""
    return by_range(compressed, idx, 0)


def check_meta(artifacts: DataFrame, key: str) -> DataFrame:
    """artifacts; KeyError where a meta has no such field or one of them lacks it."""
    if key not in artifacts.schema["meta"].dataType.names or not artifacts.where(F.col(f"meta.{key}").isNull()).isEmpty():
        raise KeyError(f"meta has no {key}")
    return artifacts


def random_accesses(revisions: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """n revisions drawn for timing; the same for the same seed."""
    return revisions.select("page_id", "idx").orderBy(F.xxhash64(F.lit(seed), "page_id", "idx")).limit(n)


def request(spark: SparkSession, revids: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(revids)), "pos int, revid long")
