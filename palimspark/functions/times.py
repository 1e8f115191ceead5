"""Time stamps as they come: with or without seconds, fractions, Z or an offset."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERNS = ("yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd HH:mmXXX")


def parse_iso(value: str) -> datetime.datetime:
    """A driver-side literal; no zone counts as UTC."""
    when = datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
    return when if when.tzinfo else when.replace(tzinfo=datetime.timezone.utc)


def iso_to_ts(column: Column) -> Column:
    """Null where it can't be read."""
    return F.coalesce(F.try_to_timestamp(column), *[F.try_to_timestamp(column, F.lit(p)) for p in _PATTERNS])


def ts_to_iso(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
