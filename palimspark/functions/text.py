"""Text accessors: words, addresses, links, tags, instance types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"\S+@\S+"
#: All signs between $ and _, which are digits and capitals too, small letters, and !.
URL = r"https?://[!$-_a-z]+"
MARKS = ".,:;'\""


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """word, n: lower case, without marks, parted by single spaces, so empty words count too. Nulls have none."""
    words = F.split(F.translate(F.lower(F.col(text)), MARKS, ""), " ", -1)
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def tags(column: Column) -> Column:
    """"<a><b>" to its parts, brackets at the ends kept, as tag lists are cut at "><"."""
    return F.split(column, "><", -1)


def is_type(column: Column, name: str) -> Column:
    """Question, Answer or Comments: true, or null."""
    return F.when(column == name, F.lit(True))


def is_closed(closed: Column) -> Column:
    """Whether there is a date of closing."""
    return closed.isNotNull()


def is_number(column: Column) -> Column:
    return column.rlike(r"^-?[0-9]+\z")


def id_list(text: str, strict: bool = False) -> list[int]:
    """Ids of a comma-separated list; tokens that aren't digits are left out, or with strict fail."""
    parts = [p.strip() for p in text.split(",")]
    return [int(p) for p in parts if p and (strict or p.isdigit())]
