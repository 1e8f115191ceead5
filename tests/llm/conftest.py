import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "score double, key string, id long, h int, node long, comp long, size int, b int, q int, kind string, copies int, y int, target double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, start=0):
    return " ".join(f"w{(start + i) * 7919 % 10007}" for i in range(n))


LONG_WORD = "abc" * 40_000
LONG_TEXT = prose(40_000)
MESSY = [
    (1, prose(60), "en", "a", 5),
    (2, prose(60), "en", "a", 5),  # a copy
    (3, prose(58) + " changed end", None, "a", None),  # nearly
    (3, prose(58) + " changed end", None, "a", None),  # a repeated row
    (4, None, "en", "b", 0),
    (5, "", "de", None, 0),
    (6, " \t\n ", "de", None, 3),
    (7, "one", "fr", "b", 3),
    (8, "One", "fr", "b", 3),
    (9, LONG_WORD, "fr", "c", 1),
    (10, LONG_TEXT, None, "c", 1),
    (None, prose(60), "en", "a", 1),
    (11, "x\x00y \U0001f600 café İ " + prose(5, 500), "en", "", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(MESSY, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    out = docs
    for column in CLASHING.split(", "):
        name, kind = column.split(" ")
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
