"""Ids against file ranges, lookups with order, and what is still to do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the grid cells by which ids meet ranges.
CELL = 100_000
#: Names that are searched for in one pass over the lines.
NAMES_PER_PASS = 20_000


def covering(ids: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every (id, range) with lo <= id <= hi; ids: page_id; ranges: lo, hi and anything else.

    An equi-join on the cells that a range meets, whatever their number; Spark
    broadcasts ranges by their size.
    """
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor(F.col("hi") / CELL))))
    x = ids.withColumn("_cell", F.floor(F.col("page_id") / CELL))
    return x.join(cells, "_cell").where(F.col("page_id").between(F.col("lo"), F.col("hi"))).drop("_cell")


def first_covering(ids: DataFrame, ranges: DataFrame, order: list[str]) -> DataFrame:
    """The first range by order for each id; ids in no range are left out."""
    keep = [c for c in ranges.columns if c not in order]
    row = F.struct(*order, *keep)
    return covering(ids, ranges).groupBy("page_id").agg(F.min(row).alias("r")).select("page_id", "r.*")


def all_covering(ids: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """page_id and the sorted names of all its ranges; an empty list where there is none."""
    found = covering(ids, ranges).groupBy("page_id").agg(F.sort_array(F.collect_set(name)).alias("names"))
    return ids.distinct().join(found, "page_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def by_file(ids: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """name, page_ids: ids regrouped under the first file that covers them."""
    return first_covering(ids, ranges, [name]).groupBy(name).agg(F.sort_array(F.collect_list("page_id")).alias("page_ids"))


def with_titles(ids: DataFrame, titles: DataFrame) -> DataFrame:
    """title of each page_id; page_<id> where there is none."""
    return ids.join(titles, "page_id", "left").withColumn("title", F.coalesce("title", F.concat(F.lit("page_"), F.col("page_id").cast("string"))))


def left_to_do(wanted: DataFrame, done: DataFrame, key: str = "page_id", force: bool = False) -> DataFrame:
    return wanted if force else wanted.join(done.select(key).distinct(), key, "left_anti")


def skipped(wanted: DataFrame, done: DataFrame, key: str = "page_id") -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_semi").withColumn("skipped", F.lit(True))


def named_in(names: DataFrame, lines: DataFrame, name: str, line: str, at_once: int = NAMES_PER_PASS) -> DataFrame:
    """Lines joined with each row of names whose name they hold anywhere; null names and lines hold nothing.

    Names go in blocks of about at_once by hash, a pass over the lines for each:
    a line is searched once for all names of the block, by the names' lengths and
    a set, and the names found are joined back by equality.
    """
    every = names.select(F.col(name).alias("_name")).where("_name is not null").distinct()
    passes = max(1, -(-every.count() // at_once))
    spark = lines.sparkSession
    found = None
    for i in range(passes):
        some = every.where(F.pmod(F.xxhash64("_name"), F.lit(passes)) == i)
        table = spark.sparkContext.broadcast(frozenset(r._name for r in some.toLocalIterator()))

        def search(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            sizes = sorted({len(n) for n in table.value})
            for b in batches:
                out: list[list[str]] = []
                for text in b.column(b.num_columns - 1).to_pylist():
                    held = set() if text is None else {text[at : at + n] for n in sizes for at in range(len(text) - n + 1)}
                    out.append(sorted(held & table.value))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.string()))], [*b.schema.names[:-1], "_names"])

        x = lines.withColumn("_text", F.col(line).cast("string"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "_text")
        part = x.mapInArrow(search, f"{fields}, _names array<string>").select("*", F.explode("_names").alias("_name")).drop("_names")
        found = part if found is None else found.union(part)
    return found.join(names.withColumn("_name", F.col(name)), "_name").drop("_name")


def append_rows(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns under the sorted union of these."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def page_filter(title: str | None = None, page_id: int | None = None) -> Column:
    """Both where both are given; every page where none is."""
    out = F.lit(True)
    if title is not None:
        out &= F.col("title") == title
    if page_id is not None:
        out &= F.col("page_id") == page_id
    return out
