"""Order-dependent columns within a page, without putting a whole page in one task.

A page's rows are cut into blocks of BLOCK indices. Neighbours across a block's
edge and totals of earlier blocks are the only things that blocks exchange, so
a page that holds a third of all revisions spreads over many tasks.

Joins of tables that grow with the revisions are told to sort (here and in the
operators): Spark judges a stored table by its files, of which 10 MB can be
millions of these narrow rows, and each executor would hold all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 65_536


def number(df: DataFrame, page: str, key: str, width: int = 1_000_000, name: str = "idx") -> DataFrame:
    """Adds the 0-based position within page by an integer key (ties: in no order, so keys must be unique in a page)."""
    x = df.withColumn("_b", F.floor(F.col(key) / width))
    before = W.partitionBy(page).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = x.groupBy(page, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    x = x.withColumn("_r", F.row_number().over(W.partitionBy(page, "_b").orderBy(key)) - 1)
    return x.join(starts.drop("_n").hint("merge"), [page, "_b"]).withColumn(name, (F.col("_r") + F.col("_s")).cast("int")).drop("_b", "_r", "_s")


def previous(df: DataFrame, column: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds column of the row at idx - 1 of the same page (null for the first)."""
    own = F.expr(f"idx div {block}")
    # a block's last row also goes, marked, to the next block: one scan and one shuffle
    last = (F.col("idx") + 1) % block == 0
    to = F.when(last, F.array(F.struct(own.alias("b"), F.lit(False).alias("edge")), F.struct((own + 1).alias("b"), F.lit(True).alias("edge")))).otherwise(
        F.array(F.struct(own.alias("b"), F.lit(False).alias("edge")))
    )
    x = df.withColumn("_to", F.explode(to)).withColumns({"_b": F.col("_to.b"), "_edge": F.col("_to.edge")}).drop("_to")
    w = W.partitionBy("page_id", "_b").orderBy("idx")
    return x.withColumn(name, F.lag(column).over(w)).where(~F.col("_edge")).drop("_b", "_edge")


def running(df: DataFrame, value: Column, name: str, how: str = "sum", block: int = BLOCK) -> DataFrame:
    """Adds the running sum or maximum of value from the page's first row to each row."""
    agg = {"sum": F.sum, "max": F.max}[how]
    x = df.withColumn("_v", value).withColumn("_b", F.expr(f"idx div {block}"))
    w = W.partitionBy("page_id", "_b").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("page_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = x.groupBy("page_id", "_b").agg(agg("_v").alias("_t")).withColumn("_t", agg("_t").over(earlier))
    x = x.withColumn("_w", agg("_v").over(w)).join(totals.hint("merge"), ["page_id", "_b"])
    total = F.coalesce(F.col("_w"), F.lit(0)) + F.coalesce(F.col("_t"), F.lit(0)) if how == "sum" else F.greatest("_w", "_t")
    return x.withColumn(name, total).drop("_v", "_b", "_w", "_t")
