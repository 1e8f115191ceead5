"""The driver's tables as revision histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimspark.plans import blocks


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a page, its turns are revisions."""
    x = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("revid"), F.col("turn"), F.coalesce("text", F.lit("")).alias("text")
    )
    # the size before the shuffle, so that plans without texts don't move them
    x = blocks.number(x.withColumn("size", F.length("text").cast("long")), "page_id", "turn").drop("turn")
    return x.select("page_id", "idx", "revid", F.lit(None).cast("timestamp").alias("ts"), "text", "size")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a page; events by time and id are revisions."""
    x = read(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("revid"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("text"))
    # by microsecond; events of one microsecond, by id
    x = x.withColumn("_k", F.unix_micros("ts")).withColumn("text", F.coalesce("text", F.lit("")))
    x = _by_time(x.withColumn("size", F.length("text").cast("long")))
    return x.select("page_id", "idx", "revid", "ts", "text", "size")


def _by_time(x: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    from pyspark.sql import Window as W

    x = x.withColumn("_b", F.floor(F.col("_k") / width))
    before = W.partitionBy("page_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = x.groupBy("page_id", "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    x = x.withColumn("_r", F.row_number().over(W.partitionBy("page_id", "_b").orderBy("_k", "revid")) - 1)
    return x.join(starts.hint("merge"), ["page_id", "_b"]).withColumn("idx", (F.col("_r") + F.col("_s")).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a page; orders by date and key are revisions with the price in hundreds as size, and no text."""
    x = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("revid"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("size")
    )
    x = _by_time(x.withColumn("_k", F.unix_micros("ts")), 366 * 86_400_000_000)
    return x.select("page_id", "idx", "revid", "ts", "size")
