"""Reports over layouts and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimspark.operators import layout
from palimspark.plans import blocks


def page_summary(parts: DataFrame) -> DataFrame:
    """Per page: costs, partitions, chain lengths, ratio (null without text), density."""
    chains = chain_lengths(parts).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_partitions"), F.avg("chain_len").alias("avg_chain_len"), F.max("chain_len").alias("max_chain_len")
    )
    x = layout.costs(parts).join(chains.hint("merge"), "page_id")
    return x.withColumn("compression_ratio", F.when(F.col("orig_size") > 0, F.col("space_cost") / F.col("orig_size"))).withColumn(
        "anchor_density", F.col("n_anchors") / F.col("n_revisions")
    )


def chain_lengths(parts: DataFrame) -> DataFrame:
    return parts.groupBy("page_id", "part_id").agg(F.count(F.lit(1)).alias("chain_len"))


def corpus_aggregate(pages: DataFrame) -> DataFrame:
    """One row over page summaries; nulls don't count, nor do pages without revisions for the density. No row for no pages."""
    density = F.when(F.col("n_revisions") > 0, F.col("anchor_density"))
    return pages.agg(
        F.count(F.lit(1)).alias("artifacts"), F.avg("compression_ratio").alias("mean_ratio"), F.median("compression_ratio").alias("median_ratio"),
        F.avg(density).alias("avg_density"), F.avg("time_cost").alias("avg_time"), F.avg("space_cost").alias("avg_space"),
    ).where("artifacts > 0")


def chain_histogram(parts: DataFrame, bins: int = 20) -> DataFrame:
    """bin, low, n of equally wide bins over all chain lengths, exact; the last bin holds its upper end. Empty bins aren't listed."""
    return histogram(chain_lengths(parts), "chain_len", bins)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    lengths = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    ends = lengths.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = lengths.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return x.groupBy(at.cast("int").alias("bin"), F.col("lo").alias("_lo"), width.alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), "n"
    )


def tradeoff_points(pages: DataFrame) -> DataFrame:
    """What a scatter plot of space against time needs."""
    return pages.select("page_id", "space_cost", "time_cost", "compression_ratio")


def count_revisions(meta: Column) -> Column:
    """count, or the length of revids, timestamps or the partitions, or 0."""
    known = lambda c: F.when(F.size(c) > 0, F.size(c))
    return F.coalesce(
        meta["count"], known(meta["revids"]), known(meta["timestamps"]), known(F.flatten(meta["partitions"])), F.lit(0)
    )


def summarize_artifacts(artifacts: DataFrame, name: Column | None = None) -> DataFrame:
    """One metrics row per artifact row, from its meta alone; columns as in model.METRICS."""
    m = F.col("meta")
    lengths = F.transform(m["partitions"], lambda p: F.size(p))
    n, parts = count_revisions(m), F.coalesce(F.size(m["partitions"]), F.lit(0))
    anchors = F.greatest(F.size("anchors"), F.lit(0))
    sizes, steps = m["sizes"], F.sequence(F.lit(0), F.size(m["sizes"]) - 1)
    firsts = F.transform(m["partitions"], lambda p: F.element_at(p, 1))
    change = lambda i: F.abs(F.element_at(sizes, i + 1) - F.element_at(sizes, F.greatest(i, F.lit(1))))
    total = lambda f: F.aggregate(F.transform(steps, f), F.lit(0).cast("long"), lambda a, x: a + x)
    some = F.size(sizes) > 0
    space = F.when(some, total(lambda i: F.when(F.array_contains(firsts, i), F.element_at(sizes, i + 1)).otherwise(change(i))))
    time = F.when(some, total(lambda i: F.when(F.array_contains(firsts, i), F.lit(1)).otherwise(F.element_at(sizes, F.greatest(i, F.lit(1))) + change(i))))
    orig = F.when(some, total(lambda i: F.element_at(sizes, i + 1)))
    x = artifacts.select(
        (name if name is not None else F.concat(F.lit("page_"), m["page_id"].cast("string"), F.lit(".comp.gz"))).alias("artifact"),
        F.coalesce(m["title"], F.col("title")).alias("title"), m["page_id"].alias("page_id"), n.alias("n_revisions"), anchors.alias("n_anchors"), parts.alias("n_partitions"),
        F.when(F.size(lengths) > 0, F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / F.size(lengths)).otherwise(0.0).alias("avg_chain_len"),
        F.coalesce(F.array_max(lengths), F.lit(0)).alias("max_chain_len"), F.coalesce(m["space_cost"], space).alias("space_cost"),
        F.coalesce(m["time_cost"], time).alias("time_cost"), F.coalesce(m["orig_size"], orig).alias("orig_size"), m["solver"].alias("solver"),
        m["strategy"].alias("strategy"), m["time_budget"].alias("time_budget"),
    )
    ratio = F.when(F.col("orig_size") > 0, F.col("space_cost") / F.col("orig_size"))
    density = F.when(F.col("n_revisions") > 0, F.col("n_anchors") / F.col("n_revisions"))
    order = "artifact title page_id n_revisions n_anchors n_partitions avg_chain_len max_chain_len space_cost time_cost orig_size compression_ratio anchor_density solver strategy time_budget"
    return x.withColumn("compression_ratio", ratio).withColumn("anchor_density", density).select(*order.split())


def manifest(metrics: DataFrame, source_file: str | Column = "", seconds: float = 0.0) -> DataFrame:
    """Manifest rows of artifacts just written."""
    source = F.lit(source_file) if isinstance(source_file, str) else source_file
    return metrics.select(
        "title", "page_id", source.alias("source_file"), "artifact", F.col("n_revisions").alias("revisions"), F.col("n_anchors").alias("anchors"),
        F.col("n_partitions").alias("partitions"), "solver", "strategy", "time_budget", F.round(F.lit(seconds), 3).alias("compress_seconds"), "space_cost", "time_cost",
    )


def interval_sweep(revisions: DataFrame) -> DataFrame:
    """page_id, choice, k, space_cost, ratio of the fixed layouts with 1, root n, the formula, 1000 and n - 1."""
    c = layout.interval_choices(revisions)
    ks = F.array(
        *[F.struct(F.lit(n).alias("choice"), F.col(k).cast("long").alias("k")) if isinstance(k, str) else F.struct(F.lit(n).alias("choice"), F.lit(k).cast("long").alias("k"))
          for n, k in (("one", 1), ("root_n", "root_n"), ("formula", "formula"), ("thousand", 1000), ("n_less_1", "n_less_1"))]
    )
    x = blocks.previous(revisions.select("page_id", "idx", "size"), "size", "prev_size")
    y = x.join(c.select("page_id", F.explode(ks).alias("c")).select("page_id", "c.*").where("k >= 1"), "page_id")
    stored = F.when(F.col("idx") % F.col("k") == 0, F.col("size")).otherwise(F.abs(F.col("size") - F.col("prev_size")))
    return y.groupBy("page_id", "choice", "k").agg(F.sum(stored).alias("space_cost"), F.sum("size").alias("orig_size")).select(
        "page_id", "choice", "k", "space_cost", F.when(F.col("orig_size") > 0, F.col("space_cost") / F.col("orig_size")).alias("ratio")
    )


def timings(report: DataFrame, column: str) -> DataFrame:
    return report.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("stdev"))
