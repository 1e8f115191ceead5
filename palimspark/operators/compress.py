"""Pages to compressed form and back.

The long form has one row per revision: anchors with base_text, the rest with a
line patch. The nested form is one artifact row per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimspark.model import META
from palimspark.operators import delta, layout, solvers
from palimspark.plans.stage import staged


def compress(revisions: DataFrame, time_budget: int | None = None, strategy: str = "auto", solver: str = "heuristic", eps: float = solvers.EPS, max_states: int = solvers.MAX_STATES, value_model: str = "edit_size", only: Column | None = None) -> DataFrame:
    """Runs the layout at once; what comes back is lazy, and of the revisions that only holds for (of page_id, idx, revid, ts), if given: no other deltas are made.

    revisions plus part_id, is_anchor, base_text (anchors), patch (the others); text is dropped.
    revisions are read three times: give a stored or staged table.
    """
    sizes = staged(revisions.select("page_id", "idx", "size"), "sizes")
    chosen = staged(layout.choose(sizes, time_budget, strategy, solver, eps, max_states, value_model), "chosen")
    return as_deltas(revisions, staged(layout.partition(sizes, chosen), "parts"), only)


def as_deltas(revisions: DataFrame, parts: DataFrame, only: Column | None = None) -> DataFrame:
    """The long form of any partitioned layout (page_id, idx, is_anchor, part_id) of revisions."""
    flags = parts.select("page_id", "idx", "is_anchor", "part_id")
    x = delta.with_delta(revisions, delta.predecessors(parts), only=only).join(flags.hint("merge"), ["page_id", "idx"])
    return x.withColumn("base_text", F.when(F.col("is_anchor"), F.coalesce("text", F.lit("")))).drop("text")


def text_of() -> Column:
    """A revision's text from its row of the long form. A line patch holds its whole target, so no chain is walked."""
    return F.coalesce(F.col("base_text"), delta.restored(F.col("patch")))


def decompress(compressed: DataFrame) -> DataFrame:
    return compressed.withColumn("text", text_of()).drop("base_text", "patch")


def artifacts(compressed: DataFrame, titles: DataFrame | None = None, time_budget: int | None = None, strategy: str = "auto", solver: str = "heuristic") -> DataFrame:
    """page_id and one nested artifact row per page; titles: page_id, title (default page_<id>)."""
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    # sort_array by idx: a group has no order of its own
    row = F.struct("idx", "is_anchor", "part_id", "revid", stamp.alias("ts"), "base_text", "patch", F.col("size").cast("int").alias("size"))
    x = compressed.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("r")).join(layout.costs(compressed).hint("merge"), "page_id")
    if titles is not None:
        x = x.join(titles.select("page_id", "title"), "page_id", "left")
    else:
        x = x.withColumn("title", F.lit(None).cast("string"))
    x = x.withColumn("title", F.coalesce("title", F.concat(F.lit("page_"), F.col("page_id").cast("string"))))
    x = x.withColumn("_budget", F.lit(time_budget).cast("long") if time_budget is not None else F.col("n_revisions") * F.col("n_revisions"))
    anchors = F.filter("r", lambda s: s["is_anchor"])
    deltas = F.filter("r", lambda s: ~s["is_anchor"])
    bases = F.map_from_entries(F.transform(anchors, lambda s: F.struct(s["idx"].cast("string"), s["base_text"])))
    ids = F.transform(
        F.array_distinct(F.transform("r", lambda s: s["part_id"])), lambda p: F.transform(F.filter("r", lambda s: s["part_id"] == p), lambda s: s["idx"])
    )
    x = x.withColumn("_parts", ids)
    meta = F.struct(
        F.col("title"), F.size("r").alias("count"), F.col("_parts").alias("partitions"), F.transform("r", lambda s: s["revid"]).alias("revids"),
        F.transform("r", lambda s: s["ts"]).alias("timestamps"), bases.alias("base_texts"), F.col("orig_size"), F.col("space_cost"), F.col("time_cost"),
        F.transform("r", lambda s: s["size"]).alias("sizes"), F.lit(solver).alias("solver"), F.lit(strategy).alias("strategy"),
        F.col("_budget").alias("time_budget"), F.col("page_id"), F.transform("_parts", lambda p: F.size(p)).alias("chain_lengths"),
    )
    key = lambda s: F.concat((s["idx"] - 1).cast("string"), F.lit("-"), s["idx"].cast("string"))
    return x.select(
        "page_id", "title", F.transform(anchors, lambda s: s["idx"]).alias("anchors"),
        F.map_from_entries(F.transform(deltas, lambda s: F.struct(key(s), s["patch"]))).alias("patches"),
        bases.alias("base_texts"), meta.cast(META).alias("meta"),
    )


def explode(artifact: DataFrame) -> DataFrame:
    """The long form again, from artifact rows. Sizes and partitions come from meta."""
    x = artifact.withColumn("_p", F.col("meta.page_id")).select("_p", "meta", "patches", "base_texts", F.posexplode("meta.revids").alias("idx", "revid"))
    at = F.col("idx").cast("string")
    part = F.expr("array_position(transform(meta.partitions, p -> array_contains(p, idx)), true) - 1")
    key = F.concat((F.col("idx") - 1).cast("string"), F.lit("-"), at)
    base = F.try_element_at("base_texts", at)
    return x.select(
        F.col("_p").alias("page_id"), "idx", "revid", F.try_to_timestamp(F.element_at("meta.timestamps", F.col("idx") + 1)).alias("ts"),
        F.element_at("meta.sizes", F.col("idx") + 1).cast("long").alias("size"), F.try_element_at("patches", key).alias("patch"),
        base.isNotNull().alias("is_anchor"), part.cast("int").alias("part_id"), base.alias("base_text"),
    )
