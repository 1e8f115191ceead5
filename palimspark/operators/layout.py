"""Which revisions are kept in full: features, knapsack items, partitions, fixed layouts, costs.

Revisions are rows (page_id, idx, size, ...). A transition is the step from
idx - 1 to idx. Only page_id, idx and numbers go through these plans; texts are
joined back where they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimspark.operators import solvers
from palimspark.plans import blocks

#: value of a transition, by name, from the estimated diff, the size before and the size after
VALUE_MODELS = {
    "edit_size": lambda diff, before, after: diff - before,
    "saved_size": lambda diff, before, after: after - F.abs(after - before),
}


def transitions(revisions: DataFrame, value_model: str = "edit_size") -> DataFrame:
    """page_id, idx (>= 1), size, prev_size, diff (twice the change of size), value, weight."""
    x = blocks.previous(revisions.select("page_id", "idx", "size"), "size", "prev_size").where("idx > 0")
    diff = (F.abs(F.col("size") - F.col("prev_size")) * 2).cast("long")
    x = x.withColumn("diff", diff)
    value = VALUE_MODELS[value_model](F.col("diff"), F.col("prev_size"), F.col("size"))
    return x.withColumn("value", value.cast("long")).withColumn("weight", (F.col("prev_size") + F.col("diff")).cast("long"))


def candidates(revisions: DataFrame, value_model: str = "edit_size") -> DataFrame:
    """Transitions that a delta may be worth."""
    return transitions(revisions, value_model).where("value > 0 and weight > 0")


def choose(
    revisions: DataFrame, time_budget: int | None = None, strategy: str = "auto", solver: str = "heuristic", eps: float = solvers.EPS,
    max_states: int = solvers.MAX_STATES, value_model: str = "edit_size",
) -> DataFrame:
    """page_id, idx of the transitions that become deltas under each page's budget (none given: its revisions squared).

    Pages whose candidates all fit into the budget take them all, in SQL. Only the
    numbers of the other pages' candidates go to the solver, a page at a time.
    Page ids are integers; rows without one have no choice.
    """
    items = candidates(revisions, value_model).select("page_id", "idx", "value", "weight")
    n = revisions.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    budget = F.lit(time_budget).cast("long") if time_budget is not None else F.col("n") * F.col("n")
    pages = items.groupBy("page_id").agg(F.sum("weight").alias("total")).join(n.hint("merge"), "page_id").withColumn("budget", budget)
    x = items.join(pages.select("page_id", "budget", "total").hint("merge"), "page_id")
    easy = x.where("total <= budget").select("page_id", "idx")

    def solve(table: pa.Table) -> pa.Table:
        """Of whole pages: the rows that are taken."""
        pages = table.column(0).to_numpy()
        v, w, budgets = (table.column(i).to_pylist() for i in (2, 3, 4))
        cuts = [0, *(np.flatnonzero(np.diff(pages)) + 1).tolist(), len(pages)]
        taken = []
        for a, b in zip(cuts, cuts[1:]):
            if solver == "exact":
                got = solvers.exact(v[a:b], w[a:b], budgets[a])
            else:
                got = solvers.heuristic(v[a:b], w[a:b], budgets[a], strategy, eps, max_states)
            taken += [a + i for i in sorted(got)]
        return table.select([0, 1]).take(pa.array(taken, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last page of a batch may go on in the next
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            pages = batch.column(0).to_numpy()
            last = int(np.searchsorted(pages, pages[-1]))
            if last or kept and kept[-1].column(0)[-1].as_py() != pages[0]:
                whole = [*kept, *([batch.slice(0, last)] if last else [])]
                kept = []
                yield from solve(pa.Table.from_batches(whole)).to_batches()
            kept.append(batch.slice(last))
        if kept:
            yield from solve(pa.Table.from_batches(kept)).to_batches()

    # to take all is best where all fit, whatever the solver; many pages a task, in a stream of whole pages
    parts = int(revisions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hard = x.where("total > budget").select(F.col("page_id").cast("long").alias("page_id"), F.col("idx").cast("int").alias("idx"), "value", "weight", "budget")
    hard = hard.repartition(parts, "page_id").sortWithinPartitions("page_id", "idx")
    return easy.union(hard.mapInArrow(run, "page_id long, idx int"))


def partition(revisions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds is_anchor and part_id: a revision starts a partition unless its transition was chosen."""
    flags = chosen.select("page_id", "idx").withColumn("_c", F.lit(True))
    x = revisions.join(flags.hint("merge"), ["page_id", "idx"], "left").withColumn("is_anchor", F.col("_c").isNull()).drop("_c")
    return part_ids(x)


def part_ids(x: DataFrame) -> DataFrame:
    return blocks.running(x, F.col("is_anchor").cast("long"), "_p").withColumn("part_id", (F.col("_p") - 1).cast("int")).drop("_p")


def partition_all(revisions: DataFrame) -> DataFrame:
    """partition() when the budget takes every candidate."""
    return partition(revisions, candidates(revisions))


def fixed_interval(revisions: DataFrame, k: int | Column, period: str = "k") -> DataFrame:
    """Anchors every k ("k") or every k + 1 ("k+1") revisions. k below 1 counts as 1."""
    step = F.greatest(F.lit(k) if isinstance(k, int) else k, F.lit(1)) + (1 if period == "k+1" else 0)
    return revisions.withColumn("is_anchor", F.col("idx") % step == 0).withColumn("part_id", F.floor(F.col("idx") / step).cast("int"))


def interval_choices(revisions: DataFrame) -> DataFrame:
    """page_id, n and the intervals root_n, log2 (squared logarithm), n_less_1, formula, theorem (null where undefined)."""
    x = blocks.previous(revisions.select("page_id", "idx", "size"), "size", "prev_size")
    g = x.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.coalesce(F.sum(F.abs(F.col("size") - F.col("prev_size"))), F.lit(0)).alias("change")
    )
    m, d = F.lit(0.001) * F.col("total") / F.col("n"), F.lit(0.01) * F.col("change") / F.col("n")
    g = g.withColumn("m", m).withColumn("d", d)
    good = (F.col("m") > F.col("d")) & (F.col("d") > 0)
    return g.select(
        "page_id", "n", F.floor(F.sqrt("n")).cast("int").alias("root_n"), F.floor(F.pow(F.log("n"), 2)).cast("int").alias("log2"), (F.col("n") - 1).cast("int").alias("n_less_1"),
        F.when(good, F.floor(F.sqrt(F.col("n") * (F.col("m") - F.col("d")) / (F.col("m") * F.col("d"))))).cast("long").alias("formula"),
        F.when(good, F.floor(F.sqrt(F.col("n") * (F.col("m") - F.col("d")) / (F.col("m") + F.col("d"))))).cast("long").alias("theorem"),
    )


def merge_greedy(revisions: DataFrame) -> DataFrame:
    """page_id, idx, accepted for each transition: taken if the running cost doesn't rise, whatever the order."""
    x = transitions(revisions)
    change = F.abs(F.col("size") - F.col("prev_size"))
    return x.select("page_id", "idx", ((change - F.col("size")) + (F.col("prev_size") + change) <= 1).alias("accepted"))


def older_items(revisions: DataFrame) -> DataFrame:
    """Items of the older knapsack: value is the size before, weight 1 + size; the first two revisions are always full."""
    return transitions(revisions).where("idx > 1").select("page_id", "idx", F.col("prev_size").alias("value"), (F.col("size") + 1).alias("weight"))


def costs(parts: DataFrame) -> DataFrame:
    """page_id, n_revisions, n_anchors, orig_size, space_cost, time_cost of a partitioned table."""
    x = blocks.previous(parts.select("page_id", "idx", "size", "is_anchor"), "size", "prev_size")
    change = F.abs(F.col("size") - F.col("prev_size"))
    return x.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_revisions"), F.sum(F.col("is_anchor").cast("long")).alias("n_anchors"), F.sum("size").alias("orig_size"),
        F.sum(F.when(F.col("is_anchor"), F.col("size")).otherwise(change)).alias("space_cost"),
        F.sum(F.when(F.col("is_anchor"), F.lit(1)).otherwise(F.col("prev_size") + change)).alias("time_cost"),
    )


def enumerate_partitions(revisions: DataFrame, most: int = 12) -> DataFrame:
    """page_id, mask, space, time of every way to cut a page of at most `most` revisions; bit i - 1 of mask: a cut before i."""
    x = blocks.previous(revisions.select("page_id", "idx", "size"), "size", "prev_size")
    n = x.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    masks = n.select("page_id", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("n") - 1).cast("int") - 1)).alias("mask"))
    y = x.join(masks, "page_id")
    cut = (F.col("idx") == 0) | (F.expr("shiftright(mask, greatest(idx - 1, 0)) & 1") == 1)
    change = F.abs(F.col("size") - F.col("prev_size"))
    return y.groupBy("page_id", "mask").agg(
        F.sum(F.when(cut, F.col("size")).otherwise(change)).alias("space"), F.sum(F.when(cut, F.lit(1)).otherwise(F.col("prev_size") + change)).alias("time")
    )


def anchor_of(parts: DataFrame) -> DataFrame:
    """Adds anchor_idx: the last anchor at or before each revision."""
    return blocks.running(parts, F.when(F.col("is_anchor"), F.col("idx")), "anchor_idx", "max")


def part_lists(parts: DataFrame) -> DataFrame:
    """page_id, partitions: the indices of each partition, in order."""
    one = parts.groupBy("page_id", "part_id").agg(F.sort_array(F.collect_list("idx")).alias("ids"))
    return one.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("part_id", "ids"))), lambda s: s["ids"]).alias("partitions"))
