"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. Every document of a source has the
same expected number of copies, target / source size. The documents of a source
stand in a fixed order (by floor(sqrt(size)), md5 of id, id), their
expected copies are prefix-summed, one offset in [0, 1) that depends on source
and seed is added, and a document is emitted once for each integer boundary
that its interval crosses. Ordering by size makes the words that are taken come
near the target, not just the copies.

The prefix sum has three levels, so that a source with a third of all rows isn't
one task: positions within (source, size class, block of hashes), totals of a
class's blocks, and totals of a source's classes. Sources are any number: they
are numbered by ranges, and their targets are found by rounds of sums, of which
the driver sees two numbers a round. A row's source data comes with its block's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimspark.llm.common import WORD_RE, blocks, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
ROWS_PER_BLOCK = 50_000


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)).cast("long"), F.lit(0).cast("long"))


def numbered(sources: DataFrame) -> DataFrame:
    """Adds at: the place of source from 0, by code point, null last; sources are distinct. No task holds them all."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    x = cut(x.withColumn("own", F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1), "sources")
    # a row for each range
    starts, total = [], 0
    for r in x.groupBy("part").count().orderBy("part").collect():
        starts.append((r.part, total))
        total += r["count"]
    if not starts:
        return x.withColumn("at", F.lit(0).cast("long")).drop("part", "own")
    first = F.broadcast(x.sparkSession.createDataFrame(starts, "part int, first long"))
    return x.join(first, "part").withColumn("at", F.col("first") + F.col("own")).drop("part", "own", "first")


def plan(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds weight, target to (source, source_size) rows, one a source.

    Targets are in proportion to the weights, which repeat along the sources. Those above
    most * size are set to it, and the rest is shared again until none is above:
    the words for a weight of 1 grow from round to round, and stop after as many
    as there are kinds of sources that reach their limit, a few.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    x = numbered(totals).withColumn("weight", F.element_at(pattern, (F.col("at") % len(weights) + 1).cast("int"))).drop("at")
    size, full = F.col("source_size"), F.lit(float(most)) * F.col("source_size")
    total = float(share) * (x.agg(F.sum("source_size").alias("n")).first().n or 0)
    left, free, bound = 0.0, 1.0, -1
    while True:
        # what a source would get; those that were set to their limit by a round before are above it in all later ones
        due = F.lit(left) * F.col("weight") / F.lit(free)
        over = (size > 0) & (due > full)
        sums = x.where(size > 0).agg(F.count_if(over).alias("n"), F.sum(F.when(over, full)).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if sums.n == bound or not sums.weight:
            break
        bound, left, free = sums.n, total - (sums.given or 0.0), sums.weight
    target = F.when(size <= 0, 0.0).when(over, full).otherwise(due)
    return x.withColumn("target", target)


def offset(source: Column, seed: int) -> Column:
    """In [0, 1), from source and seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken (copies * size), carried columns.

    Null source is a source of its own, last in order. Null and empty texts have
    size 0 and are taken 0 words; texts are counted whole, however long. Ids may
    be of any type; rows without one come first in their class, told apart by
    their place in the scan alone. Repeated rows count one by one; ties in the
    order are between rows of equal size class and id, where the words taken
    differ by less than a class is wide. An empty table gives an empty one.
    Columns that aren't carried aren't looked at, whatever their names; a carried
    column whose name is that of one of the others comes as carry_<name>. What is carried
    is written once more to the shared folder.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"),
        F.monotonically_increasing_id().alias("place"), *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    # read three times: for the sources' sizes, the blocks' and the places in them
    x = cut(sized, "sizes")
    totals = x.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = plan(totals, weights, share, most)
    n_blocks = min(65536, blocks(x.count(), rows_per_block))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    x = x.withColumn("key", key).withColumn("size_class", F.floor(F.sqrt("size")).cast("int"))
    x = x.withColumn("hash", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")))
    # a block is a range of hashes: the order doesn't depend on the number of blocks
    head = F.conv(F.substring("hash", 1, 4), 16, 10).cast("long")
    unnamed = -1 - F.pmod(F.xxhash64("place"), F.lit(n_blocks))
    x = x.withColumn("block", F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.floor(head * n_blocks / 65536)).cast("int"))

    counts = x.groupBy("key", "size_class", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    classes = counts.groupBy("key", "size_class").agg(F.sum("n").alias("m"))
    classes = classes.withColumn("first", F.coalesce(F.sum("m").over(earlier("key", "size_class")), F.lit(0)))
    shares = shares.select(key.alias("key"), "source_size", "target", offset(F.col("source"), seed).alias("offset"))
    counts = counts.withColumn("inner", F.coalesce(F.sum("n").over(earlier("key", "size_class", "block")), F.lit(0)))
    # a row for each source, class and block: what a row has to know of its source comes along
    counts = counts.join(classes.join(shares, "key"), ["key", "size_class"]).withColumn("before", F.col("first") + F.col("inner"))
    counts = counts.select("key", "size_class", "block", "before", "source_size", "target", "offset")

    within = W.partitionBy("key", "size_class", "block").orderBy("hash", "doc_id")
    placed = x.withColumn("at", F.row_number().over(within) - 1).join(counts, ["key", "size_class", "block"])
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    place = (F.col("before") + F.col("at")).cast("double")
    crossed = F.floor((place + 1) * expected + F.col("offset")) - F.floor(place * expected + F.col("offset"))
    placed = placed.withColumn("copies", F.greatest(F.lit(0), F.least(crossed, F.ceil(expected))).cast("int"))
    own = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    return placed.select(
        "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), *[F.col(f"carry_{c}").alias(f"carry_{c}" if c in own else c) for c in carry],
    )
