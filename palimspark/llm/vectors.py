"""A stated query set against all vectors, in blocks; shared by both vector searches.

Rows go to blocks of about ROWS_PER_BLOCK of one length, by a hash of their place
in the scan, so that no value, however frequent, makes a block large. A row is
shuffled once. A task reads its blocks as a sorted stream: a block's rows, from
which its index is built once, then the queries, a batch at a time, so that it
holds one block and one batch whatever their number. It returns the best k of
the block for each query; of these, k times the number of blocks, the best k
are the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimspark.llm.common import blocks, integer_id, tidy

ROWS_PER_BLOCK = 16_384


class Index(Protocol):
    def search(self, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row ids, scores) of the block's best k for each query, best first."""


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, v, d) rows whose vector is finite, as floats if it is an array of floats, else as doubles; d: its length; zero: whether zero vectors count."""
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    x = vectors.select(integer_id(vectors, id_col).alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null and v is not null and size(v) > 0")
    x = x.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    if not zero:
        x = x.where(F.exists(v, lambda c: c != 0))
    return x.withColumn("d", F.size("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length, as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def lengths(x: DataFrame) -> dict[int, int]:
    """Rows by length of vector; one entry per length that occurs comes to the driver."""
    return {r.d: r.n for r in x.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}


def top(
    x: DataFrame, counts: dict[int, int], build: Callable[[np.ndarray, np.ndarray], Index], every: int, k: int, score_type: str, ascending: bool,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """x: id, v, d. build: (row ids, rows) -> the index of a block. Candidates of a query are the rows of its length."""
    spark = x.sparkSession
    if not counts:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    table, total = [], 0
    for d in sorted(counts):
        table.append((d, blocks(counts[d], rows_per_block), total))
        total += table[-1][1]
    # a row of three numbers for each length that occurs
    x = x.join(F.broadcast(spark.createDataFrame(table, "d int, own int, first int")), "d")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("own").cast("long"))
    rows = x.withColumn("b", (F.col("first") + place).cast("int")).withColumn("asks", F.lit(False))
    asked = x.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "own", "first")).alias("q")).select("id", "q.*")
    asked = asked.withColumn("b", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("own") - 1))).withColumn("asks", F.lit(True))
    columns = ["b", "asks", "id", "v"]
    # a few blocks a partition where there are many; the number is that of the blocks, not of the rows
    parts = min(total, 20_000)
    stream = rows.select(columns).union(asked.select(columns)).repartitionById(parts, F.col("b") % parts).sortWithinPartitions("b", "asks", "id")
    kind = pa.float64() if score_type == "double" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kept, index = None, [], None
        for batch in batches:
            b, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(b) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if b[lo] != block:
                    block, kept, index = b[lo], [], None
                part = batch.slice(lo, hi - lo)
                ids, v = part.column(2).to_numpy(), matrix(part.column(3))
                if not asks[lo]:
                    kept.append((ids, v))
                    continue
                if index is None:
                    if not kept:
                        continue
                    index = build(np.concatenate([i for i, _ in kept]), np.concatenate([m for _, m in kept]))
                    kept = []
                found = [(np.full(len(near), q), near, score) for q, (near, score) in zip(ids, index.search(ids, v))]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)), pa.array(np.concatenate([f[2] for f in found]), kind)],
                    ["query_id", "vec_id", "score"],
                )
        tidy()

    near = stream.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = F.asc("score") if ascending else F.desc("score")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
