"""Exact top-k by inner product on an impact-ordered index, score at a time.

Components become floor(1024 * x). In each block of rows, a dimension's values
are quantised to LEVELS equal steps, and a level is written as two digits. A
posting segment is the rows of a dimension that have the same digit; its impact
for a query is the query's component times the step times the digit, times BASE
for the first digit: an integer. Segments are processed by descending impact in
two rounds, the first digits of all dimensions, then the last ones; as every row
has a value in every dimension, a round's segments are kept as one matrix of
digits and added for a batch of queries at once.

After a round, what a row can still gain is bounded, by what is left of the
steps. The scores of the rows that lead so far, made exactly, give a bar that the
k best reach. Rows whose bound is under the bar can't be members: that is the proof, and
they get no further round. Those that are left after the last are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from palimspark.llm import vectors

SCALE = 1024
BASE = 16
LEVELS = BASE * BASE
#: Queries whose first round is done at once.
BATCH = 64
#: Groups of rows whose leaders give the first bar, for each member asked for.
GROUPS = 8
K = 10


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE)


class Index:
    """ids, rows: of one block; rows are integers, held as doubles, that are exact up to 2^53."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.low = rows.min(axis=0)
        #: a level's width: an integer, so that the remainder is at most step - 1
        self.step = np.maximum(1, np.ceil((rows.max(axis=0) - self.low + 1) / LEVELS))
        level = np.floor((rows - self.low) / self.step)
        self.first = np.floor(level / BASE).astype(np.float32)
        self.last = (level - BASE * np.floor(level / BASE)).astype(np.float32)

    def search(self, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        queries = integers(queries)
        for at in range(0, len(ids), BATCH):
            some = queries[at : at + BATCH]
            sums = (some * (self.step * BASE)).astype(np.float32) @ self.first.T
            for i, q in enumerate(some):
                yield self._members(ids[at + i], q, sums[i])

    def _exact(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.rows[at] @ q

    def _members(self, own: int, q: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(self.ids), self.k
        # of adding rounded numbers: more than what doubles and floats of a sum of d terms can be off
        slack = 4 * (len(q) + 2) * 2.0**-23 * float(np.abs(q * self.step * LEVELS).sum()) + 1
        base = float(q @ self.low)
        after_first = float((np.maximum(q, 0) * (self.step * BASE - 1)).sum()) + slack
        after_last = float((np.maximum(q, 0) * (self.step - 1)).sum()) + slack
        mine = np.flatnonzero(self.ids == own)
        first[mine] = -np.inf
        possible = np.arange(n)
        if n > 4 * k * GROUPS:
            # the leaders of groups of rows: k of them, scored exactly, set the bar
            groups = k * GROUPS
            width = n // groups
            lead = first[: groups * width].reshape(groups, width).argmax(axis=1) + np.arange(groups) * width
            bar = self._bar(lead[np.argpartition(-first[lead], 2 * k - 1)[: 2 * k]], q, mine)
            possible = np.flatnonzero(first >= bar - base - after_first)
        possible = possible[np.isfinite(first[possible])]
        if len(possible) > 4 * k:
            sums = first[possible] + self.last[possible] @ (q * self.step).astype(np.float32)
            bar = self._bar(possible[np.argpartition(-sums, k - 1)[:k]], q, mine)
            possible = possible[sums >= bar - base - after_last]
        score = self._exact(possible, q)
        best = np.lexsort((self.ids[possible], -score))[:k]
        return self.ids[possible[best]], score[best].astype(np.int64)

    def _bar(self, at: np.ndarray, q: np.ndarray, mine: np.ndarray) -> float:
        """A score that k rows, the query's own not among them, reach."""
        at = np.setdiff1d(at, mine) if len(mine) else at
        return float(np.sort(self._exact(at, q))[-self.k]) if len(at) >= self.k else -np.inf


def top_k(
    embeddings: DataFrame, k: int = K, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_block: int = vectors.ROWS_PER_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each row whose id is divisible by every.

    Vectors that are null or hold null or non-finite components take no part;
    zero vectors do. A query's candidates are the vectors of its length, whatever
    length most have. Scores and their parts must fit in 53 bits. Rows with the
    query's id aren't its candidates; an id that repeats asks once (with its
    least vector) and is a candidate as often as it is there. Ties go to the
    smaller id. An empty table gives an empty one; other columns, whatever their names, aren't looked at. Ids must
    be integers (TypeError). Vectors may have any length.
    """
    x = vectors.usable(embeddings, id_col, vector_col, zero=True)
    return vectors.top(x, vectors.lengths(x), lambda ids, rows: Index(ids, integers(rows), k), every, k, "long", False, rows_per_block)
