"""Approximate nearest neighbours by multi-index hashing.

A rotation learned by iterative quantisation on at most SAMPLE rows (by hash)
turns vectors into binary codes. A code is cut into substrings of SUBSTRING
bits, each with an index. If two codes differ in at most r of their bits, then
they differ in at most r // m in one of the m substrings, and for the last
m - 1 - r % m of them less; probing every index with all values that near
therefore finds every code within r. (Where the values to probe outnumber the
codes, the codes are compared one by one, which finds the same.) What is found
is reranked by Euclidean distance of the floats, in double precision.

The radius is the query's own. It grows until it reaches what the k-th distance
found so far asks for: given that distance, the angle between the query and a
row of any common norm is known, and with it, and the query's coordinates before
their signs were taken, each bit's chance to differ. The radius asked for is the
mean number of such bits plus DEVIATIONS standard deviations, for the norm with
the most. A query far from the rest, or in a dense spot, so has a radius of its
own. All rows are indexed.

Vectors of different lengths are never compared. The CODED most frequent lengths
have codes; vectors of the others are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimspark.llm import vectors

SAMPLE = 4_096
ITERATIONS = 30
DEVIATIONS = 1.0
NORMS = 16
STEP = 4
SUBSTRING = 16
CODED = 16
K = 10
#: Candidates that are reranked, at least, for each neighbour asked for.
LEAST = 4


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by its logistic approximation (within 0.0002)."""
    x = np.clip(x, -8, 8)
    return 1 / (1 + np.exp(-(1.5976 * x + 0.070566 * x**3)))


class Coder:
    def __init__(self, sample: np.ndarray):
        """sample: rows in a fixed order."""
        x = sample.astype(np.float64)
        #: as a power of two, so that it changes no digit; sums of squares of great and of tiny vectors stay finite
        self.scale = 2.0 ** -np.frexp(np.abs(x).max(initial=0) or 1.0)[1]
        x = x * self.scale
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        x = x - self.mean
        bits = min(64, x.shape[1])
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :bits]
        v = x @ axes
        rotation = np.linalg.qr(np.random.default_rng(5).standard_normal((bits, bits)))[0]
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        self.turn, self.bits = axes @ rotation, bits
        norms = np.sqrt(((x @ self.turn) ** 2).sum(axis=1))
        self.norms = np.quantile(norms, np.linspace(0, 1, NORMS)) if len(norms) else np.zeros(NORMS)

    def project(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num((x * self.scale - self.mean) @ self.turn)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self.pack(self.project(x))

    def pack(self, z: np.ndarray) -> np.ndarray:
        out = np.zeros(len(z), np.uint64)
        for j in range(self.bits):
            out |= (z[:, j] >= 0).astype(np.uint64) << np.uint64(j)
        return out

    def radius(self, z: np.ndarray, distance: float) -> int:
        """Of a query with coordinates z, for rows within distance."""
        own = float(np.sqrt((z**2).sum()))
        d, m = distance * self.scale, np.append(self.norms, own)
        m = m[(m > 0) & (np.abs(m - own) <= d)]
        if not len(m) or own == 0 or not np.isfinite(d):
            return self.bits
        cos = np.clip((own**2 + m**2 - d**2) / (2 * own * m), -1, 1)
        sin = np.sqrt(np.maximum(1 - cos**2, 1e-12))
        p = _phi(-(cos / sin)[:, None] * np.abs(z)[None] * (np.sqrt(self.bits) / own))
        p = np.clip(p, 0, 1)
        return int(min(self.bits, np.ceil((p.sum(axis=1) + DEVIATIONS * np.sqrt((p * (1 - p)).sum(axis=1))).max())))


def _masks(bits: int, most: int) -> np.ndarray:
    every = np.arange(1 << bits, dtype=np.int64)
    return every[np.bitwise_count(every) <= most]


class Index:
    """Substring indexes over the codes of one block."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.widths = [min(SUBSTRING, bits - at) for at in range(0, bits, SUBSTRING)]
        self.tables = []
        for j, width in enumerate(self.widths):
            part = self._part(codes, j)
            order = np.argsort(part, kind="stable")
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << width) + 1))))
        self._near: dict[tuple[int, int], np.ndarray] = {}

    def _part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return ((codes >> np.uint64(SUBSTRING * j)) & np.uint64((1 << self.widths[j]) - 1)).astype(np.int64)

    def probes(self, radius: int) -> list[np.ndarray]:
        """For each index, the differences to probe it with."""
        share, rest = divmod(min(radius, self.bits), len(self.widths))
        out = []
        for j, width in enumerate(self.widths):
            most = share if j <= rest else share - 1
            key = (width, min(most, width))
            if key not in self._near:
                self._near[key] = _masks(*key) if most >= 0 else np.empty(0, np.int64)
            out.append(self._near[key])
        return out

    def within(self, code: np.uint64, radius: int, least: int = -1) -> np.ndarray:
        """Positions of all codes that differ in at most radius and more than least bits, ascending."""
        probes = self.probes(radius)
        if sum(map(len, probes)) * 4 > len(self.codes):
            far = np.bitwise_count(self.codes ^ code)
            return np.flatnonzero((far <= radius) & (far > least) if least >= 0 else far <= radius)
        seen = np.zeros(len(self.codes), bool)
        for j, ((order, starts), near) in enumerate(zip(self.tables, probes)):
            values = near ^ int(self._part(np.array([code]), j)[0])
            a, n = starts[values], starts[values + 1] - starts[values]
            a, n = a[n > 0], n[n > 0]
            if len(n):
                run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                seen[order[np.repeat(a, n) + run]] = True
        at = np.flatnonzero(seen)
        far = np.bitwise_count(self.codes[at] ^ code)
        return at[(far <= radius) & (far.astype(np.int64) > least)]


def distances(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision; beyond a double's square, by the greatest difference."""
    with np.errstate(over="ignore", invalid="ignore"):
        delta = rows - v
        d = np.sqrt((delta**2).sum(axis=1))
        if len(d) and not (np.isfinite(d).all() and d.min() > 1e-140):
            most = np.abs(delta).max(axis=1, keepdims=True)
            scaled = np.divide(delta, most, out=np.zeros_like(delta), where=(most > 0) & np.isfinite(most))
            d = np.where(np.isfinite(most[:, 0]), most[:, 0] * np.sqrt((scaled**2).sum(axis=1)), np.inf)
    return d


class BlockIndex:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, coder: Coder | None, k: int):
        self.ids, self.rows, self.coder, self.k = ids, rows, coder, k
        if coder is not None:
            self.index = Index(coder.codes(rows), coder.bits)

    def search(self, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.coder is None:
            for q, v in zip(ids, queries):
                at = np.flatnonzero(self.ids != q)
                yield self._best(at, distances(self.rows[at], v))
            return
        z = self.coder.project(queries)
        for q, v, own, code in zip(ids, queries, z, self.coder.pack(z)):
            yield self._best(*self._found(q, v, own, code))

    def _best(self, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > 4 * self.k:
            some = d <= np.partition(d, self.k - 1)[self.k - 1]
            at, d = at[some], d[some]
        best = np.lexsort((self.ids[at], d))[: self.k]
        return self.ids[at][best], d[best]

    def _found(self, q: int, v: np.ndarray, z: np.ndarray, code: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the rows within the query's radius."""
        k, bits = self.k, self.coder.bits
        at, d = np.empty(0, np.int64), np.empty(0)
        least, radius = -1, 2 * STEP
        while True:
            new = self.index.within(code, radius, least)
            new = new[self.ids[new] != q]
            at, d = np.concatenate([at, new]), np.concatenate([d, distances(self.rows[new], v)])
            if len(d) > 4 * k:  # enough for the k best
                some = d <= np.partition(d, k - 1)[k - 1]
                seen, at, d = len(d), at[some], d[some]
            else:
                seen = len(d)
            if radius >= bits:
                return at, d
            enough = seen >= LEAST * k and len(d) >= k
            asked = self.coder.radius(z, np.partition(d, k - 1)[k - 1]) if enough else bits
            if radius >= asked:
                return at, d
            least, radius = radius, min(asked, radius + STEP)


def sample_of(x: DataFrame, n: int, size: int) -> np.ndarray:
    """At most size distinct vectors of x (id, v; n rows) by hash, in its order."""
    share = min(1.0, 4 * size / max(n, 1))
    h = F.xxhash64("id", "v")
    while True:
        part = x if share >= 1 else x.where(h < F.lit(int(-(2**63) + share * 2**64)))
        rows = part.groupBy(h.alias("h")).agg(F.min("v").alias("v")).orderBy("h").limit(size).toArrow()
        if rows.num_rows >= size or share >= 1:
            return vectors.matrix(rows.column("v")) if rows.num_rows else np.empty((0, 0))
        share = min(1.0, share * 8)


def nearest(
    embeddings: DataFrame, k: int = K, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE,
    rows_per_block: int = vectors.ROWS_PER_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score (distance): k nearest found of each row whose id is divisible by every.

    Vectors that are null, zero, or hold null or non-finite components take no
    part. A query's candidates are the vectors of its length, whatever length
    most have. Rows with the query's id aren't its candidates; an id that
    repeats asks once (with its least vector) and is a candidate as often as it
    is there. Ties go to the smaller id. An empty table gives an empty one; other columns,
    whatever their names, aren't looked at. Ids must be integers (TypeError). Vectors may have any length:
    one of many components has codes of its 64 main directions, and is reranked in full.
    """
    x = vectors.usable(embeddings, id_col, vector_col, zero=False)
    counts = vectors.lengths(x)
    often = sorted(counts, key=lambda d: (-counts[d], d))[:CODED]
    coders = {d: Coder(sample_of(x.where(F.col("d") == d), counts[d], sample)) for d in often}

    def build(ids: np.ndarray, rows: np.ndarray) -> BlockIndex:
        return BlockIndex(ids, rows, coders.get(rows.shape[1]), k)

    return vectors.top(x, counts, build, every, k, "double", True, rows_per_block)
