"""Near-duplicate components: b-bit MinHash, bands, and links confirmed on full sets.

1. Signatures: one pass hashes words and 2-word shingles to 64 bits, and keeps
   for each document the size of its set, a digest of the set, HASHES minima as
   their low BITS bits, packed, and one key for each band of ROWS minima. At a
   similarity of 0.75, a pair shares no band with probability (1 - 0.75^4)^32 = 5e-6.
2. Documents with equal sets are one node, whatever their number.
   Sets of documents with the same id are linked, as such documents are one.
3. Bands, first: every node is paired with the least node of each of its band
   buckets only (a star, not all pairs). Pairs whose collision-corrected
   estimate from bit counts is below MARGIN, five standard errors under the
   threshold, go; the rest is compared on full sets. Links give components.
   Buckets that still hold nodes of different components go on without those
   that are in the component of their least node, STARS times in all.
4. Bands, second: where a bucket still holds nodes of different components,
   estimates of its pairs across components are computed in blocks of sketches;
   only those that pass are sent on, to be compared on full sets. A bucket of
   more than BLOCK nodes, such as a passage that many documents share makes, is
   cut by prefixes of the full sets first: with the shingles of a set of n in one
   order for all, rare ones first, two sets at 75 % have one in common among their
   first n - ceil(0.75 n) + 1. So no such pair is lost, whatever BLOCK is, and
   what many documents share comes last. What such a cut leaves beyond BLOCK goes on whole.
5. Components by large-star and small-star rounds.

Groups are reduced by aggregates with partial sums; what is still beyond BLOCK
nodes is split into pairs of blocks. Pairs are compared in a sorted stream in which
the set of a star's centre comes once for every PARTNERS of its partners, which
may be in different tasks. Full sets are made again from the texts of the
documents in question, found by their ids where these are few, by a bitmap of
bounded size, or beyond that by a join; a false positive of the bitmap costs time, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palimspark.llm.common import cut, cut_at, delete, integer_id, small_batches, tidy

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
PERCENT = 75
MARGIN = 0.55
BLOCK = 2048
STARS = 2
PARTNERS = 256
#: Bits of the bitmap for each id, and of the whole at most.
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Ids that are broadcast themselves.
FEW_IDS = 1_000_000
CHUNK_BYTES = 1 << 20
#: Counts by which shingles are rare or not: one for each value of so many bits of the hash.
RARE_BITS = 18

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)
_MIX = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            t = np.ones(1, np.uint64)
            step = base
            while len(t) < size:
                t = np.concatenate([t, t * np.uint64(step)])
                step = step * step % (1 << 64)
            _powers[k] = t[:size]
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each document; data: UTF-8 bytes, document i at offsets[i]:offsets[i + 1]."""
    n = len(offsets) - 1
    if not len(data):
        return [np.empty(0, np.uint64)] * n
    power, inverse = _power_tables(len(data) + 1)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a document's start parts words too
    edge[offsets] = True
    first = word & np.concatenate([[True], ~word[:-1] | edge[1:-1]])
    last = word & np.concatenate([~word[1:] | edge[1:-1], [True]])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    h = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)
    pairs = _mixed(h[:-1] * np.uint64(0x9DDFEA08EB382D69) + h[1:]) if len(h) > 1 else np.empty(0, np.uint64)
    out = []
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a > 1:
            x = np.sort(pairs[a : b - 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(_mixed(h[a:b] ^ np.uint64(0x5851F42D4C957F2D)))
    return out


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits (n, words), band keys (n, BANDS)) of sets that aren't empty."""
    n = len(sets)
    x = np.concatenate(sets)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    minima = np.empty((HASHES, n), np.uint64)
    for j in range(HASHES):
        minima[j] = np.minimum.reduceat(x * _A[j] + _B[j], offsets) >> np.uint64(32)
    low = (minima & np.uint64((1 << BITS) - 1)).T
    per = 64 // BITS
    packed = np.zeros((n, HASHES // per), np.uint64)
    for j in range(per):
        packed |= low[:, j::per] << np.uint64(j * BITS)
    rows = minima.T.reshape(n, BANDS, ROWS)
    keys = _mixed((rows * _MIX[None]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0xD6E8FEB86659FD93))
    return packed, keys


def _digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of about CHUNK_BYTES of text at a time; columns: id, text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(1).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        buffer = text.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
        start = 0
        while start < len(text):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, side="right")) - 1)
            stop = min(stop, len(text))
            yield batch.column(0).slice(start, stop - start), data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
            start = stop
    tidy()


def signatures(x: DataFrame) -> DataFrame:
    """x: doc_id, text. Adds to doc_id: n, digest, sig, bands (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _chunks(batches):
            sets = shingle_sets(data, offsets)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            if full:
                packed, keys = sketch([sets[i] for i in full])
                for i, p, k in zip(full, packed.view(np.int64), keys.view(np.int64)):
                    sig[i], bands[i] = p, k
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "sig", "bands"],
            )

    return x.mapInArrow(run, "doc_id long, n long, digest binary, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures, corrected for chance collisions of BITS bits."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    ones = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)

    def unequal(p: Column, q: Column) -> Column:
        x = p.bitwiseXOR(q)
        y = x
        for k in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(y.bitwiseAND(ones))

    miss = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda t, v: t + v)
    chance = 1 / (1 << BITS)
    return ((1 - miss / HASHES) - chance) / (1 - chance)


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bits of the hashed ids; at most bits / 64 rows come to the driver."""
    h = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(h.alias("h")).selectExpr("shiftright(h, 6) AS w", "shiftleft(1L, cast(pmod(h, 64) AS int)) AS b").groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def _sets_of(x: DataFrame, ids: DataFrame) -> DataFrame:
    """node, hashes of the documents whose id is (almost only) among ids."""
    n = ids.count()
    bits = 1 << max(LEAST_BITS.bit_length() - 1, (n * BITS_PER_ID).bit_length())
    x, table = x.where("doc_id is not null"), None
    if n <= FEW_IDS or bits > MOST_BITS:
        few = ids.withColumnRenamed("id", "doc_id")
        x = x.join(F.broadcast(few) if n <= FEW_IDS else few, "doc_id", "left_semi")
    else:
        table = x.sparkSession.sparkContext.broadcast(_bitmap(ids, bits).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if table is None else np.frombuffer(table.value, np.int64)

        def needed():
            for b in batches:
                if words is None:
                    yield b.select([0, 1])
                else:
                    h = b.column(2).to_numpy()
                    yield b.select([0, 1]).filter(pa.array((words[h >> 6] >> (h & 63)) & 1 == 1))

        for got, data, offsets in _chunks(needed()):
            sets = shingle_sets(data, offsets)
            yield pa.RecordBatch.from_arrays([got, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    keyed = x.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("h"))
    return keyed.mapInArrow(run, "node long, hashes binary")


def _common(s: np.ndarray, t: np.ndarray) -> int:
    """Of two sorted sets without repeats."""
    if len(s) > len(t):
        s, t = t, s
    if not len(s):
        return 0
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    return int((t[at] == s).sum())


def confirm(x: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes with percent * union <= 100 * intersection on full sets; b should be the one that repeats."""
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = cut(_sets_of(x, ids), "sets")
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("tasks"))
    spread = pairs.join(many.hint("merge"), "b").withColumn("task", F.pmod(F.xxhash64("a"), F.col("tasks").cast("long")).cast("int"))
    partners = spread.select(F.col("a").alias("node"), "b", "task", F.lit(True).alias("asks"), "a")
    task = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")
    centres = many.select(F.col("b").alias("node"), "b", task, F.lit(False).alias("asks"), F.lit(0).cast("long").alias("a"))
    # the sets meet all that want them in one join
    stream = partners.union(centres).join(sets.hint("merge"), "node").select("b", "task", "asks", "a", "hashes")
    stream = stream.repartition("b", "task").sortWithinPartitions("b", "task", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            b, task, asks, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out_a, out_b = [], []
            for i, hashes in enumerate(batch.column(4)):
                s = np.frombuffer(hashes.as_buffer(), np.uint64)
                if not asks[i]:
                    # an id that has several texts has several sets
                    own = own if (b[i], task[i]) == now else []
                    now = (b[i], task[i])
                    own.append(s.copy())
                elif now == (b[i], task[i]):
                    for t in own:
                        n = _common(s, t)
                        if n and 100 * n >= percent * (len(s) + len(t) - n):
                            out_a.append(int(a[i]))
                            out_b.append(int(b[i]))
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return stream.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of an edge (a, b) can reach."""
    e, path = cut_at(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # joins of tables that grow with the input are told to sort: small ones would each be broadcast by the driver, in its memory
        # large star: each node's greater neighbours are tied to its least
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        new = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(e).where("a != b").distinct()
        # small star: each node and its smaller neighbours are tied to the least of these
        least = new.groupBy("a").agg(F.min("b").alias("m"))
        joined = new.join(least.hint("merge"), "a")
        new = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        old = path
        seen = Observation()
        e, path = cut_at(new.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")), "edges")
        delete(old)
        now = seen.get
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = now


def _rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles of the sets occur, by the first RARE_BITS bits of their hash; as many rows come to the driver at most."""
    shift = np.uint64(64 - RARE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARE_BITS, np.int64)
        for batch in batches:
            found = [np.frombuffer(h.as_buffer(), np.uint64) for h in batch.column(1)]
            if found:
                total += np.bincount((np.concatenate(found) >> shift).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "m"])

    with small_batches(sets.sparkSession):
        got = sets.mapInArrow(run, "bin long, m long").groupBy("bin").agg(F.sum("m").alias("m")).toArrow()
    out = np.zeros(1 << RARE_BITS, np.int64)
    out[got.column("bin").to_numpy()] = got.column("m").to_numpy()
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, shingle: the rarest shingles of each set of n, n - ceil(percent % of n) + 1 of them; two sets at percent % or more have one in common."""
    table = sets.sparkSession.sparkContext.broadcast(_rarity(sets).tobytes())
    shift = np.uint64(64 - RARE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.frombuffer(table.value, np.int64)
        for batch in batches:
            nodes, kept = [], []
            for node, hashes in zip(batch.column(0).to_numpy(), batch.column(1)):
                s = np.frombuffer(hashes.as_buffer(), np.uint64)
                order = np.lexsort((s, rare[s >> shift]))[: len(s) - -(-percent * len(s) // 100) + 1]
                nodes.append(np.full(len(order), node, np.int64))
                kept.append(s[order].view(np.int64))
            for i in range(0, len(nodes), 64):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes[i : i + 64])), pa.array(np.concatenate(kept[i : i + 64]))], ["node", "shingle"])
        tidy()

    return sets.mapInArrow(run, "node long, shingle long")


def _narrowed(rows: DataFrame, x: DataFrame, percent: int) -> DataFrame:
    """rows (key, node, comp) with buckets of more than BLOCK nodes cut by shingles of the nodes' prefixes; all pairs at percent % or more are still in one."""
    large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("key"), "large")
    if large.isEmpty():
        return rows
    hot = cut(rows.join(large, "key"), "hot")
    sets = cut(_sets_of(x, hot.select(F.col("node").alias("id")).distinct()), "sets")
    cuts = hot.join(cut(_prefixes(sets, percent), "prefixes"), "node").select(F.xxhash64("key", "shingle").alias("key"), "node", "comp")
    mixed = cuts.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return rows.join(large, "key", "left_anti").union(cuts.join(mixed, "key").select("key", "node", "comp"))


def _across(rows: DataFrame, parts: int, percent: int) -> DataFrame:
    """Pairs (a, b) across components in the same bucket whose estimate is MARGIN or more; rows: key, node, comp, n, sig."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    split = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("c").cast("long")).cast("int")
    x = rows.join(sizes.hint("merge"), "key").withColumn("c", split).withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    x = x.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "sig")
    x = x.repartition(parts, "task").sortWithinPartitions("task", "key", "i", "j", "n")
    ones = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    most = HASHES * (1 - (MARGIN * (1 - 1 / (1 << BITS)) + 1 / (1 << BITS)))

    def pairs(own, node, comp, n, sig, i, j):
        """Of one block, or of a pair of different blocks only across them."""
        a, b = [], []
        for r in range(len(node) - 1):
            stop = int(np.searchsorted(n, n[r] * 100 // percent, side="right"))  # sorted by n; sizes bound the similarity
            if stop <= r + 1:
                continue
            other = slice(r + 1, stop)
            good = comp[other] != comp[r]
            if i != j:
                good &= own[other] != own[r]
            if not good.any():
                continue
            pick = np.flatnonzero(good) + r + 1
            d = sig[pick] ^ sig[r]
            y = d.copy()
            for k in range(1, BITS):
                y |= d >> np.uint64(k)
            pick = pick[np.bitwise_count(y & ones).sum(axis=1) <= most]
            a += [max(int(node[r]), int(node[p])) for p in pick]
            b += [min(int(node[r]), int(node[p])) for p in pick]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_end(batches):
            table = batch if rest is None else rest if batch is None else pa.concat_batches([rest, batch])
            if table is None or not table.num_rows:
                continue
            task, key, i, j = (table.column(k).to_numpy() for k in range(4))
            breaks = np.flatnonzero((np.diff(task) != 0) | (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            cuts = [0, *breaks.tolist(), table.num_rows]
            rest = None
            if batch is not None:
                rest = table.slice(cuts[-2])
                cuts.pop()
            own, node, comp, n = (table.column(k).to_numpy() for k in (4, 5, 6, 7))
            sig = table.column(8).flatten().to_numpy().view(np.uint64).reshape(table.num_rows, -1)
            a, b = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                s = slice(lo, hi)
                p, q = pairs(own[s], node[s], comp[s], n[s], sig[s], int(i[lo]), int(j[lo]))
                a += p
                b += q
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return x.mapInArrow(run, "a long, b long").distinct()


def _and_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Ids must be integers (TypeError). Empty and null texts have no shingles, link
    with nothing, and are their own component. Rows with a null id take no part:
    component_id and kept are null. Rows with the same id are the same document,
    even with different texts: what links with one of them is in the component of
    all, but for its empty texts. Repeated rows are given back as often; of rows that tie for kept by the
    same id, all are kept. Texts are compared whole, however long. An empty table
    gives an empty one; other columns, whatever their names, aren't looked at.
    """
    spark = docs.sparkSession
    x = docs.select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    s = cut(signatures(x), "signatures")
    usable = s.where("n > 0 and doc_id is not null")
    # rows of a digest have the same set, so the same signature
    nodes = usable.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "sig", "bands")])
    nodes = cut(nodes, "nodes")
    groups = nodes.select("digest", "node")
    several = cut(usable.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id"), "several")
    same = several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    if not several.isEmpty():
        same = usable.join(several, "doc_id").select("doc_id", "digest").distinct().join(groups, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    e = nodes.select(F.explode("bands").alias("key"), "node")
    shared = e.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("top")).where("rep < top").select("key", "rep")
    members = cut(e.join(shared.hint("merge"), "key"), "members")
    lean = nodes.select("node", "n", "sig")
    edges, comps = same, None
    for star in range(STARS):
        if star:
            # each mixed bucket without its least node's component, under the least node of the rest
            own = members.join(comps.hint("merge"), "node", "left").select("key", "node", "rep", F.coalesce("comp", "node").alias("comp"))
            head = own.where("node = rep").select("key", F.col("comp").alias("done"))
            rest = own.join(head.hint("merge"), "key").where("comp != done").select("key", "node", "comp")
            least = rest.groupBy("key").agg(F.min("node").alias("rep"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "rep")
            stars = rest.join(least.hint("merge"), "key")
            reps = comps.toDF("rep", "other")
            stars = stars.join(reps.hint("merge"), "rep", "left").where("comp != coalesce(other, rep)")
        else:
            stars = members
        stars = stars.where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
        close = stars.join(lean.toDF("a", "na", "sa").hint("merge"), "a").join(lean.toDF("b", "nb", "sb").hint("merge"), "b")
        close = close.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate(F.col("sa"), F.col("sb")) >= MARGIN))
        pairs = cut(close.select("a", "b").distinct(), "pairs")
        if star and pairs.isEmpty():
            break
        edges = edges.union(confirm(x, pairs, percent))
        comps = components(edges)
        edges = comps.toDF("a", "b")

    comp = members.join(comps.hint("merge"), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rows = _narrowed(cut(comp.join(mixed.hint("merge"), "key"), "mixed"), x, percent)
    rows = rows.join(lean.hint("merge"), "node").select("key", "node", "comp", "n", "sig")
    more = cut(_across(rows, int(spark.conf.get("spark.sql.shuffle.partitions")), percent), "pairs")
    if not more.isEmpty():
        comps = components(edges.union(confirm(x, more, percent)))
    ids = s.select("doc_id", "n", "digest")
    named = groups.join(comps.hint("merge"), "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"))
    # empty sets have no digest; they don't go through the join, where nulls would all meet in one task
    linked = ids.where("digest is not null").join(named.hint("merge"), "digest", "left").select("doc_id", "n", "comp")
    out = linked.union(ids.where("digest is null").select("doc_id", "n", F.lit(None).cast("long").alias("comp")))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
