"""Quality: hashed word n-gram logistic regression by follow-the-regularised-leader updates.

A text is cut into words and runs of marks. Features are hashed unigrams and
bigrams of these; a word that repeats its predecessor gives the bigram "same",
whatever the word, and words in capitals give "CAPS" besides. A text's vector has
the counts divided by the number of tokens, so that length doesn't matter; its
score is the sparse dot product with the weights, through the logistic function.

FTRL-proximal with per-coordinate rates runs over a bounded sample of the
labelled rows: at most MAX_ROWS of them by hash of the id, in the order of the
hash, PASSES times. Labels of held-out rows never reach it. Scoring covers all rows and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimspark.llm.common import MEMO_ENTRIES, held_out, memos, pieces, small_batches

TOKEN = re.compile(r"\w+|[^\w\s]+")
DIM = 1 << 18
MAX_ROWS = 6_000
PASSES = 4
SCALE = 8.0
_SAME, _CAPS, _BIAS = 1, 2, 0
_FIRST = 16  # below are features of their own


class _Hashes(dict):
    """token -> 31-bit hash, the lowest bit set for words of capitals."""

    def __missing__(self, token: str) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        caps = len(token) > 1 and token.isupper()
        value = (zlib.crc32(token.encode("utf-8", "replace")) & 0x7FFFFFFE) | caps
        if len(token) <= 64:
            self[token] = value
        return value


_hashes = _Hashes()
memos.append(_hashes)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each token and bigram, its text's position), tokens of all texts in a row; a text without tokens has none."""
    get = _hashes.__getitem__
    parts, counts = [], []
    for t in texts:
        ids = np.fromiter(map(get, TOKEN.findall(t)), np.int64)
        parts.append(ids)
        counts.append(len(ids))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    mix = lambda x: (((x * 0x9E3779B1) & 0xFFFFFFFF) >> 11) % (DIM - _FIRST) + _FIRST
    uni = mix(ids >> 1)
    caps = np.flatnonzero(ids & 1)
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.empty(0, np.int64)
    a, b = ids[pair], ids[pair + 1]
    bi = np.where(a == b, _SAME, mix((a * 31 + b) & 0xFFFFFFFF))
    return np.concatenate([uni, np.full(len(caps), _CAPS), bi]), np.concatenate([doc, doc[caps], doc[pair]])


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, texts: list[str]) -> np.ndarray:
        f, doc = features(texts)
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        z = np.bincount(doc, self.weights[f], len(texts)) * SCALE / n + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, passes: int = PASSES) -> Scorer:
    """rows: (features, values, label). Weights are made from the leader's sums when needed."""
    z, n, w = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)

    def leader(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(passes):
        for f, v, y in rows:
            w[f] = own = leader(f)
            p = 1 / (1 + np.exp(-np.clip(own @ v, -35, 35)))
            g = (p - y) * v
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * own
            n[f] += g * g
    w = leader(np.arange(DIM))
    bias, w[_BIAS] = float(w[_BIAS]), 0.0
    return Scorer(w, bias)


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """h, id, text, y of at most max_rows labelled rows of docs, by hash of id, none of them held out.

    Ids are compared as text. Labels of ids that docs doesn't have don't count;
    of labels that differ for one id the greatest does, and of an id's texts the least.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id", modulus, remainder))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    x = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = known.join(x.select("id"), "id", "left_semi").withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(max_rows)
    # max_rows rows of a few bytes
    return x.join(F.broadcast(known), "id").groupBy("h", "id", "y").agg(F.min("text").alias("text")).select("h", "id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learns from labels of rows of docs that aren't held out (see labelled()). Without labels every score is 0.5."""
    some = labelled(docs, labels, label, modulus, remainder, max_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            f, doc = features(texts)
            cuts = np.searchsorted(np.sort(doc), np.arange(len(texts) + 1))
            f = f[np.argsort(doc, kind="stable")]
            out_f, out_v = [], []
            for i in range(len(texts)):
                own, counts = np.unique(f[cuts[i] : cuts[i + 1]], return_counts=True)
                out_f.append(own.astype(np.int32).tobytes())
                out_v.append((counts * (SCALE / max(counts.sum(), 1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_f, pa.binary()), pa.array(out_v, pa.binary()), batch.column(3)], ["h", "id", "f", "v", "y"])

    # at most max_rows sparse vectors come to the driver
    with small_batches(docs.sparkSession):
        rows = some.mapInArrow(run, "h long, id string, f binary, v binary, y int").toLocalIterator(prefetchPartitions=False)
        got = sorted(((r.h, r.id, bytes(r.f), bytes(r.v), r.y) for r in rows))
    return ftrl([(np.concatenate([[_BIAS], np.frombuffer(f, np.int32)]), np.concatenate([[1.0], np.frombuffer(v, np.float32)]), y) for _, _, f, v, y in got])


def score(docs: DataFrame, scorer: Scorer, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; ids may be of any type.

    Null and empty texts get the score of the bias alone. Texts are scored whole,
    however long: a token of any length is hashed whole, and a text has no more
    features than tokens. A null id isn't held out. Repeated rows give repeated
    rows (rows of equal texts equal scores), an empty table an empty one; other
    columns, whatever their names, aren't looked at.
    """
    x = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, modulus, remainder).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            p = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
