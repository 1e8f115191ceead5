"""Secrets by pattern and by a linear-chain conditional random field.

Base spans are matches of three patterns. A CRF over tokens with tags outside,
begin and inside adds spans that touch no base span. A token's emission is a sum
of weights of its own feature (hashed word, or shape where it isn't a plain
word), of the features of its two predecessors and its successor, and of the
document's feature (length and share of odd tokens). Weights are fitted by
conditional likelihood (forward-backward) on windows of tokens.

There are no gold tags: windows come from a sample of at most SAMPLE_DOCS
documents by hash of the text (all where there are fewer), tagged by the base
patterns, and from the same windows with generated secrets put in. All
documents are then decoded, whole. Viterbi is exact but runs only where needed:
a token is outside on every best path if its lead over begin and inside is more
than any two transitions can make up, and such tokens split the chain.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimspark.llm.common import MEMO_ENTRIES, memos, pieces, small_batches

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
#: A match of fewer characters has none of more inside the same run, so the bounds can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[\w+/.-]+|[^\w\s+/.-]+")
SAMPLE_DOCS = 10_000
MAX_WINDOWS = 6_000
#: Secrets of one document that give windows; where it has more, drawn at random by the hash of the text.
SECRETS = 4
SIDE = 8
LENGTH = 2 * SIDE + 1
WORDS = 1 << 14
SHAPES = 1 << 10
MARKS = 1 << 10
#: Last, the feature that all words share that fewer than RARE tokens of the sample have.
FEATURES = 1 + WORDS + SHAPES + MARKS + 1
RARE = 40
FILES = 64
O, B, I = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of pattern matches, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return [(s, KINDS[k], e) for s, k, e in found]


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the secret itself stands in each base match."""
    return sorted(
        {m.span(1) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6}
        | {m.span() for m in ACCESS.finditer(text)}
        | {m.span() for m in HEX.finditer(text)}
    )


def feature(token: str) -> int:
    """1.. of a token; 0 is padding."""
    core = token.strip("._-/+")
    if not core or not (core[0].isalnum() or core[0] == "_"):
        return 1 + WORDS + SHAPES + (zlib.crc32(token.encode("utf-8", "replace")) & (MARKS - 1))
    if core.isalpha() and (core[1:].islower() or core.isupper() or len(core) == 1):
        return 1 + (zlib.crc32(core.lower().encode("utf-8", "replace")) & (WORDS - 1))
    n = len(core)
    bucket = 0 if n < 4 else 1 if n < 6 else 2 if n < 8 else 3 if n < 12 else 4 if n < 16 else 5 if n < 20 else 6 if n < 32 else 7
    lower, upper = any("a" <= c <= "z" for c in core), any("A" <= c <= "Z" for c in core)
    digits = sum(c.isdigit() for c in core)
    share = 0 if not digits else 3 if digits == n else 1 if 4 * digits < n else 2
    marks = any(c in "+/_.-" for c in core)
    varied = len(set(core)) * 2 > min(n, 24)
    return 1 + WORDS + (bucket | lower << 3 | upper << 4 | share << 5 | marks << 7 | varied << 8)


def file_feature(ids: np.ndarray, chars: int) -> int:
    size = min(7, max(0, chars.bit_length() - 7))
    odd = float((ids > WORDS).mean()) if len(ids) else 0.0
    return size * 8 + min(7, int(odd * 40))


class _Features(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        value = feature(token)
        if len(token) <= 64:
            self[token] = value
        return value


_features = _Features()
memos.append(_features)


def _windows(text: str, seed: int) -> list[tuple[list[int], list[int], int]]:
    """(features, tags, file feature) of windows: around each base secret, one elsewhere, and that with a generated secret."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    if not spans:
        return []
    tokens = [text[a:b] for a, b in spans]
    tags, at = [O] * len(spans), 0
    centres = []
    for a, b in secret_values(text):
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        j = at
        while j < len(spans) and spans[j][0] < b:
            tags[j] = B if j == at else I
            j += 1
        if j > at:
            centres.append(at)
    ids = [_features[t] for t in tokens]
    whole = file_feature(np.array(ids), len(text))
    rng = random.Random(seed)

    def window(f: list[int], y: list[int], c: int):
        lo = c - SIDE
        pick = range(lo, lo + LENGTH)
        return ([f[i] if 0 <= i < len(f) else 0 for i in pick], [y[i] if 0 <= i < len(f) else O for i in pick], whole)

    out = [window(ids, tags, c) for c in (centres if len(centres) <= SECRETS else rng.sample(centres, SECRETS))]
    c = rng.randrange(len(ids))
    out.append(window(ids, tags, c))
    put, marks = _made_up(rng)
    out.append(window(ids[:c] + [_features[t] for t in put] + ids[c:], tags[:c] + marks + tags[c:], c + marks.index(B)))
    return out


def _made_up(rng: random.Random) -> tuple[list[str], list[int]]:
    """Tokens with a generated secret, and their tags."""
    n = rng.randint(16, 44)
    secret = rng.choice((
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(n)),
        lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)),
        lambda: "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16)),
        lambda: rng.choice(("ghp_", "sk-", "xoxb-", "glpat-")) + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)),
        lambda: "".join(rng.choice(string.ascii_letters + string.digits + "_") for _ in range(rng.randint(8, 14))) + rng.choice(string.digits) + rng.choice("aZ"),
    ))()
    before = rng.choice((["key"], ["password"], ["secret"], ["token"], ["api_key"], ["credentials"], ["auth"], ["bearer"], ["pwd"], []))
    link = rng.choice((["="], [":"], ["=", '"'], [":", '"'], ['="'], [])) if before else []
    after = rng.choice(([], ['"'], [";"], [","]))
    tail = rng.choice((["=="], ["~", secret[::-1]], [], [], [])) if len(secret) > 15 else []
    return [*before, *link, secret, *tail, *after], [O] * (len(before) + len(link)) + [B] + [I] * len(tail) + [O] * len(after)


class Model:
    """Weights of the field, as leads of begin and inside over outside where that is enough."""

    def __init__(self, own, prev, prev2, nxt, file, trans):
        self.own, self.prev, self.prev2, self.nxt, self.file, self.trans = own, prev, prev2, nxt, file, trans
        lead = lambda w: np.ascontiguousarray((w[:, 1:] - w[:, :1]).astype(np.float32))
        self.leads = [lead(w) for w in (own, prev, prev2, nxt, file)]
        #: the most that transitions can gain for begin or inside over outside, with room for rounding
        self.reach = [float((trans[:, y] - trans[:, O]).max() + (trans[y] - trans[O]).max()) + 1e-3 for y in (B, I)]

    def lead(self, ids: np.ndarray, files: np.ndarray) -> np.ndarray:
        """ids: with two zeros before the first and one after the last token of each document."""
        own, prev, prev2, nxt, file = self.leads
        e = own[ids] + file[files]
        e[1:] += prev[ids[:-1]]
        e[2:] += prev2[ids[:-2]]
        e[:-1] += nxt[ids[1:]]
        return e

    def viterbi(self, lead: np.ndarray) -> list[int]:
        """Best tags of a run of tokens between tokens that are outside."""
        t = self.trans
        score, back = t[O] + np.array([0.0, *lead[0]]), []
        for e in lead[1:]:
            step = score[:, None] + t
            back.append(step.argmax(0))
            score = step.max(0) + np.array([0.0, *e])
        tags = [int((score + t[:, O]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def train(x: np.ndarray, y: np.ndarray, files: np.ndarray, epochs: int = 60, rate: float = 1.5, l2: float = 1e-4) -> Model:
    """Full-batch AdaGrad on the conditional log-likelihood of windows (n, LENGTH)."""
    own, prev, prev2, nxt = (np.zeros((FEATURES, 3)) for _ in range(4))
    file, trans = np.zeros((FILES, 3)), np.zeros((3, 3))
    if not len(x):
        own[:, O] = 9.0
        return Model(own, prev, prev2, nxt, file, trans)
    n, length = x.shape
    rare = np.flatnonzero(np.bincount(x.ravel(), minlength=FEATURES) < RARE)
    rare = rare[(rare > 0) & (rare <= WORDS)]
    same = np.arange(FEATURES)
    same[rare] = FEATURES - 1
    x = same[x]
    pad = np.pad(x, ((0, 0), (2, 1)))
    views = [(own, x), (prev, pad[:, 1 : 1 + length]), (prev2, pad[:, :length]), (nxt, pad[:, 3 : 3 + length])]
    gold = np.eye(3)[y]
    rows = np.zeros((3, 3))
    for a in range(length - 1):
        rows += np.einsum("ni,nj->ij", gold[:, a], gold[:, a + 1])
    grads = [np.full_like(w, 1e-2) for w in (own, prev, prev2, nxt, file, trans)]
    for _ in range(epochs):
        e = sum(w[f] for w, f in views) + file[files][:, None]
        alpha, beta = np.empty((length, n, 3)), np.zeros((length, n, 3))
        alpha[0] = e[:, 0]
        for i in range(1, length):
            alpha[i] = np.logaddexp.reduce(alpha[i - 1][:, :, None] + trans, axis=1) + e[:, i]
        for i in range(length - 2, -1, -1):
            beta[i] = np.logaddexp.reduce(trans + (e[:, i + 1] + beta[i + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(alpha[-1], axis=1)
        p = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
        pairs = np.zeros((3, 3))
        for i in range(length - 1):
            pairs += np.exp(alpha[i][:, :, None] + trans + (e[:, i + 1] + beta[i + 1])[:, None, :] - z[:, None, None]).sum(0)
        d = (gold - p).reshape(-1, 3)
        steps = []
        for w, f in views:
            g, flat = np.empty_like(w), f.reshape(-1)
            for k in range(3):
                g[:, k] = np.bincount(flat, d[:, k], FEATURES)
            steps.append(g)
        by_doc, g = (gold - p).sum(1), np.empty_like(file)
        for k in range(3):
            g[:, k] = np.bincount(files, by_doc[:, k], FILES)
        steps += [g, rows - pairs]
        for w, g, total in zip((own, prev, prev2, nxt, file, trans), steps, grads):
            g -= l2 * n * w / 10
            total += g * g
            w += rate * g / np.sqrt(total)
    for w in (own, prev, prev2, nxt):
        w[:] = w[same]
    return Model(own, prev, prev2, nxt, file, trans)


def sampled(texts: DataFrame, rows: int, size: int) -> DataFrame:
    """About size distinct texts of rows by a 64-bit hash: all where there are fewer, some however many there are."""
    h, share = F.xxhash64("text"), min(1.0, size / max(rows, 1))
    part = texts if share >= 1 else texts.where(h < F.lit(int(-(2**63) + share * 2**64)))
    return part.groupBy(h.alias("h")).agg(F.min("text").alias("text")).select("text")


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = sampled(texts, texts.count(), sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in pieces(batches):
            # the hash makes which windows are used when there are too many independent of order
            out = [(h, *w) for t in part for h in [zlib.crc32(t.encode("utf-8", "replace"))] for w in _windows(t, h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w[0] for w in out], pa.int64()), pa.array([w[1] for w in out], pa.list_(pa.int32())), pa.array([w[2] for w in out], pa.list_(pa.int32())), pa.array([w[3] for w in out], pa.int32())],
                ["h", "x", "y", "file"],
            )

    found = texts.mapInArrow(run, "h long, x array<int>, y array<int>, file int").distinct()
    # at most MAX_WINDOWS rows of fixed size come to the driver
    with small_batches(docs.sparkSession):
        rows = found.orderBy("h", "x", "y").limit(MAX_WINDOWS).collect()
    x = np.array([r.x for r in rows], dtype=np.int64).reshape(-1, LENGTH)
    y = np.array([r.y for r in rows], dtype=np.int64).reshape(-1, LENGTH)
    return train(x, y, np.array([r.file for r in rows], dtype=np.int64))


def crf_spans(texts: list[str], model: Model) -> list[list[tuple[int, int]]]:
    """Spans of the field's secrets in each text, as code points."""
    get = _features.__getitem__
    parts, at, files = [np.zeros(2, np.int32)], [], []
    for t in texts:
        ids = np.fromiter(map(get, TOKEN.findall(t)), np.int32)
        at.append(len(ids))
        files.append(file_feature(ids, len(t)))
        parts += [ids, np.zeros(2, np.int32)]
    ids = np.concatenate(parts)
    counts = np.array(at, dtype=np.int64)
    lead = model.lead(ids, np.concatenate([[0, 0], np.repeat(np.array(files, dtype=np.int64), counts + 2)]).astype(np.int64))
    open_ = (lead[:, 0] > -model.reach[0]) | (lead[:, 1] > -model.reach[1])
    open_ &= ids > 0
    where = np.flatnonzero(open_)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(where):
        return out
    starts = np.concatenate([[2], 2 + np.cumsum(counts + 2)[:-1]])
    for doc, run in _runs(where, starts, counts):
        tags = model.viterbi(lead[run[0] : run[-1] + 1])
        if any(tags):
            base = int(starts[doc])
            out[doc] += [(run[0] - base + i, y) for i, y in enumerate(tags)]
    for doc, tagged in enumerate(out):
        if tagged:
            spans = [m.span() for m in TOKEN.finditer(texts[doc])]
            joined: list[list[int]] = []
            last = -2
            for i, y in tagged:
                if y == B or y == I and last != i - 1:
                    joined.append(list(spans[i]))
                    last = i
                elif y == I:
                    joined[-1][1] = spans[i][1]
                    last = i
            out[doc] = [(a, b) for a, b in joined]
    return out


def _runs(where: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    breaks = np.flatnonzero(np.diff(where) > 1) + 1
    for run in np.split(where, breaks):
        yield int(np.searchsorted(starts, run[0], side="right") - 1), run.tolist()


def spans_of(texts: list[str], model: Model) -> list[tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]]:
    """(base spans, all spans) of each text."""
    out = []
    for text, extra in zip(texts, crf_spans(texts, model)):
        base = base_spans(text)
        more = [(a, "crf", b) for a, b in extra if all(b <= s or a >= e for s, _, e in base)]
        out.append((base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row; ids may be of any type.

    Null texts are empty and hold nothing. Texts are searched whole, however long,
    and tokens hashed whole. Base spans of different kinds may overlap and all
    stay, by start, then kind as listed; a span of the field that touches a base
    span goes. Of taggings that tie, the one with outside before begin before
    inside wins. Repeated rows give repeated rows, an empty table an empty one;
    other columns, whatever their names, aren't looked at. A model is fitted where none is given.
    """
    model = model or fit(docs, text_col)
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            found = spans_of(texts, model)
            n = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *[pa.array(c, pa.int64()) for c in n],
                    pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([joined(every) for _, every in found], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = x.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found secret replaced by mark; all columns and rows stay, null texts too."""
    model = model or fit(docs, text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text_col):
            new = []
            for text, old, (_, every) in zip(texts, batch.column(place).is_null().to_pylist(), spans_of(texts, model)):
                out, at = [], 0
                for a, _, b in every:
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                new.append(None if old else "".join(out) + text[at:])
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
