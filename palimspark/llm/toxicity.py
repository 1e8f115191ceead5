"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A token that shows signs of disguise - digits or signs among letters, a letter
three times in a row, separators between letters, or a run of RUN single
letters - becomes a lattice of characters: a sign may stand for letters, a
repeated letter or a separator may be dropped, a gap between single letters may be
closed. Viterbi finds the path with the greatest product of channel and a
trigram model of characters; its letters are the restored word. A token without
such signs has one path, itself. A token with marks inside also counts as the
words between them, restored one by one, and as its restored parts, one by one
and joined.

The character model counts all documents, whole. The scorer is a logistic
regression on which restored words and word beginnings a text has, by
follow-the-regularised-leader updates over at most MAX_ROWS labelled rows by
hash of id; labels of held-out rows never reach it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimspark.llm.common import MEMO_ENTRIES, held_out, pieces, small_batches, tidy
from palimspark.llm.quality import ftrl, labelled

BITS = 17
DIM = 1 << BITS
MAX_ROWS = 8_000
RUN = 2
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = frozenset(".-_*~'`^=,:;/\\")
EDGE = ".,;:!?\"'`()[]{}<>*#%&|~^=+-_/\\$@…«»“”„‘’¡¿"
#: Log-probabilities of the channel: a sign for a letter, a sign as itself, a letter said again, a separator, a closed and a kept gap.
SUBSTITUTE, KEEP_SIGN, REPEAT, DROP, CLOSE, GAP = -1.5, -9.0, -0.7, -0.7, -0.2, -3.0
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_AMBIGUOUS = re.compile(r"[a-z][0-9@$!|+(€£¡]|[0-9@$!|+(€£¡][a-z]|([a-z])\1\1|[a-z][.\-_*~'`^=,:;/\\][a-z]", re.I)
_SPACED, _MORE = 1 << 40, 1 << 41


def char_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams (other characters: a boundary) over all texts; 27^3 numbers whatever the input."""
    x = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for _, texts in pieces(batches):
            c = _CODE[np.frombuffer(("  " + "  ".join(texts) + "  ").encode("utf-8", "replace"), np.uint8)]
            total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["g", "n"])

    with small_batches(docs.sparkSession):
        got = x.mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(27**3, np.int64)
    out[got.column("g").to_numpy()] = got.column("n").to_numpy()
    return out


class Channel:
    """Log-probabilities of the character model, and the decoder."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(27, 27, 27).astype(float)
        two = c.sum(0)
        one = two.sum(0) + 1
        p1 = one / one.sum()
        p2 = (two + 27 * p1) / (two.sum(1, keepdims=True) + 27)
        p3 = (c + 27 * p2[None]) / (c.sum(2, keepdims=True) + 27)
        self.log = np.log(p3).tolist()

    def decode(self, steps: list[list[tuple[int, float, str]]]) -> str:
        """steps: for each position, options (letter code, 0 for a boundary, -1 for nothing; log-probability; text)."""
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in steps:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, back) in states.items():
                row = log[a][b]
                for code, p, text in options:
                    if code == -2:  # the letter before, again
                        s, key, link = score + p, (a, b), back
                    elif code == -1:
                        s, key, link = score + p, (a, b), back
                    else:
                        s, key, link = score + p + row[code], (b, code), (text, back)
                    old = new.get(key)
                    if old is None or s > old[0]:
                        new[key] = (s, link)
            states = new
        link = max(((s + log[a][b][0], -a, -b, l) for (a, b), (s, l) in states.items()), key=lambda x: x[:3])[3]
        out = []
        while link:
            out.append(link[0])
            link = link[1]
        return "".join(reversed(out))

    def restore(self, token: str) -> str:
        """The likeliest word behind one token in lower case."""
        steps, last = [], ""
        for c in token:
            if "a" <= c <= "z":
                options = [(ord(c) - 96, 0.0, c)]
                if c == last:
                    options.append((-2, REPEAT, ""))
            elif c in LEET:
                options = [(ord(x) - 96, SUBSTITUTE, x) for x in LEET[c]] + [(0, KEEP_SIGN, c)]
                if c == last:
                    options.append((-2, REPEAT, ""))
            elif c in SEPARATORS:
                options = [(-1, DROP, ""), (0, KEEP_SIGN / 3, " ")]
            else:
                options = [(0, 0.0, c)]
            steps.append(options)
            last = c
        return self.decode(steps)

    def close_up(self, letters: list[str]) -> list[str]:
        """The words behind a run of single characters."""
        steps = []
        for i, c in enumerate(letters):
            if i:
                steps.append([(-1, CLOSE, ""), (0, GAP, " ")])
            if "a" <= c <= "z":
                steps.append([(ord(c) - 96, 0.0, c)])
            elif c in LEET:
                steps.append([(ord(x) - 96, SUBSTITUTE, x) for x in LEET[c]] + [(0, KEEP_SIGN, c)])
            else:
                steps.append([(0, 0.0, c)])
        return self.decode(steps).split()


def word_features(word: str) -> int:
    """Two packed features: the word and its beginning."""
    raw = word.encode("utf-8", "replace")
    return (zlib.crc32(raw) & (DIM // 2 - 1)) | ((zlib.crc32(b"^" + word[:5].encode("utf-8", "replace")) & (DIM // 2 - 1)) | DIM // 2) << BITS


def split(text: str, kept: str = "") -> list[str]:
    """The pieces between white space, signs and punctuation that isn't in kept; combining marks don't split."""
    if text.isalnum():
        return [text]
    return "".join(c if c.isalnum() or c in kept or unicodedata.category(c)[0] not in "PSZC" else " " for c in text).split()


_SIGNS = "".join(c for c in LEET if not c.isalnum())


class Restorer(dict):
    """token -> packed features of the restored word; single characters and tokens of several words are marked."""

    def __init__(self, channel: Channel):
        self.channel = channel
        self._more: dict[str, tuple[int, ...]] = {}
        self._last: tuple[str, tuple[int, ...]] = ("", ())

    def plain(self, token: str) -> str:
        if not token.isascii():
            token = "".join(c for c in unicodedata.normalize("NFKC", token) if unicodedata.category(c) != "Cf")
        return token.lower()

    def more(self, token: str) -> tuple[int, ...]:
        """Packed features of the words in a token with marks inside, besides those of the whole."""
        if (known := self._more.get(token)) is not None:
            return known
        if self._last[0] == token:
            return self._last[1]
        core = self.plain(token).strip(EDGE)
        if core.isalnum():
            return ()
        whole = self.word(token)
        parts = split(whole)
        found = {*parts, "".join(parts)}
        # a sign may be a letter or a mark
        for piece in {*split(core, _SIGNS), *split(core)}:
            found.update(split(self.word(piece)))
        value = tuple(word_features(w) for w in sorted(found - {whole}) if len(w) > 1)
        if len(token) > 64:
            self._last = (token, value)
        elif value:
            if len(self._more) > MEMO_ENTRIES // 4:
                self._more.clear()
            self._more[token] = value
        return value

    def word(self, token: str) -> str:
        token = self.plain(token)
        core = token.strip(EDGE)
        if _AMBIGUOUS.search(core):
            return self.channel.restore(core)
        if _AMBIGUOUS.search(token):  # signs at the edge may be letters
            return self.channel.restore(token.rstrip("!?.,;:…")).strip(EDGE)
        return core

    def __missing__(self, token: str) -> int:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        core = token.strip(EDGE) or token
        value = word_features(self.word(token)) | (_SPACED if len(core) == 1 else 0) | (_MORE if self.more(token) else 0)
        if len(token) <= 64:
            self[token] = value
        return value

    def features(self, text: str) -> np.ndarray:
        """Distinct features of a text."""
        tokens = text.split()
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        single = (ids & _SPACED) != 0
        extra = [f for t in {tokens[k] for k in np.flatnonzero(ids & _MORE)} for f in self.more(t)]
        if len(ids) >= RUN and single.sum() >= RUN:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= RUN:
                    letters = [(t.strip(EDGE) or t).lower()[:1] for t in tokens[a:b]]
                    extra += [word_features(w) for w in self.channel.close_up(letters)]
        if extra:
            ids = np.concatenate([ids, np.array(extra, np.int64)])
        return np.concatenate([ids & (DIM - 1), (ids >> BITS) & (DIM - 1)])


class Scorer:
    """The channel and the sparse weights of restored words."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, bias: float, learned: bool = True):
        """learned: whether documents of both classes were seen, and something told them apart."""
        self.counts, self.weights, self.bias, self.learned = counts, weights.astype(np.float32), bias, learned
        self._restorer: Restorer | None = None

    def __getstate__(self):
        return self.__dict__ | {"_restorer": None}

    def forget(self) -> None:
        """Lets the memo go; a worker keeps its last task's function."""
        self._restorer = None
        tidy()

    def score(self, texts: list[str]) -> np.ndarray:
        r = self._restorer = self._restorer or Restorer(Channel(self.counts))
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = r.features(t)
            hit = f[self.weights[f] != 0]
            z[i] = self.bias + float(self.weights[np.unique(hit)].sum())
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learns from labels of rows of docs that aren't held out (see quality.labelled()). Without labels every score is 0.5."""
    counts = char_counts(docs, text_col)
    some = labelled(docs, labels, label, modulus, remainder, max_rows, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(Channel(counts))
        for batch, texts in pieces(batches):
            f = [np.unique(restorer.features(t)).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f, pa.binary()), batch.column(3)], ["h", "id", "f", "y"])

    # at most max_rows sets of features come to the driver
    with small_batches(docs.sparkSession):
        rows = some.mapInArrow(run, "h long, id string, f binary, y int").toLocalIterator(prefetchPartitions=False)
        got = sorted((r.h, r.id, bytes(r.f), r.y) for r in rows)
    return learn([(np.frombuffer(f, np.int32), y) for _, _, f, y in got], counts)


def learn(rows: list[tuple[np.ndarray, int]], counts: np.ndarray) -> Scorer:
    """Features that fewer than three rows have are left out."""
    seen = np.zeros(DIM, np.int64)
    for f, _ in rows:
        seen[f] += 1
    data = []
    for f, y in rows:
        f = f[(seen[f] > 2) & (f > 0)].astype(np.int64)
        data.append((np.concatenate([[0], f]), np.ones(len(f) + 1), y))
    s = ftrl(data, alpha=1.0, l1=4.0, l2=0.01, passes=4)
    w = s.weights[:DIM]
    z = np.array([s.bias + w[f[1:]].sum() for f, _, _ in data])
    y = np.array([y for _, _, y in data])
    return Scorer(counts, w, s.bias - _middle(z, y), len(set(y.tolist())) == 2 and bool(np.any(w)))


def _middle(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds on z with the fewest errors on the learning rows (ties: the one that finds fewer toxic); 0 where there is one class only."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    errors[1:-1][z[1:] == z[:-1]] = len(y) + 1  # no threshold between equals
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    widest = max(best, key=lambda i: (edges[i + 1] - edges[i], i))
    return float((edges[widest] + edges[widest + 1]) / 2)


def score(docs: DataFrame, scorer: Scorer, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; ids may be of any type.

    Null and empty texts get the score of the bias alone. Texts are scored whole,
    however long: a token of any length is restored whole, in time linear in it.
    Of paths through a lattice that tie, the first found is taken. A null id isn't
    held out. Repeated rows give repeated rows (rows of equal texts equal scores),
    an empty table an empty one; other columns, whatever their names, aren't looked at.
    """
    x = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, modulus, remainder).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            p = scorer.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        scorer.forget()

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose score is below threshold. Null texts stay if the empty text does.

    A scorer that hasn't seen both toxic and other documents can't tell them
    apart: all rows stay.
    """
    if not scorer.learned:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, text_col):
            yield batch.filter(pa.array(scorer.score(texts) < threshold))
        scorer.forget()

    return docs.mapInArrow(run, docs.schema)
