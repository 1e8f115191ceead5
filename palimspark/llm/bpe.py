"""Exact BPE by dynamic programming over prefixes.

Every prefix of a word has one encoding, so one last token. For each position
the tokens that end there (matches of an automaton with suffix links over the
vocabulary) are tried, longest first: the token that may follow the last token of
the prefix before it is the one. Whether two tokens may stand side by side is
decided by undoing their merges, the later one first, and looking for a merge
across the boundary that would have come earlier. Back-pointers from the end
give the ids. Time is linear in the length of the word.

Covers tokenizer files of the kind "BPE with byte-level alphabet, end-of-word
suffix, NFC and lower-casing" (word_bpe_49k.json); others are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimspark.llm.common import MEMO_ENTRIES, memos, pieces

END = "\x00"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same on texts of ASCII and Latin letters alone.
_LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ"
_PLAIN = re.compile(f"[\x00-\x1b\x20-\x7f\xa1\xa7\xab\xaa\xb5\xba\xbb\xbf\xdf-\xf6\xf8-\xff–—‘’“”…]*")
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^ \t-\r0-9{_LATIN}]+")
_FULL = regex.compile(PATTERN)
LONG_WORD = 48
#: Bits of a token's id, where two are one number.
SHIFT = 20


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in keep:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(extra)
            extra += 1
    return out


def _split(text: str) -> list[str]:
    """Characters that Python's tables don't know count as symbols, as the library's older tables have it."""
    chars = set(text)
    new = [c for c in chars if unicodedata.category(c) == "Cn"]
    if not new:
        return _FULL.findall(text)
    free = (chr(c) for c in range(0xF0000, 0xFFFFE) if chr(c) not in chars)
    there = {ord(c): next(free) for c in new}
    back = {ord(v): chr(k) for k, v in there.items()}
    return [w.translate(back) for w in _FULL.findall(text.translate(there))]


class _Memo(dict):
    """key -> value(key). A full table becomes the one from which keys that come again are taken, so those that often do stay."""

    def __init__(self, value):
        self.value, self.before = value, {}
        memos.extend([self, self.before])

    def __missing__(self, key):
        if (found := self.before.get(key)) is None:
            found = self.value(key)
            if isinstance(key, str) and len(key) > LONG_WORD:
                return found
        if len(self) >= MEMO_ENTRIES:
            self.before.clear()
            self.before.update(self)
            self.clear()
        self[key] = found
        return found


class Encoder:
    """Ids and decoded text as the tokenizers library gives them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path} isn't a tokenizer of the kind that is covered")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(self.alphabet)}
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # a token's rank is the order of its merge; single symbols have none
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole in self.parts:
                raise ValueError("a token has two merges")
            self.rank[whole], self.parts[whole], self.pair[left, right] = rank, (left, right), rank
        if max(self.names) >> SHIFT:
            raise ValueError("too many tokens")
        self.length: dict[int, int] = {}
        machine = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in self.parts and not self.compatible(*self.parts[i], self.rank[i]):
                continue  # its own text is encoded in another way
            end = token.endswith(suffix) and token != suffix
            text = token[: -len(suffix)] + END if end else token
            machine.add_word(text, (i, i << SHIFT, len(text)))
            self.length[i] = len(text)
        machine.make_automaton()
        self.machine = machine
        self.digits = {i: str(i) for i in self.names}
        # left << SHIFT | right -> whether they may stand side by side
        self.safe = _Memo(lambda key: self.compatible(key >> SHIFT, key & ((1 << SHIFT) - 1)))
        self.memo = _Memo(self._word)

    def compatible(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge across the boundary of left and right comes before limit or before their own merges."""
        rank, parts, pair = self.rank, self.parts, self.pair
        while True:
            across = pair.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # left was made last
                left, limit = parts[left][1], a
            else:  # of equal merges, the leftmost comes first: one across comes before right's own
                right, limit = parts[right][0], b + 1

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        # printable ASCII stands for itself
        text = (word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.table)) + END
        # the last token of the prefix that ends at each place, shifted
        last: list[int | None] = [None] * len(text)
        safe = self.safe
        for at, (token, shifted, length) in self.machine.iter(text):
            if last[at] is not None:
                continue
            before = at - length
            if before >= 0:
                left = last[before]
                if left is None or not safe[left | token]:
                    continue
            last[at] = shifted
        out, at = [], len(text) - 1
        while at >= 0:
            if last[at] is None:
                raise AssertionError("a prefix has no last token")
            out.append(last[at] >> SHIFT)
            at -= self.length[out[-1]]
        out.reverse()
        return out

    def _word(self, word: str) -> tuple[str, str]:
        ids = self.word_ids(word)
        digits, names = self.digits, self.names
        return " ".join([digits[i] for i in ids]), " ".join([names[i] for i in ids])

    @staticmethod
    def words(text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        else:
            text = text.lower()
        return _FAST.findall(text) if _PLAIN.fullmatch(text) else _split(text)

    def _plain(self, text: str) -> tuple[str, str]:
        found = list(map(self.memo.__getitem__, self.words(text)))
        return " ".join([ids for ids, _ in found]), " ".join([tokens for _, tokens in found])

    def encode(self, text: str) -> tuple[str, str]:
        """(ids joined by a space, decoded text). Texts of special tokens are those tokens."""
        if self.special_re is None or "<|" not in text:
            return self._plain(text)
        ids, tokens = [], []
        for i, part in enumerate(self.special_re.split(text)):
            if i % 2:
                ids.append(str(self.special[part]))
                tokens.append(part)
            elif part:
                a, b = self._plain(part)
                if a:
                    ids.append(a)
                    tokens.append(b)
        return " ".join(ids), " ".join(tokens)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids ids (array of int) and decoded, for each row.

    path: the tokenizer file, at the same place on all executors. Ids may be of
    any type. Null texts are empty: no tokens, and digests of empty strings.
    Texts are encoded whole, however long, words of any length in time linear in
    it. There are no ties: a text has one encoding. Repeated rows give repeated
    rows, an empty table an empty one; other columns of docs, whatever their names, aren't looked at.
    """
    from pyspark.sql import functions as F

    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        sha = hashlib.sha256
        for batch, texts in pieces(batches):
            out = [enc.encode(t) for t in texts]
            columns = [
                batch.column(0),
                pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in out], pa.int64()),
                pa.array([sha(ids.encode()).hexdigest() for ids, _ in out], pa.string()),
                pa.array([sha(tokens.encode()).hexdigest() for _, tokens in out], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([[int(i) for i in ids.split()] for ids, _ in out], pa.list_(pa.int32())), pa.array([t for _, t in out], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = x.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
