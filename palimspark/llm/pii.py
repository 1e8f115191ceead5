"""Personal data: base patterns, and spans added by weak supervision.

One pass over the texts finds base spans and candidates: the base spans
themselves and spans of looser patterns (kinds after "phone" in KINDS). Seven
labelers vote on each candidate or abstain: the strict pattern, a check (of
digits, or of numbers that are never given out), the format, a gazetteer
(domains, issuer prefixes, countries, reserved ranges), cue words before it,
words that speak against it, and filler digits. The votes of all
candidates, as counts by pattern of votes (of which there are few), go into
expectation-maximisation: each labeler's reliability for each kind and each kind's share.
A logistic regression on features of the span and its surroundings - kind, size,
neighbours, and what check, format, gazetteer, cues and filler say of the kind -
with the posteriors as labels and the counts as weights, is the final classifier; looser
candidates that it accepts and that touch no base span are added. Base spans stay.

The candidates are kept as a small table in the shared folder, so texts are read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimspark.llm.common import cut, pieces

KINDS = ("email", "ip", "card", "phone", "at_email", "loose_card", "local_phone", "ssn", "iban")
BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
SSN = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_DOT = r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?"
#: What follows a written-out @: labels with written-out dots between them.
DOTTED = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++")
LABEL = re.compile(rf"{_DOT}([A-Za-z0-9-]+)")
AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?")
DOT_BEFORE = re.compile(rf"{_DOT}\Z")
LONGEST_DOT = 7
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CUES = re.compile(r"\b(?:e-?mail|mail|contact|write|reach|phone|tel|call|mobile|cell|fax|card|visa|mastercard|iban|account|bank|ssn|social|ip|host|server|address)\b", re.I)
AGAINST = re.compile(r"(?:\b(?:isbn|issn|doi|version|order|invoice|sku|part|serial|ref|page|id|no)\b\.?|[$€£%])\W{0,3}\Z", re.I)
COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info co us".split())
NO, YES, NONE = 0, 1, 2
LABELERS = 7
STRICT, CHECK, FORM, KNOWN, CUE, AGAINST_IT, FILLER = range(LABELERS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ instead of from each letter."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m.groups()))]


def cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(valid, of the right length only)."""
    good, loose = [], []
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        d = _digits(m.group())
        if 13 <= len(d) <= 19:
            (good if luhn(d) else loose).append(m.span())
    return good, loose


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = (emails(text), ips(text), cards(text)[0], phones(text))
    return [(k, a, b) for k, spans in enumerate(found) for a, b in spans]


def at_emails(text: str) -> list[tuple[int, int]]:
    """Addresses with written-out signs, whole: "ann dot lee at mail (dot) example dot com". The last label is of two letters or more.

    A written-out @ ends what stands before it and after it, so the time is linear.
    """
    out, free = [], 0
    for m in AT.finditer(text):
        after = DOTTED.match(text, m.end())
        if not after or m.start() < free:
            continue
        labels = [*LABEL.finditer(text, after.start(), after.end())]
        while labels and not (labels[-1][1].isalpha() and len(labels[-1][1]) > 1):
            labels.pop()
        start = _name_start(text, m.start(), free)
        if labels and start < m.start():
            free = labels[-1].end()
            out.append((start, free))
    return out


def _name_start(text: str, stop: int, free: int) -> int:
    """Where the name with written-out dots begins that ends at stop; stop where there is none."""
    start = at = stop
    while True:
        run = at
        while run > free and text[run - 1] in WRITTEN:
            run -= 1
        if run == at:
            return start
        start = run
        dot = DOT_BEFORE.search(text, max(free, run - LONGEST_DOT), run)
        if not dot:
            return start
        at = dot.start()


WRITTEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "dot" in text:
        out += [(4, a, b) for a, b in at_emails(text)]
    out += [(5, a, b) for a, b in cards(text)[1]]
    out += [(6, *m.span()) for m in LOCAL_PHONE.finditer(text)]
    out += [(7, *m.span()) for m in SSN.finditer(text)]
    out += [(8, *m.span()) for m in IBAN.finditer(text)]
    return out


def votes(text: str, kind: int, a: int, b: int) -> list[int]:
    span, before = text[a:b], text[max(0, a - 40) : a]
    d = _digits(span)
    strict = YES if kind < BASE else NONE
    check, form, known = NONE, NONE, NONE
    if kind == 0:
        form = YES if 1 <= span.index("@") <= 64 else NO
        known = YES if span.rpartition(".")[2].lower() in TOP_DOMAINS else NO
    elif kind == 1:
        known = NO if re.match(r"0*(?:0|10|127|255|192\.0*168|169\.0*254)\.", span) else YES
    elif kind in (2, 5):
        check = YES if kind == 2 else NO
        form = YES if span.isdigit() and len(d) in (15, 16) or re.fullmatch(r"(?:[0-9]{4}[ -]){3}[0-9]{4}", span) else NO
        known = YES if re.match(r"4|5[1-5]|2[2-7]|3[47]|6011|65", d) else NO
    elif kind == 3:
        form = YES if span.count("(") == span.count(")") and "  " not in span else NO
        known = NO if d[0] == "0" else YES
    elif kind == 4:
        known = YES if re.split(r"[\s\])]", span)[-1].lower() in TOP_DOMAINS else NO
    elif kind == 6:
        form = YES if len(set(re.findall(r"[ .-]", span))) == 1 or span[0] == "(" else NO
        known = NO if d[1:3] == "11" or d[3] in "01" else YES
    elif kind == 7:
        check = NO if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else NONE
        form = NO if check == NO else YES
    elif kind == 8:
        plain = span.replace(" ", "")
        check = YES if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else NO
        known = YES if span[:2] in COUNTRIES else NO
    cue = YES if CUES.search(before) else NONE
    against = NO if AGAINST.search(before) else NONE
    filler = NO if d and (len(set(d)) <= 2 or d in "01234567890123456789") else NONE
    return [strict, check, form, known, cue, against, filler]


def span_features(text: str, kind: int, a: int, b: int) -> int:
    side = lambda c: 0 if c.isspace() or not c else 2 if c.isalnum() else 1
    n = b - a
    size = 0 if n < 12 else 1 if n < 16 else 2 if n < 20 else 3
    varied = len(set(_digits(text[a:b]))) > 4
    return ((size * 3 + side(text[a - 1 : a])) * 3 + side(text[b : b + 1])) * 2 + varied


FEATS = 72
#: kind, size, neighbours on both sides, varied digits, cue, against, filler; and the kind with check, format and gazetteer
SIZES = np.array([len(KINDS), 4, 3, 3, 2, 2, 2, 2, 3 * len(KINDS), 3 * len(KINDS), 3 * len(KINDS)])


def design(kind: np.ndarray, feats: np.ndarray, vote: np.ndarray) -> np.ndarray:
    parts = [kind, feats // 18, feats // 6 % 3, feats // 2 % 3, feats % 2, vote[:, CUE] == YES, vote[:, AGAINST_IT] == NO, vote[:, FILLER] == NO]
    parts += [kind * 3 + vote[:, j] for j in (CHECK, FORM, KNOWN)]
    return np.hstack([np.eye(int(n))[p.astype(int)] for n, p in zip(SIZES, parts)] + [np.ones((len(kind), 1))])


def decode_votes(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3**i % 3 for i in range(LABELERS)], axis=1)


def em(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, reliabilities (kind, labeler, class, vote), shares of the kinds) of counted vote patterns.

    A labeler's reliability is its own for each kind: a right format says much of
    one kind and nothing of another.
    """
    # to begin with, a labeler that speaks is right four times in five, a check nineteen times in twenty
    first = np.array([[[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]]] * LABELERS)
    first[CHECK] = [[0.57, 0.03, 0.4], [0.03, 0.57, 0.4]]
    like = np.stack([first] * len(KINDS))
    share = np.full(len(KINDS), 0.5)
    p = np.full(len(kind), 0.5)
    for _ in range(rounds):
        log = np.log(np.stack([1 - share[kind], share[kind]], axis=1))
        for j in range(LABELERS):
            log += np.log(like[kind, j, :, vote[:, j]])
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        weight = np.stack([count * (1 - p), count * p], axis=1)
        # a prior of ten votes like those to begin with keeps the classes from changing sides
        like = np.stack([10 * first] * len(KINDS))
        for j in range(LABELERS):
            np.add.at(like[:, j], (kind[:, None], np.array([[0, 1]]), vote[:, j][:, None]), weight)
        like /= like.sum(axis=3, keepdims=True)
        mine = np.bincount(kind, count * p, len(KINDS))
        share = (mine + 1) / (np.bincount(kind, count, len(KINDS)) + 2)
    return p, like, share


def fit_spans(x: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 25, l2: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (count * q * (1 - q))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (count * (p - q)) - l2 * w)
    return w


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SPAN = "array<struct<kind:int,start:int,end:int,votes:int,feats:int>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all candidates of each row, base spans among them, by kind and start."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "votes", "feats")]))
        for batch, texts in pieces(batches):
            rows = []
            for t in texts:
                row = []
                for k, a, b in base_spans(t) + loose_spans(t):
                    code = sum(v * 3**i for i, v in enumerate(votes(t, k, a, b)))
                    row.append({"kind": k, "start": a, "end": b, "votes": code, "feats": span_features(t, k, a, b)})
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def fit(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weights of the final classifier, reliabilities) from the candidates of all documents."""
    # rows: kinds x vote patterns x features that occur, whatever the input: of 1.4 million that could, some hundreds do
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.feats").count().collect()
    if not rows:
        return np.zeros(int(SIZES.sum()) + 1) - 1.0, np.zeros((len(KINDS), LABELERS, 2, 3))
    rows.sort()
    kind, code, feats, count = (np.array([r[i] for r in rows]) for i in range(4))
    vote = decode_votes(code)
    p, like, _ = em(kind, vote, count.astype(float))
    return fit_spans(design(kind, feats, vote), p, count.astype(float)), like


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row; ids may be of any type.

    Null texts are empty and hold nothing. Texts are searched whole, however
    long, and runs of any length in time linear in them. Base spans of different
    kinds may overlap and all stay, by kind, then start; an added span that
    overlaps a base span goes, added ones may overlap each other. Repeated rows
    give repeated rows (and count as often in the statistics), an empty table an
    empty one; other columns, whatever their names, aren't looked at.
    """
    found = cut(candidates(docs, id_col, text_col), "candidates")
    w, _ = fit(found)

    def accepted(spans: list[dict]) -> list[dict]:
        loose = [s for s in spans if s["kind"] >= BASE]
        if not loose:
            return []
        vote = decode_votes(np.array([s["votes"] for s in loose]))
        x = design(np.array([s["kind"] for s in loose]), np.array([s["feats"] for s in loose]), vote)
        good = x @ w > np.log(threshold / (1 - threshold))
        taken = [s for s in spans if s["kind"] < BASE]
        out = []
        for s, ok in zip(loose, good):
            if ok and all(s["end"] <= t["start"] or s["start"] >= t["end"] for t in taken):
                out.append(s)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, every = [], [], []
            for spans in b.column(1).to_pylist():
                first = [(s["kind"], s["start"], s["end"]) for s in spans if s["kind"] < BASE]
                n.append([sum(k == i for k, _, _ in first) for i in range(BASE)])
                base.append(hashlib.sha256(joined(first).encode()).hexdigest())
                every.append(joined(first + [(s["kind"], s["start"], s["end"]) for s in accepted(spans)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([r[i] for r in n], pa.int64()) for i in range(BASE)], pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS[:BASE]], "base_sha256", "spans"],
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
