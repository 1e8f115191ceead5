"""Line deltas, character deltas and word deltas between successive revisions."""

from __future__ import annotations

import difflib
import itertools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_delta(before: str, after: str) -> list[str]:
    """Tagged lines: kept ("  "), removed ("- "), added ("+ ") and hints ("? "). Line ends stay."""
    return list(difflib.ndiff(before.splitlines(keepends=True), after.splitlines(keepends=True)))


def restored(patch: Column) -> Column:
    """The later text of a line delta: its kept and added lines, in plain SQL."""
    kept = F.filter(patch, lambda x: F.substring(x, 1, 2).isin("  ", "+ "))
    return F.array_join(F.transform(kept, lambda x: x.substr(F.lit(3), F.length(x))), "")


def char_delta(before: str, after: str) -> str:
    """JSON list: a number keeps so many characters, a negative one skips them, a string is put in.

    Lines are compared first, then the characters of lines that changed, without
    what both sides begin and end with.
    """
    lines = before.splitlines(keepends=True), after.splitlines(keepends=True)
    starts = [[0, *itertools.accumulate(map(len, side))] for side in lines]
    out: list = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, *lines, autojunk=False).get_opcodes():
        a, b, c, d = starts[0][i], starts[0][j], starts[1][k], starts[1][m]
        out += [b - a] if tag == "equal" else _char_steps(before[a:b], after[c:d])
    joined: list = []
    for step in out:
        same = joined and isinstance(step, int) and isinstance(joined[-1], int) and (step > 0) == (joined[-1] > 0)
        if same:
            joined[-1] += step
        else:
            joined.append(step)
    return json.dumps(joined, ensure_ascii=False)


def _char_steps(before: str, after: str) -> list:
    head = len(os.path.commonprefix([before, after]))
    tail = len(os.path.commonprefix([before[head:][::-1], after[head:][::-1]]))
    x, y = before[head : len(before) - tail], after[head : len(after) - tail]
    out = [head] if head else []
    a = b = 0
    for i, j, n in [*_common(x, y), (len(x), len(y), 0)]:
        out += ([a - i] if i > a else []) + ([y[b:j]] if j > b else []) + ([n] if n else [])
        a, b = i + n, j + n
    return out + ([tail] if tail else [])


def _common(x: str, y: str) -> list[tuple[int, int, int]]:
    """difflib's matching blocks of two strings (without autojunk), in order: the longest common part, the first one in x and then in y, and so on to its left and right.

    A part longer than the longest so far is looked for by str.find at each place of x, but where a larger range has shown
    that there is none; difflib visits all pairs of equal characters instead.
    """
    most = [len(x)] * len(x)  # no common part that begins at i is longer, in the range that holds i
    todo, out, find = [(0, len(x), 0, len(y), min(len(x), len(y)))], [], y.find
    while todo:
        low, high, start, end, top = todo.pop()
        best = at = to = 0
        for i in range(low, high):
            if most[i] <= best:
                continue
            if best >= top or i + best >= high:
                break
            j = find(x[i : i + best + 1], start, end)
            if j < 0:
                most[i] = best
                continue
            at, to, best = i, j, best + 1
            while best < top and i + best < high:
                if to + best >= end or x[i + best] != y[to + best]:
                    j = find(x[i : i + best + 1], to + 1, end)
                    if j < 0:
                        most[i] = best
                        break
                    to = j
                best += 1
        if best:
            out.append((at, to, best))
            a, b = at + best, to + best
            if at > low and to > start:
                todo.append((low, at, start, to, min(best, at - low, to - start)))
            if a < high and b < end:
                todo.append((a, high, b, end, min(best, high - a, end - b)))
    return sorted(out)


def apply_chars(before: str, delta: str) -> str:
    out, at = [], 0
    for step in json.loads(delta):
        if isinstance(step, str):
            out.append(step)
        else:
            if step > 0:
                out.append(before[at : at + step])
            at += abs(step)
    return "".join(out)


def word_delta(before: str, after: str) -> str:
    """Runs of kept (+n) and dropped (-n) words of before, and new words; one way only.

    Words are parted by single spaces, with new lines as backticks and hyphens as carets; new numbers stand in quotes.
    """
    signs = str.maketrans({"\n": "`", "-": "^"})
    cut = lambda s: s.translate(signs).split(" ")
    a, b = cut(before), cut(after)
    out = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            out.append(f"+{j - i}")
            continue
        if j > i:
            out.append(f"-{j - i}")
        out += [f'"{w}"' if w.lstrip("+").isdigit() else w for w in b[k:m]]
    return " ".join(out)


METHODS = {"lines": (line_delta, "array<string>"), "chars": (char_delta, "string"), "words": (word_delta, "string")}


def with_delta(revisions: DataFrame, base: DataFrame | None = None, method: str = "lines", name: str = "patch", only: Column | None = None) -> DataFrame:
    """Adds the delta of each revision (of those that only holds for) against its base text (null for revisions without one).

    base: page_id, idx, base_idx rows; by default the predecessor of every revision.
    The texts meet in an equi-join on (page_id, idx), so a page isn't one task.
    """
    make, kind = METHODS[method]
    if base is None:
        base = revisions.where("idx > 0").select("page_id", "idx", (F.col("idx") - 1).alias("base_idx"))
    texts = revisions.select(F.col("page_id"), F.col("idx").alias("base_idx"), F.col("text").alias("_before"))
    own = revisions if only is None else revisions.where(only)
    base = base if only is None else base.join(own.select("page_id", "idx").hint("merge"), ["page_id", "idx"], "left_semi")
    x = own.join(base.join(texts.hint("merge"), ["page_id", "base_idx"]).drop("base_idx").hint("merge"), ["page_id", "idx"], "left")
    before, after = x.columns.index("_before"), x.columns.index("text")
    arrow = pa.list_(pa.string()) if kind.startswith("array") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(before), b.column(after))  # a pair of texts at a time
            out = [make(p.as_py(), q.as_py() or "") if p.is_valid else None for p, q in pairs]
            keep = [i for i in range(b.num_columns) if i != before]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(out, arrow)], [*[b.schema.names[i] for i in keep], name])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "_before"]
    return x.mapInArrow(run, ", ".join([*fields, f"{name} {kind}"]))


def predecessors(parts: DataFrame) -> DataFrame:
    """page_id, idx, base_idx of the revisions that a partitioned table keeps as deltas against their predecessor."""
    return parts.where(~F.col("is_anchor")).select("page_id", "idx", (F.col("idx") - 1).alias("base_idx"))


def checkpoints(parts: DataFrame) -> DataFrame:
    """The same against the last anchor ("star" layout); needs anchor_idx."""
    return parts.where(~F.col("is_anchor")).select("page_id", "idx", F.col("anchor_idx").alias("base_idx"))
