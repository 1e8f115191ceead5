"""Revisions as they arrive: each becomes an anchor or a delta against its predecessor.

State per page is its last revision's index, size and text, and the time spent
since the last anchor; it doesn't grow with the page's history. A transition
becomes a delta when its value is positive and the chain's time stays in the
budget. Revisions that arrive late, behind a page's last id, are given out as
anchors marked late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimspark.operators.delta import line_delta

OUT = "page_id long, idx int, revid long, size long, is_anchor boolean, base_text string, patch array<string>, late boolean"
STATE = "idx int, revid long, size long, spent long, text string"


def append(stream: DataFrame, chain_budget: int = 1_000_000) -> DataFrame:
    """stream: page_id, revid, text."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, last, size, spent, text = state.get if state.exists else (-1, -(2**62), 0, 0, None)
        out = []
        rows = pd.concat(list(frames)).sort_values("revid", kind="stable")
        for revid, new in zip(rows["revid"], rows["text"]):
            new = new or ""
            if revid <= last:
                out.append((key[0], -1, revid, len(new), True, new, None, True))
                continue
            idx += 1
            change = abs(len(new) - size)
            chained = text is not None and 2 * change - size > 0 and spent + size + change <= chain_budget
            out.append((key[0], idx, revid, len(new), not chained, None if chained else new, line_delta(text, new) if chained else None, False))
            spent = spent + size + change if chained else 1
            last, size, text = revid, len(new), new
        state.update((idx, last, size, spent, text))
        yield pd.DataFrame(out, columns=["page_id", "idx", "revid", "size", "is_anchor", "base_text", "patch", "late"])

    return stream.groupBy("page_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
