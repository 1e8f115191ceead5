"""0/1 knapsack: exact, greedy with swaps, value-scaled approximation, sparse states.

Pure functions on lists of one page; each returns the ascending positions taken.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Numbers = list[int]
AUTO, EPS, MAX_STATES = "auto", 0.1, 100_000
#: Cells of a table of decisions that is kept whole.
MOST_CELLS = 500_000_000
#: Capacity up to which the exact solver takes any number of items; its rows are in memory.
MOST_CAPACITY = 10_000_000


def exact(values: Numbers, weights: Numbers, capacity: int) -> Numbers:
    """Of equal totals, the one that leaves the later items out. Any number of items; more than MOST_CELLS cells are for capacities up to MOST_CAPACITY."""
    if capacity <= 0:
        return []
    fits = [i for i in range(len(values)) if weights[i] <= capacity and values[i] > 0]
    capacity = min(capacity, sum(weights[i] for i in fits))
    if len(fits) * (capacity + 1) > MOST_CELLS and capacity > MOST_CAPACITY:
        raise ValueError(f"{len(fits)} items by {capacity} capacity is too much for the exact solver; use a heuristic")
    taken, _ = _decide([weights[i] for i in fits], [values[i] for i in fits], np.zeros(capacity + 1, np.int64), lambda row: capacity)
    return [fits[k] for k in taken[::-1]]


def greedy(values: Numbers, weights: Numbers, capacity: int, swaps: bool = True) -> Numbers:
    """By value for weight (ties: first come), or the best single item if better; then swaps one for one while any helps."""
    inside, load, gain = set(), 0, 0
    rate = [v / w if w else float("inf") for v, w in zip(values, weights)]
    for i in sorted(range(len(rate)), key=lambda k: -rate[k]):
        if load + weights[i] <= capacity:
            inside.add(i)
            load, gain = load + weights[i], gain + values[i]
    fits = [i for i in range(len(values)) if weights[i] <= capacity]
    single = max(fits, key=lambda i: (values[i], -i), default=None)
    if single is not None and values[single] > gain:
        inside, load = {single}, weights[single]
    swapped = swaps
    while swapped:
        swapped = False
        outside = [j for j in range(len(values)) if j not in inside]
        for i in sorted(inside):
            j = next((j for j in outside if values[j] > values[i] and load - weights[i] + weights[j] <= capacity), None)
            if j is not None:
                inside.remove(i)
                inside.add(j)
                load += weights[j] - weights[i]
                swapped = True
                break
    return sorted(inside)


def _grow(row: np.ndarray, size: int, gain: float, bits: np.ndarray | None = None) -> None:
    """One more item in a row of the greatest gain for each size; bits: gets the sizes where it is taken."""
    if size >= len(row):
        return
    more = row[: len(row) - size] + gain
    if bits is not None:
        taken = np.zeros(len(row), bool)
        taken[size:] = more > row[size:]
        bits[:] = np.packbits(taken)
    np.maximum(row[size:], more, out=row[size:])


def _decide(sizes: Numbers, gains: Numbers, row: np.ndarray, pick: Callable[[np.ndarray], int]) -> tuple[list[int], int]:
    """Positions taken, from the last, to reach the size that pick finds in the last row; the size that is left at the first.

    A table of more than MOST_CELLS decisions is cut in halves, the second from
    the row between them: a few rows of memory whatever the number of items.
    """
    n = len(sizes)
    if n > 1 and n * len(row) > MOST_CELLS:
        half, between = n // 2, row.copy()
        for k in range(half):
            _grow(between, sizes[k], gains[k])
        late, left = _decide(sizes[half:], gains[half:], between, pick)
        del between
        early, left = _decide(sizes[:half], gains[:half], row[: left + 1], lambda _: left)
        return [k + half for k in late] + early, left
    row, bits = row.copy(), np.zeros((n, -(-len(row) // 8)), np.uint8)
    for k in range(n):
        _grow(row, sizes[k], gains[k], bits[k])
    left, out = pick(row), []
    for k in range(n - 1, -1, -1):
        if bits[k, left >> 3] >> (7 - (left & 7)) & 1:
            out.append(k)
            left -= sizes[k]
    return out, left


def scaled(values: Numbers, weights: Numbers, capacity: int, eps: float = EPS) -> Numbers:
    """Least weight for each scaled total; within 1 - eps of the best at every size."""
    fits = [i for i in range(len(values)) if weights[i] <= capacity and values[i] > 0]
    if not fits:
        return []
    # greedy finds half of the best at least, so the best isn't above twice that
    bound = sum(values[fits[k]] for k in greedy([values[i] for i in fits], [weights[i] for i in fits], capacity, swaps=False))
    unit = max(1, int(eps * bound / len(fits)))
    small = [values[i] // unit for i in fits]
    top = min(sum(small), 2 * bound // unit)
    if top == 0:
        return greedy(values, weights, capacity)
    if len(fits) * (top + 1) > MOST_CELLS:
        got = _large_and_small(values, weights, capacity, min(eps, 1), fits, bound, len(fits) * (top + 1))
        if got is not None:
            return got
    items = [k for k, v in enumerate(small) if 0 < v <= top]
    taken, _ = _decide([small[k] for k in items], [-weights[fits[k]] for k in items], _empty(top), lambda row: int(np.flatnonzero(row >= -capacity)[-1]))
    return [fits[items[k]] for k in taken[::-1]]


def _empty(top: int) -> np.ndarray:
    row = np.full(top + 1, -np.inf)
    row[0] = 0
    return row


def _large_and_small(values: Numbers, weights: Numbers, capacity: int, eps: float, fits: list[int], bound: int, most: int) -> Numbers | None:
    """Also within 1 - eps, by a table that doesn't grow with the items; None where it isn't under most cells.

    Values over eps * bound / 2 are scaled by eps^2 * bound / 8; fewer than 4 / eps
    of them fit the best, which costs half of eps. Of one scaled value only as many
    as fit a total count, the lightest. The others fill the rest by value for
    weight, which costs one of them at most, the other half.
    """
    unit = max(1, int(eps * eps * bound / 8))
    top = 2 * bound // unit
    kept: list[int] = []
    before, n = 0, 0
    for i in sorted((i for i in fits if values[i] > eps * bound / 2), key=lambda i: (values[i] // unit, weights[i], i)):
        v = values[i] // unit
        before, n = v, n + 1 if v == before else 1
        if n <= top // v:
            kept.append(i)
    if len(kept) * (top + 1) >= most:
        return None
    rest = sorted((i for i in fits if values[i] <= eps * bound / 2), key=lambda i: -values[i] / weights[i] if weights[i] else float("-inf"))
    load = np.cumsum([0] + [weights[i] for i in rest])
    gain = np.cumsum([0] + [values[i] for i in rest])

    def pick(row: np.ndarray) -> int:
        at = np.flatnonzero(row >= -capacity)
        return int(at[np.argmax(at * unit + gain[np.searchsorted(load, capacity + row[at], "right") - 1])])

    out = [kept[k] for k in _decide([values[i] // unit for i in kept], [-weights[i] for i in kept], _empty(top), pick)[0]]
    left = capacity - sum(weights[i] for i in out)
    for i in rest:
        if weights[i] <= left:
            out.append(i)
            left -= weights[i]
    return sorted(out)


def sparse(values: Numbers, weights: Numbers, capacity: int, max_states: int = MAX_STATES) -> Numbers:
    """States (weight, value) that no other dominates, thinned out evenly beyond max_states; each keeps its own choices."""
    states: list[tuple[int, int, tuple | None]] = [(0, 0, None)]
    for i in range(len(values)):
        v, w = values[i], weights[i]
        grown = [(a + w, b + v, (i, link)) for a, b, link in states if a + w <= capacity]
        merged, top = [], -1
        for s in sorted(states + grown, key=lambda s: (s[0], -s[1])):
            if s[1] > top:
                merged.append(s)
                top = s[1]
        if len(merged) > max_states:
            at = np.unique(np.linspace(0, len(merged) - 1, max_states).astype(int))
            merged = [merged[k] for k in at]
        states = merged
    out, link = [], states[-1][2]
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def heuristic(values: Numbers, weights: Numbers, capacity: int, strategy: str = AUTO, eps: float = EPS, max_states: int = MAX_STATES) -> Numbers:
    """A named strategy, or by the size of the problem; unknown names count as auto."""
    if capacity <= 0 or not values:
        return []
    if strategy not in ("greedy", "fptas", "sparse"):
        strategy = "sparse" if len(values) <= 200 and capacity <= 200_000 else "fptas" if len(values) >= 2000 else "greedy"
    if strategy == "fptas":
        return scaled(values, weights, capacity, eps)
    if strategy == "sparse":
        return sparse(values, weights, capacity, max_states)
    return greedy(values, weights, capacity)


def runs(n: int, chosen: set[int]) -> list[list[int]]:
    """Indices 0..n - 1 cut before each that wasn't chosen."""
    starts = [i for i in range(n) if i not in chosen or i == 0]
    return [list(range(a, b)) for a, b in zip(starts, [*starts[1:], n])]

