"""The median slope over all pairs of points without listing the pairs: counts of inversions narrow it down."""

from __future__ import annotations

import numpy as np

LISTED = 4  # pairs per point that are listed at last
CLOSE = 1e-12
ALL_PAIRS = 250_000  # up to so many pairs all are taken


def inversions(values: np.ndarray, listed: bool = False) -> int | tuple[np.ndarray, np.ndarray]:
    """How many pairs of places stand in descending order, or those pairs (earlier, later), by merging sorted blocks."""
    n = len(values)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    size = 1 << max(0, (n - 1).bit_length())
    held = np.concatenate([ranks, np.full(size - n, n, np.int64)])
    places = np.arange(size)
    total, found = 0, []
    width = 1
    while width < size:
        blocks = held.reshape(-1, 2 * width)
        offset = np.arange(len(blocks))[:, None] * (n + 1)
        left, right = (blocks[:, :width] + offset).ravel(), (blocks[:, width:] + offset).ravel()
        ends = np.repeat((np.arange(len(blocks)) + 1) * width, width)
        above = ends - np.searchsorted(left, right, side="right")  # of the left block, greater than each of the right one
        total += int(above.sum())
        if listed:
            order = places.reshape(-1, 2 * width)
            some = np.nonzero(above)[0]
            times = above[some]
            at = np.repeat(ends[some] - times, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            found.append((order[:, :width].ravel()[at], np.repeat(order[:, width:].ravel()[some], times)))
        by = np.argsort(blocks, axis=1, kind="stable")
        held = np.take_along_axis(blocks, by, 1).ravel()
        places = np.take_along_axis(places.reshape(-1, 2 * width), by, 1).ravel()
        width *= 2
    if not listed:
        return total
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *side]) for side in zip(*found)) if found else (none, none)


def _below(x: np.ndarray, y: np.ndarray, slope: float) -> int:
    """How many pairs with different x have a smaller slope."""
    rest = y - slope * x
    return inversions(rest[np.lexsort((rest, x))])


def _between(x: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """The slopes from ``low`` on and below ``high``, in order."""
    order = np.lexsort((x, y - low * x))
    a, b = inversions((y - high * x)[order], listed=True)
    a, b = order[a], order[b]
    return np.sort((y[b] - y[a]) / (x[b] - x[a]))


def _ends(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bounds of all slopes: they lie between those of neighbouring x."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0]
    lowest, highest = y[new], y[np.append(new[1:], len(y)) - 1]
    step = np.diff(x[new])
    return float(((lowest[1:] - highest[:-1]) / step).min()), float(((highest[1:] - lowest[:-1]) / step).max())


def _ranked(x: np.ndarray, y: np.ndarray, rank: int, pairs: int) -> float:
    """The slope of a 0-based rank among all pairs."""
    low, high = _ends(x, y)
    wide = 1e-9 * max(abs(low), abs(high), high - low) + 1e-300  # so that no slope lies on a bound
    low, high, under, over, turn = low - wide, high + wide, 0, pairs, 0
    while over - under > LISTED * len(x) and high - low > CLOSE * max(abs(low), abs(high)):
        share = min(max((rank - under) / (over - under), 0.02), 0.98) if turn % 2 else 0.381966
        middle = low + (high - low) * share
        if not low < middle < high:
            break
        count = _below(x, y, middle)
        low, under, high, over = (middle, count, high, over) if count <= rank else (low, under, middle, count)
        turn += 1
    if over - under > LISTED * len(x):
        return (low + high) / 2
    held = _between(x, y, low, high)
    return float(held[min(rank - under, len(held) - 1)]) if len(held) else (low + high) / 2


def median_slope(x: np.ndarray, y: np.ndarray) -> float | None:
    """The median of (y - y') / (x - x') over all pairs with different x; none without such a pair.

    Exact up to the rounding of y - slope x, but where more than LISTED pairs a point have slopes that differ by less than CLOSE
    of their size: then to that.
    """
    n = len(x)
    alike = np.unique(x, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((alike * (alike - 1) // 2).sum())
    if not pairs:
        return None
    if pairs <= ALL_PAIRS:
        a, b = np.triu_indices(n, 1)
        some = x[a] != x[b]
        return float(np.median((y[b] - y[a])[some] / (x[b] - x[a])[some]))
    first = _ranked(x, y, (pairs - 1) // 2, pairs)
    return first if pairs % 2 else (first + _ranked(x, y, pairs // 2, pairs)) / 2
