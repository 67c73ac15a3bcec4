"""Ranks of values in trailing windows of one series, without a list per window.

A series is coded once: values become their places in sorted order, and the codes
are split bit by bit, highest first, each bit's zeros before its ones. How many
values of any stretch of the series are at or below a limit then takes one step
per bit, whatever the stretch's length, for all rows at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def in_days(days: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the rows [lo, hi) of ``days`` (ascending) from ``first`` to ``last`` days away."""
    return np.searchsorted(days, days + first, "left"), np.searchsorted(days, days + last, "right")


class SortedSeries:
    """A series whose stretches can be asked how many values they have, and how many at or below a limit."""

    def __init__(self, column: pa.ChunkedArray):
        valid = pc.is_valid(column).to_numpy()
        self.valid, self.values = valid, column.to_numpy().astype(np.float64)
        known = self.values[valid]
        self.before = np.concatenate([[0], np.cumsum(valid)])
        self.sorted = np.sort(known)
        codes = np.searchsorted(self.sorted, known, "left")
        self.levels = []
        for bit in reversed(range(len(known).bit_length())):
            one = (codes >> bit & 1).astype(np.bool_)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~one)])))
            codes = np.concatenate([codes[~one], codes[one]])

    def sizes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.before[np.maximum(hi, lo)] - self.before[lo]

    def not_above(self, lo: np.ndarray, hi: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Values of rows [lo, hi) at or below each row's limit."""
        a, b = self.before[lo], self.before[np.maximum(hi, lo)]
        # A value is within the limit if its code is below the number of all values that are.
        below = np.searchsorted(self.sorted, limits, "right")
        count = np.zeros(len(a), np.int64)
        for bit, zeros in self.levels:
            left, right, up = zeros[a], zeros[b], (below >> bit & 1).astype(np.bool_)
            count += np.where(up, right - left, 0)
            a, b = np.where(up, zeros[-1] + a - left, left), np.where(up, zeros[-1] + b - right, right)
        return count


def cut_sums(series: SortedSeries, lo: np.ndarray, hi: np.ndarray, limits: np.ndarray, mean: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the running sums (or means) over rows [lo, i] for i up to hi: how many have a value, and how many are within the limit."""
    amounts = np.where(series.valid, series.values, 0.0)
    total, seen, count, hits = (np.zeros(len(lo), k) for k in (np.float64, np.int64, np.int64, np.int64))
    for step in range(int((hi - lo).max(initial=0))):
        at = np.minimum(lo + step, len(amounts) - 1)
        here = lo + step < hi
        total += np.where(here, amounts[at], 0.0)
        seen += here & series.valid[at]
        some = here & (seen > 0)
        value = total / np.maximum(seen, 1) if mean else total
        count += some
        hits += some & (value <= limits)
    return count, hits
