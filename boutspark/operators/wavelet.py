"""Medians of any windows of one series, from one structure.

A wavelet matrix keeps the ranks of a series bit by bit: at every level the entries are
parted by one bit, and counts of zeros tell where a window's entries went. The k-th smallest
value of a window is found in as many steps as ranks have bits, whatever the window's width,
so many widths are answered from the series once sorted.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """k-th smallest values of index ranges of a series without gaps."""

    def __init__(self, values: np.ndarray):
        self.values, ranks = np.unique(values, return_inverse=True)
        self._levels: list[tuple[int, np.ndarray, int]] = []
        row = ranks.astype(np.int32)
        for bit in range(max(len(self.values) - 1, 0).bit_length() - 1, -1, -1):
            one = (row >> bit) & 1 == 1
            zeros = np.zeros(len(row) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self._levels.append((bit, zeros, int(zeros[-1])))
            row = np.concatenate([row[~one], row[one]])

    def kth(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th (from 0) smallest value among the entries left to right - 1 of every range."""
        rank = np.zeros(len(left), np.int32)
        for bit, zeros, parted in self._levels:
            a, b = zeros[left], zeros[right]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            left = np.where(up, parted + left - a, a)
            right = np.where(up, parted + right - b, b)
            rank |= up.astype(np.int32) << bit
        return self.values[rank]


class WindowMedians:
    """Centred running medians of one series for any number of widths; missing entries are skipped."""

    def __init__(self, series: np.ndarray):
        there = ~np.isnan(series)
        self._before = np.zeros(len(series) + 1, np.int32)
        np.cumsum(there, out=self._before[1:])
        self._matrix = WaveletMatrix(series[there])

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        """Medians around `places`; a window ends with the series, and one without entries gives NaN."""
        half = (width - 1) // 2
        n = len(self._before) - 1
        left = self._before[np.maximum(places - half, 0)]
        right = self._before[np.minimum(places + half + 1, n)]
        found = np.full(len(places), np.nan)
        some = np.flatnonzero(right > left)
        left, right = left[some], right[some]
        count = right - left
        low = self._matrix.kth(left, right, (count - 1) // 2)
        even = np.flatnonzero(count % 2 == 0)
        high = low.copy()
        high[even] = self._matrix.kth(left[even], right[even], count[even] // 2)
        found[some] = (low + high) / 2
        return found
