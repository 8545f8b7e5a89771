"""Longest common prefixes up to a threshold, by breadth-first backward extension on a BWT.

All strings of length l + 1 whose suffix of length l opened an interval are visited together, one
level after the other; a string's interval ends where the common prefix with the next suffix is l.
Values therefore come in increasing order, and what is still open after the last level has at least
the threshold in common with its predecessor. Work is linear in the text: an interval that closes
nothing new is not extended.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Order of all suffixes by prefix doubling; suffixes must differ within ``longest`` symbols."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step if step < n else 0] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        step *= 2
        if step >= longest or sorted_key.size == 0 or rank[order[-1]] == n - 1:
            return order


def common_at_least(symbols: np.ndarray, separators: int, threshold: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, whether suffix k shares ``threshold`` symbols with suffix k - 1).

    symbols: non-negative; those below ``separators`` each occur once and end the strings.
    """
    n = len(symbols)
    order = suffix_order(symbols, longest)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    first_row = np.empty(n, np.int64)
    first_row[by_symbol] = np.arange(n)  # where the suffix with one symbol more stands
    ordered = bwt[by_symbol]
    key = ordered.astype(np.int64) * n + by_symbol
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    previous = np.full(n, -1, np.int64)
    previous[by_symbol[same]] = by_symbol[np.flatnonzero(same) - 1]
    run = np.concatenate([[True], bwt[1:] != bwt[:-1]])
    runs, runs_before = np.flatnonzero(run), np.cumsum(run)
    text = bwt >= separators

    head = symbols[order]
    start = np.concatenate([[True], head[1:] != head[:-1]])
    closed = np.append(start, True)  # boundaries whose common prefix is known: 0 here
    left = np.flatnonzero(start)
    right = np.append(left[1:], n) - 1
    for _ in range(1, threshold):
        extra = runs_before[right] - runs_before[left]
        owner = np.repeat(np.arange(len(left)), extra)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(extra) - extra, extra)
        at = np.concatenate([left, runs[runs_before[left][owner] + inside]])
        owner = np.concatenate([np.arange(len(left)), owner])
        keep = text[at] & (previous[at] < left[owner])
        at, owner = at[keep], owner[keep]
        low = first_row[at]
        high = low.copy()
        wide = np.flatnonzero(right[owner] > at)
        if len(wide):
            high[wide] = np.searchsorted(key, bwt[at[wide]].astype(np.int64) * n + right[owner[wide]], "right") - 1
        fresh = ~closed[high + 1]
        left, right = low[fresh], high[fresh]
        closed[right + 1] = True
        if not len(left):
            break
    return order, ~closed[:n]
