"""Robust statistics on flat arrays that hold many groups one after the other."""

from __future__ import annotations

import numpy as np

BLOCK = 200_000


def offsets(groups: np.ndarray) -> np.ndarray:
    """Start of each run of equal group numbers, and the end."""
    if not len(groups):
        return np.array([0])
    return np.r_[0, np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups)]


def windows(values: np.ndarray, groups: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """values at i + shift for each shift, NaN where that is another group."""
    at = np.arange(len(values))[:, None] + shifts[None, :]
    inside = (at >= 0) & (at < len(values))
    at = np.clip(at, 0, max(0, len(values) - 1))
    return np.where(inside & (groups[at] == groups[:, None]), values[at], np.nan)


def row_median(w: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN if it has nothing else."""
    s = np.sort(w, axis=1)
    n = (~np.isnan(s)).sum(1)
    i, last = np.arange(len(s)), np.maximum(n - 1, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        mid = s[i, last // 2] / 2 + s[i, (last + 1) // 2] / 2
    return np.where(n > 0, mid, np.nan)


def running_median(values: np.ndarray, groups: np.ndarray, half: int) -> np.ndarray:
    """Median of up to 2 * half + 1 successive values around each, within its group."""
    shifts = np.arange(-half, half + 1)
    out = np.empty(len(values))
    for a in range(0, len(values), BLOCK):
        lo, hi = max(0, a - half), min(len(values), a + BLOCK + half)
        b = min(len(values), a + BLOCK)
        out[a:b] = row_median(windows(values[lo:hi], groups[lo:hi], shifts)[a - lo : b - lo])
    return out


def group_median(values: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    """Median of each of the groups 0 to count - 1; NaN for groups without values. NaNs don't count."""
    keep = ~np.isnan(values)
    v, g = values[keep], groups[keep]
    order = np.lexsort((v, g))
    v, g = v[order], g[order]
    n = np.bincount(g, minlength=count)
    start = np.r_[0, np.cumsum(n)[:-1]]
    out = np.full(count, np.nan)
    has = n > 0
    with np.errstate(over="ignore", invalid="ignore"):
        out[has] = v[(start + (n - 1) // 2)[has]] / 2 + v[(start + n // 2)[has]] / 2
    return out


def group_spread(dev: np.ndarray, groups: np.ndarray, count: int) -> np.ndarray:
    """Typical size of the deviations: 1.4826 times the median of their sizes, for series that mostly repeat a value
    the mean of the smaller nine tenths instead; 0 for groups without any."""
    size = np.abs(dev)
    mad = 1.4826 * group_median(size, groups, count)
    keep = ~np.isnan(size)
    s, g = size[keep], groups[keep]
    order = np.lexsort((s, g))
    s, g = s[order], g[order]
    n = np.bincount(g, minlength=count)
    rank = np.arange(len(s)) - np.r_[0, np.cumsum(n)[:-1]][g]
    low = rank < np.ceil(0.9 * n[g])
    mean = np.bincount(g[low], s[low], count) / np.maximum(np.bincount(g[low], minlength=count), 1)
    return np.fmax(np.nan_to_num(mad), 1.2533 * mean)
