"""Content-defined factors: runs of consecutive windows that share their smallest gram.

The smallest gram fingerprint (the anchor) of a window depends on the window's content alone, so
equal windows have equal anchors wherever they occur, and equal stretches of text are cut into
equal factors except at their ends.  A factor spans all words or bytes of its windows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .rolling import Roller, sliding_min


@dataclass
class Factors:
    start: np.ndarray   # first window (index of its first unit)
    run: np.ndarray     # number of windows
    anchor: np.ndarray  # smallest gram of all its windows
    name: np.ndarray    # fingerprint of all its units


def factorise(roller: Roller, prefix: np.ndarray, row: np.ndarray, width: int, gram: int):
    """Factors of concatenated rows, and the anchor of each window; windows never cross rows."""
    windows = len(row) - width + 1
    if windows <= 0:
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Factors(z, z, u, u), u
    low = sliding_min(roller.windows(prefix, gram), width - gram + 1)
    valid = row[:windows] == row[width - 1:]
    cut = np.ones(windows, bool)
    cut[1:] = (low[1:] != low[:-1]) | ~valid[:-1] | ~valid[1:]
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, windows))
    ok = valid[at]
    at, size = at[ok], size[ok]
    return Factors(at, size, low[at], roller.slices(prefix, at, at + size + width - 1)), low


def expand(start: np.ndarray, run: np.ndarray) -> np.ndarray:
    """All windows of the given factors."""
    n = int(run.sum())
    return np.arange(n) - np.repeat(np.cumsum(run) - run, run) + np.repeat(start, run)


def flat_lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each; null lists are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    values = col.flatten()
    sizes = np.diff(col.offsets.to_numpy())
    if col.null_count:
        sizes = np.where(np.array(col.is_null()), 0, sizes)
    return values, np.repeat(np.arange(len(col)), sizes)
