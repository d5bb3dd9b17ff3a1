"""Columns of a task's rows on its own disk: files without a name, which go with the task."""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np

#: Numbers that are worked on at a time.
SOME = 1 << 20


class Spool:
    """Arrays of one type, appended to a file; they come back as maps of it, whose pages the system may drop."""

    def __init__(self):
        self.file, self.lengths, self.dtype = tempfile.TemporaryFile(), [], None

    def append(self, x: np.ndarray) -> None:
        self.dtype = x.dtype
        self.lengths.append(len(x))
        self.file.write(np.ascontiguousarray(x).data)

    def whole(self) -> np.ndarray:
        self.file.flush()
        if not sum(self.lengths):
            return np.zeros(0, self.dtype or np.int64)
        return np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), self.dtype)

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter(np.split(self.whole(), np.cumsum(self.lengths)[:-1]))


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique(), some at a time."""
    out = x[:0]
    for lo in range(0, len(x), SOME):
        out = np.union1d(out, x[lo : lo + SOME])
    return out


def places(among: np.ndarray, x: np.ndarray) -> np.ndarray:
    """np.searchsorted() of values that are there, as small numbers."""
    out = np.empty(len(x), np.int32)
    for lo in range(0, len(x), SOME):
        out[lo : lo + SOME] = np.searchsorted(among, x[lo : lo + SOME])
    return out
