"""A bounded table of what is known of words, filled many words at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

#: Longer words are made anew each time, so that the table's size in bytes is bounded too.
LONGEST = 64


class WordCache:
    """table[word] holds for every word of the last fill(). make_many(list of words) gives their values.

    When the table is full, the words that came again after they were added stay; if they alone fill half of it, all go.
    """

    def __init__(self, make_many: Callable[[list], Iterable], limit: int):
        self.make_many, self.limit = make_many, limit
        self.table: dict = {}
        self._again: set = set()
        self._long: list = []

    def fill(self, words: Iterable) -> None:
        for w in self._long:
            self.table.pop(w, None)
        self._long = []
        seen = words if isinstance(words, set) else set(words)
        new = seen.difference(self.table)
        if len(self.table) + len(new) > self.limit:
            keep = self._again if len(self._again) <= self.limit // 2 else ()
            self.table = {w: self.table[w] for w in keep if w in self.table}
            self._again = set()
            new = seen.difference(self.table)
        self._again |= seen - new
        todo = list(new)
        self.table.update(zip(todo, self.make_many(todo), strict=True))
        self._long = [w for w in todo if len(w) > LONGEST]


class RowCache:
    """A bounded matrix of one row for each known word: rows(words) gives their row numbers, for use until the next call.

    make(list of words) gives the rows of new words as a matrix.
    """

    def __init__(self, make: Callable[[list], np.ndarray], width: int, limit: int):
        self.make, self.limit = make, limit
        self.table: dict = {}
        self.matrix = np.zeros((limit, width), np.float32)
        self.used = 0
        self._again: set = set()
        self._long: list = []

    def fill(self, words: Iterable) -> None:
        for w in self._long:
            self.table.pop(w, None)
        seen = words if isinstance(words, set) else set(words)
        new = seen.difference(self.table)
        if self.used + len(new) > len(self.matrix) and self.table:
            keep = [w for w in self._again if w in self.table] if len(self._again) <= self.limit // 2 else []
            self.matrix[: len(keep)] = self.matrix[[self.table[w] for w in keep]]
            self.table, self.used, self._again = {w: i for i, w in enumerate(keep)}, len(keep), set()
            new = seen.difference(self.table)
        self._again |= seen - new
        if (over := self.used + len(new) - len(self.matrix)) > 0:  # one range of texts alone has more words
            self.matrix = np.vstack([self.matrix, np.zeros((over, self.matrix.shape[1]), np.float32)])
        todo = list(new)
        if todo:
            self.matrix[self.used : self.used + len(todo)] = self.make(todo)
            self.table.update(zip(todo, range(self.used, self.used + len(todo))))
            self.used += len(todo)
        self._long = [w for w in todo if len(w) > LONGEST]

    def rows(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))


def sums(matrix: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """For each array of row numbers, the sum of these rows; zeros for an empty one."""
    out = np.zeros((len(rows), matrix.shape[1]), np.float64)
    for i, r in enumerate(rows):
        for j in range(0, len(r), 1 << 16):
            out[i] += matrix[r[j : j + (1 << 16)]].sum(0, dtype=np.float64)
    return out


_CURRENT: list = [None, None]


def current(key, make: Callable):
    """What make() gives, kept by this worker process until another key is asked for: a process that runs tasks of several
    operators one after the other holds the table of one of them."""
    if _CURRENT[0] != key:
        release_memory()
        _CURRENT[:] = [key, make()]
    return _CURRENT[1]


def release_memory() -> None:
    """Drops what current() keeps, and gives memory that this process no longer uses back to the machine, where the C
    library can do that. Tasks of operators without such tables begin with it."""
    import ctypes
    import gc

    import pyarrow as pa

    _CURRENT[:] = [None, None]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
