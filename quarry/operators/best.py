"""The best k of each of many lists, kept in numpy while rows pass by."""

from __future__ import annotations

import numpy as np


class Best:
    """For each of `lists` lists the k least (value, id), with another number for each if asked for. Places not taken hold infinity."""

    def __init__(self, lists: int, k: int, more: bool = False) -> None:
        self.k = k
        self.values, self.ids = np.full((lists, k), np.inf), np.zeros((lists, k), np.int64)
        self.more = np.zeros((lists, k)) if more else None

    @property
    def worst(self) -> np.ndarray:
        """What a value must not exceed to enter, by list."""
        return self.values[:, -1]

    def add(self, lists: np.ndarray, values: np.ndarray, ids: np.ndarray, more: np.ndarray | None = None) -> None:
        last, last_id = self.values[lists, -1], self.ids[lists, -1]
        enter = np.flatnonzero((values < last) | ((values == last) & (ids < last_id) & np.isfinite(values)))
        if not len(enter):
            return
        touched, own = np.unique(lists[enter], return_inverse=True)
        n = len(touched)
        row = np.concatenate([own, np.repeat(np.arange(n), self.k)])
        both = [np.concatenate([x[enter], y[touched].ravel()]) for x, y in ((values, self.values), (ids, self.ids), *(((more, self.more),) if self.more is not None else ()))]
        order = np.lexsort((both[1], both[0], row))
        first = np.searchsorted(row[order], np.arange(n))
        order = order[(first[:, None] + np.arange(self.k)).ravel()]  # each list has k rows at least: those it had
        for kept, x in zip((self.values, self.ids, self.more), both):
            kept[touched] = x[order].reshape(n, self.k)
