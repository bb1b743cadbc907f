"""Texts as sets of hashed terms, one after another in arrays: what the fitted models share."""

from __future__ import annotations

import numpy as np


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of the given sizes, empty ones too."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    real = sizes > 0
    if real.any():
        out[real] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[real], axis=0)
    return out


def spread(places: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The sum of the rows of values for each place."""
    return np.stack([np.bincount(places, column, minlength=k) for column in values.T], 1).astype(np.float32)


class Rows:
    """Texts as sorted places of their terms, with labels."""

    def __init__(self, places: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.places, self.sizes, self.labels = places, sizes, labels.astype(np.float32)
        self.ends = np.cumsum(sizes)

    @classmethod
    def of_lists(cls, rows: list, labels: np.ndarray) -> "Rows":
        places = np.concatenate([np.asarray(x, np.int32) for x in rows]) if len(rows) else np.zeros(0, np.int32)
        return cls(places, np.array([len(x) for x in rows], np.int64), np.asarray(labels))

    def __len__(self) -> int:
        return len(self.sizes)

    def part(self, a: int, b: int) -> "Rows":
        start = int(self.ends[a - 1]) if a else 0
        return Rows(self.places[start : int(self.ends[b - 1]) if b else 0], self.sizes[a:b], self.labels[a:b])

    def parts(self, size: int) -> list["Rows"]:
        return [self.part(a, min(a + size, len(self))) for a in range(0, len(self), size)]

    def only(self, wanted: np.ndarray) -> "Rows":
        """The rows without terms that aren't wanted; the places stay as they are."""
        held = wanted[self.places]
        return Rows(self.places[held], sums(held.astype(np.int64), self.sizes), self.labels)

    def of(self) -> np.ndarray:
        """The row of each place."""
        return np.repeat(np.arange(len(self)), self.sizes)


def common_terms(rows: list[np.ndarray], buckets: int, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets that `least` rows or more hold, but not all, and the rows as places among them."""
    count = sum((np.bincount(h, minlength=buckets) for h in rows), np.zeros(buckets, np.int64))
    used = np.flatnonzero((count >= least) & (count < max(len(rows), 1)))
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used))
    return used, [p[p >= 0] for p in (place[h] for h in rows)]


def shrunk(moved: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The proximal step of an L1 penalty."""
    return np.sign(moved) * np.maximum(np.abs(moved) - by, 0)
