"""Ids of many documents on the driver: flat ids and row offsets."""

from __future__ import annotations

import numpy as np


class RaggedIds:
    """Row i is ids[offsets[i] : offsets[i + 1]], a view."""

    __slots__ = ("ids", "offsets")

    def __init__(self, ids, offsets):
        self.ids = np.asarray(ids, np.uint32)
        self.offsets = np.asarray(offsets, np.int64)

    @classmethod
    def of(cls, rows) -> RaggedIds:
        rows = list(rows)
        flat = np.fromiter((i for r in rows for i in r), np.uint32)
        return cls(flat, np.cumsum([0, *map(len, rows)]))

    def __len__(self):
        return len(self.offsets) - 1

    def __getitem__(self, at):
        rows = range(len(self))
        if isinstance(at, slice):
            if at.indices(len(self))[2] != 1:
                raise ValueError("slices of rows must be contiguous")
            chosen = rows[at]
            first, last = (chosen.start, max(chosen.start, chosen.stop))
            return RaggedIds(self.ids[self.offsets[first] : self.offsets[last]], self.offsets[first : last + 1] - self.offsets[first])
        i = rows[at]  # raises IndexError
        return self.ids[slice(*self.offsets[i : i + 2])]

    def __iter__(self):
        return map(self.__getitem__, range(len(self)))

    lengths = property(lambda self: np.diff(self.offsets))
    num_tokens = property(lambda self: int(self.offsets[-1]))

    def to_list(self):
        return [row.tolist() for row in self]

    def to_awkward(self):
        import awkward

        return awkward.unflatten(self.ids, self.lengths)

    def __repr__(self):
        return f"{type(self).__name__}({len(self)} rows, {self.num_tokens} tokens)"
