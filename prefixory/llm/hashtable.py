"""A fixed hash table from 64-bit keys to rows, built and read in whole numpy arrays."""

from __future__ import annotations

import numpy as np

from .shingles import mix


class HashTable:
    """find() gives for each key its index in the array the table was built from, or -1. Keys are distinct."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys).view(np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        slot = (mix(keys) >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.rows[at] < 0
            place, who = np.unique(at[free], return_index=True)
            chosen = todo[free][who]
            self.rows[place], self.keys[place] = chosen, keys[chosen]
            done = np.zeros(len(keys), bool)
            done[chosen] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = np.ascontiguousarray(keys).view(np.uint64)
        slot = (mix(keys) >> self.shift).astype(np.int64)
        out = self.rows[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            out[todo] = self.rows[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != keys[todo])]
        return out
