"""Compact exact hash tables of short byte strings, looked up for whole arrays at once.

A key is a stretch of at most ``KEY_BYTES`` bytes, held as three padded 64-bit numbers
next to its length, so a match is exact.  A table is one array with open addressing:
32 bytes a slot, at most half of the slots taken.
"""

from __future__ import annotations

import numpy as np

KEY_BYTES = 24
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def padded(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bodies one after another with room behind, and where each starts (one more at the end)."""
    first = np.concatenate(([0], np.cumsum([len(b) for b in bodies], dtype=np.int64)))
    return np.frombuffer(b"".join([*bodies, bytes(KEY_BYTES + 8)]), np.uint8), first


def keys(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keys of the stretches (not over ``KEY_BYTES`` long) of a padded buffer: three numbers and the length."""
    view = np.ndarray((len(buf) - 7,), "<u8", buf.data, strides=(1,))
    size = end - begin
    out = np.empty((len(begin), 4), np.uint64)
    for k in range(3):
        out[:, k] = view[begin + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)]
    out[:, 3] = size + 1
    return out


class Table:
    """Numbers below 2**32 by key."""

    def __init__(self, entries: int):
        self.bits = max(8, (2 * entries - 1).bit_length())
        self.room, self.held = entries, 0
        self.rows = np.zeros((1 << self.bits, 4), np.uint64)

    def _slots(self, k: np.ndarray) -> np.ndarray:
        h = k * _FACTORS
        h = h[:, 0] ^ (h[:, 1] >> np.uint64(7)) ^ (h[:, 2] >> np.uint64(13)) ^ h[:, 3]
        h = (h ^ (h >> np.uint64(31))) * _FACTORS[2]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those not held."""
        out = np.full(len(k), -1, np.int64)
        at, slot = np.arange(len(k)), self._slots(k)
        while len(at):
            rows = self.rows[slot]
            size = rows[:, 3] >> np.uint64(32)
            same = (size == k[:, 3]) & (rows[:, 0] == k[:, 0]) & (rows[:, 1] == k[:, 1]) & (rows[:, 2] == k[:, 2])
            out[at[same]] = (rows[same, 3] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            on = ~same & (size != 0)
            at, k, slot = at[on], k[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, k: np.ndarray, numbers: np.ndarray) -> None:
        """Hold different keys that are not held yet; there must be room."""
        if self.held + len(k) > self.room:
            raise ValueError("the table is full")
        self.held += len(k)
        rows = k.copy()
        rows[:, 3] = (k[:, 3] << np.uint64(32)) | numbers.astype(np.uint64)
        slot = self._slots(k)
        while len(rows):
            free = self.rows[slot, 3] == 0
            here, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.rows[here] = rows[put]
            left = np.ones(len(rows), bool)
            left[put] = False
            rows, slot = rows[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def clear(self) -> None:
        self.rows[:] = 0
        self.held = 0
