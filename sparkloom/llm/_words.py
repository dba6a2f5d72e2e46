"""Hashes of words and of words in a row, for whole batches of texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D, lower-cased in A-Z.  Its hash
is a polynomial over its bytes modulo 2**64, mixed; equal words have equal hashes on
every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time (more where one text alone is longer).
CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(CHUNK + 4096, n)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, starts, ends and hashes of all words, and each body's first word (one more at the end)."""
    joined = np.frombuffer(b" ".join([*bodies, b""]) or b" ", np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(b) + 1 for b in bodies]))))
    return joined, starts, ends, hashes, first


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased bytes of texts in lots of about :data:`CHUNK` bytes, with the first one's place."""
    lot: list[bytes] = []
    at = size = 0
    for k, t in enumerate(texts):
        body = (t or "").encode("utf-8", "replace").lower()
        if lot and size + len(body) > CHUNK:
            yield at, lot
            at, lot, size = k, [], 0
        lot.append(body)
        size += len(body) + 1
    if lot:
        yield at, lot


def rows_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` words in a row."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` words in a row.

    A text with fewer words has one, of all its words; one without words has none.
    """
    for _, bodies in chunks(texts):
        _, _, _, hashes, first = words(bodies)
        rows = rows_of(hashes, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                own = np.sort(rows[a : b - width + 1])
                keep = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif b > a:
                yield mix(rows_of(hashes[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
