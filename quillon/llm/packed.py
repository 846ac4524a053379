"""Hashes of words and windows, and their exchange in packed form.

A shuffle row that holds one 8-byte hash costs several times its size. Here a task sends, for each
target, one row with all its hashes as a byte string, low bytes of all values first; sorted values
then compress well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_WORD = xxhash.xxh3_64_intdigest
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD, words), np.uint64, len(words))


def rolling(x: np.ndarray, n: int, odd: int = int(_ODD)) -> np.ndarray:
    """A hash of every n neighbours of x."""
    size = max(0, len(x) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(odd) + x[k : k + size]
    return mix(out)


def pack(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of every value, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of every distinct key, places in order."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, edges):
        yield int(keys[places[0]]), places


def inside(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Flags: which of x are in the sorted array held."""
    if not len(held):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(held, x), len(held) - 1)
    return held[at] == x
