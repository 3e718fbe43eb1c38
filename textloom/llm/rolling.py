"""Rolling hashes over bytes, vectorised: hashes of all substrings of one length, minimizers and runs of windows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0xA24BAED4963EE407 | 1
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Prefix sums of a polynomial hash; hashes of substrings by position and length."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(12, int(len(data) + 1).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=self.sums[1:])

    def all_of(self, length: int) -> np.ndarray:
        """Hash of the substring of ``length`` at each position."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.down[start])


def window_runs(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer: (first window, windows, minimizer's offset, its hash,
    hash of the run).

    A window's minimizer is its leftmost gram with the least hash, so equal windows have equal minimizers at the same
    offset. The hash of a run covers its bytes, its length and the minimizer's offset. ``data`` has at most 2**20 windows.
    """
    n = len(data) - window + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = Rolling(data)
    grams = rolling.all_of(gram)
    width = window - gram + 1
    low = np.uint64((1 << 21) - 1)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(keyed) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keyed)] = keyed
    forward = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).ravel()
    backward = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n]) & low
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.append(first, n))
    at = least[first].astype(np.int64)
    run = mixed(rolling.at(first, count + window - 1) ^ mixed((at - first).astype(np.uint64) * np.uint64(1 << 20) + count.astype(np.uint64)))
    return first, count, at - first, grams[at], run
