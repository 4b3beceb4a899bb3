"""A minimal perfect hash over 64-bit keys, as levels of bit arrays with ranks."""

from __future__ import annotations

import numpy as np

_WORD = 64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0..n-1, without keeping the keys.

    Each level is a bit array of ``gamma`` bits a key; a key that is alone at its place
    sets the bit, the others go to the next level. The slot is the number of set bits
    before. Keys that were not built in get any slot or -1: compare a stored fingerprint.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.bitwise_count(x).astype(np.int64) for x in levels]
        starts = np.cumsum([0, *(int(x.sum()) for x in ones)])
        self.ranks = [s + np.concatenate([[0], np.cumsum(x)[:-1]]) if len(x) else x for s, x in zip(starts, ones, strict=False)]
        self.size = int(starts[-1])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 64) -> PerfectHash:
        keys = keys.astype(np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        levels = []
        while len(keys):
            if len(levels) == most:
                raise ValueError("keys do not separate")
            m = max(1, int(np.ceil(gamma * len(keys) / _WORD))) * _WORD
            at = mix(keys, len(levels)) % np.uint64(m)
            places, counts = np.unique(at, return_counts=True)
            alone = places[counts == 1]
            bits = np.zeros(m // _WORD, dtype=np.uint64)
            np.bitwise_or.at(bits, (alone >> np.uint64(6)).astype(np.int64), np.uint64(1) << (alone & np.uint64(63)))
            levels.append(bits)
            keys = keys[~np.isin(at, alone)]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = mix(keys[left], k) % np.uint64(len(bits) * _WORD)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (bits[word] >> bit) & np.uint64(1) == 1
            before = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[there]] = (ranks[word] + np.bitwise_count(before).astype(np.int64))[there]
            left = left[~there]
        return out
