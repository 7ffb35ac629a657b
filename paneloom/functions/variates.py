"""Seeded variates for work inside tasks.

A generator is a function of (seed, key), so a draw is the same on any partitioning and after a lost executor; it does
not depend on which rows a task happens to hold. Streams are those of the installed numpy.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

_WORD = 64
_FEW_TRIALS = 4 * _WORD


def generator(seed: int, *key, kind: type | None = None) -> np.random.Generator:
    """A generator of its own for every key: counter-based, or of another kind of numpy's, seeded from the key."""
    name = int.from_bytes(hashlib.sha256("|".join(map(str, (seed, *key))).encode()).digest()[:16], "big")
    return np.random.Generator(np.random.Philox(key=name) if kind is None else kind(name))


def heads(rng: np.random.Generator, trials: int, size: int) -> np.ndarray:
    """`size` binomial variates of fair trials: bits are counted for few trials, numpy's exact rejection serves many."""
    if trials > _FEW_TRIALS:
        return rng.binomial(trials, 0.5, size)
    out = np.zeros(size, dtype=np.int64)
    for left in range(trials, 0, -_WORD):
        words = rng.integers(0, 1 << 64, size, dtype=np.uint64, endpoint=False)
        if left < _WORD:
            words &= np.uint64((1 << left) - 1)
        out += np.bitwise_count(words)
    return out


class Digests:
    """First 32 bits of md5(prefix + key) of many keys at once: what draws.digest and draws.bits32 give.

    Every key takes one md5 block with the prefix; the rounds run over arrays of keys. Longer ones go to hashlib.
    """

    _SHIFTS = np.array([(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)], dtype=np.uint32)
    _SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], dtype=np.uint32)
    _START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        self.lengths = np.array([len(k) for k in keys], dtype=np.int64)
        self._blocks: dict[int, np.ndarray | None] = {}

    def _block(self, offset: int) -> np.ndarray | None:
        """(16, keys): the words of the block with the keys behind `offset` zero bytes, or None if one does not fit."""
        if offset not in self._blocks:
            longest = int(self.lengths.max(initial=0))
            self._blocks.clear()  # prefixes come in the order of their lengths
            self._blocks[offset] = None
            if offset + longest <= 55:
                raw = np.zeros((len(self.keys), 64), dtype=np.uint8)
                raw[:, offset:offset + longest] = np.frombuffer(
                    b"".join([k.ljust(longest, b"\0") for k in self.keys]), dtype=np.uint8).reshape(len(self.keys), longest)
                raw[np.arange(len(raw)), offset + self.lengths] = 0x80
                words = np.ascontiguousarray(raw.view("<u4").T)
                words[14] = (offset + self.lengths) * 8
                self._blocks[offset] = words
        return self._blocks[offset]

    def words(self, prefix: bytes) -> np.ndarray:
        block = self._block(len(prefix))
        if block is None:
            head = hashlib.md5(prefix)
            return np.array([int.from_bytes(_rest(head, k)[:4], "big") for k in self.keys], dtype=np.uint32)
        front = np.frombuffer(prefix.ljust(-len(prefix) % 4 + len(prefix), b"\0"), dtype="<u4").astype(np.uint32)
        filled = [block[i] + front[i] if i < len(front) else block[i] if block[i].any() else None for i in range(16)]
        a, b, c, d = (np.full(block.shape[1], x, dtype=np.uint32) for x in self._START)
        mix, high = np.empty_like(a), np.empty_like(a)
        for i in range(61):  # the last three rounds do not reach the first word
            turn, place = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
            if turn == 0:
                np.bitwise_and(np.bitwise_xor(c, d, out=mix), b, out=mix)
                mix ^= d
            elif turn == 1:
                np.bitwise_and(np.bitwise_xor(b, c, out=mix), d, out=mix)
                mix ^= c
            elif turn == 2:
                np.bitwise_xor(np.bitwise_xor(b, c, out=mix), d, out=mix)
            else:
                np.bitwise_or(np.invert(d, out=mix), b, out=mix)
                mix ^= c
            mix += a
            mix += self._SINES[i]
            if filled[place] is not None:
                mix += filled[place]
            by = self._SHIFTS[turn, i % 4]
            np.left_shift(mix, by, out=high)
            np.right_shift(mix, np.uint32(32) - by, out=mix)
            high |= mix
            high += b
            a, b, c, d, high = d, high, b, c, a
        return (b + self._START[0]).byteswap()


def _rest(head, rest: bytes) -> bytes:
    own = head.copy()
    own.update(rest)
    return own.digest()


def share_of(rng: np.random.Generator, draws: np.ndarray, part: int, whole: int) -> np.ndarray:
    """How many of `draws` uniform draws from `whole` units fall on a part of them."""
    return draws * (part == whole) if part in (0, whole) else rng.binomial(draws, part / whole)


def descend(seed: int, block: int, totals: np.ndarray, sizes: list[int], leaf: int) -> np.ndarray:
    """Draws that fall on one of a power of two of leaves, by seeded splits from the root down.

    `sizes` are the units of each leaf. Every task that passes a node splits its draws alike, so the draws of the
    leaves add up to the totals without any of them being sent.
    """
    low, high = 0, len(sizes)
    while high - low > 1:
        middle = (low + high) // 2
        whole, left = sum(sizes[low:high]), sum(sizes[low:middle])
        first = share_of(generator(seed, "split", block, low, high), totals, left, whole)
        if leaf < middle:
            totals, high = first, middle
        else:
            totals, low = totals - first, middle
    return totals


def spread_draws(rng: np.random.Generator, draws: np.ndarray, units: int) -> np.ndarray:
    """(replicates, units): the draws of every replicate dealt uniformly over units."""
    rep = np.repeat(np.arange(len(draws)), draws)
    place = rep * units + rng.integers(0, units, len(rep))
    return np.bincount(place, minlength=len(draws) * units).reshape(len(draws), units)
