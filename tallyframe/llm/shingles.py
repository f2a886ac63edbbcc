"""Word shingles and SetSketch registers, computed on arrays."""

from __future__ import annotations

import numpy as np
import xxhash

GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two multiplications between xor-shifts."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased, words are cut at space, tab, line feed, vertical tab, form feed and carriage
    return. A text with fewer words is one shingle, one without words has none.
    """
    found = (text or "").encode().lower().split()  # of bytes: the ASCII letters and white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = mixed(h[:n] + GOLD)
    for k in range(1, min(words, len(h))):
        out = mixed(out * GOLD + h[k : k + n])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class SetSketch:
    """Registers of exponentially spaced, truncated minima.

    Each element starts a Poisson process that hits a register at random; a register keeps the first hit
    of any element, so the registers of a union are the register-wise maxima of the (decreasing) levels.
    The time t of that hit is stored as the level ``offset - log_base(t)``, cut to one byte.
    """

    def __init__(self, registers: int, base: float = 1.2, offset: int = 24):
        self.m, self.base, self.offset = registers, base, offset

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of levels for each set; an empty set has zeros."""
        out = np.zeros((len(sets), self.m), np.uint8)
        todo = [i for i, s in enumerate(sets) if len(s)]
        reach = np.log(self.m) + 5
        while todo:  # until no register is empty
            firsts = self._firsts([sets[i] for i in todo], reach)
            full = np.isfinite(firsts).all(1)
            levels = np.floor(self.offset - np.log(firsts[full]) / np.log(self.base))
            out[[i for i, ok in zip(todo, full, strict=True) if ok]] = np.clip(levels, 0, 255)
            todo = [i for i, ok in zip(todo, full, strict=True) if not ok]
            reach *= 2
        return out

    def _firsts(self, sets: list[np.ndarray], reach: float) -> np.ndarray:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        until = reach / sizes
        element, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        time = np.zeros(len(element))
        firsts = np.full(len(sets) * self.m, np.inf)
        step = 0
        while len(element):
            step += 1
            bits = mixed(element + np.uint64(step * int(GOLD) % 2**64))
            time -= np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / self.m
            on = time < until[own]
            element, own, time, bits = element[on], own[on], time[on], bits[on]
            at = ((bits & np.uint64(0xFFF)) * np.uint64(self.m)) >> np.uint64(12)
            np.minimum.at(firsts, own * self.m + at.astype(np.int64), time)
        return firsts.reshape(len(sets), self.m)

    def _p(self, x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / np.log(self.base)

    def estimate(self, over: np.ndarray, under: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """The similarity of highest likelihood, from how many registers of a are over and under those of b."""
        u = size_a / (size_a + size_b)
        v = 1 - u
        same = self.m - over - under
        tiny = 1e-12

        def likelihood(j: np.ndarray) -> np.ndarray:
            p, q = self._p(u - v * j), self._p(v - u * j)
            return over * np.log(p + tiny) + under * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)

        low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
        for _ in range(40):  # the likelihood has one peak
            a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
            up = likelihood(a) < likelihood(b)
            low, high = np.where(up, a, low), np.where(up, high, b)
        return (low + high) / 2
