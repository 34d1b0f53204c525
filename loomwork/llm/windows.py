"""Vectorised hashing of byte strings: rolling windows, content-defined cuts, minimisers."""

from __future__ import annotations

import numpy as np

#: Odd bases of the two polynomial hashes modulo 2**64, and the inverse of each.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(12, (n - 1).bit_length()), dtype=np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order says nothing about their bytes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of substrings of one byte string by one polynomial: ``of(starts, length)``."""

    def __init__(self, raw: np.ndarray, which: int = 0) -> None:
        n = len(raw)
        self.n = n
        self.back = _powers(INVERSES[which], n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASES[which], n + 1)[:n], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """The hash at every start."""
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self.sums[length:] - self.sums[:m]) * self.back[:m]

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * self.back[starts]


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` consecutive grams the least mixed gram hash."""
    return sliding(grams, width, np.minimum) if len(grams) >= width else np.zeros(0, dtype=grams.dtype)


def chosen_grams(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the least of some window; windows marked 0 in ``least`` don't count."""
    padded = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    return np.flatnonzero((sliding(padded, width, np.maximum) == grams) & (grams > 0))


def cuts(raw: np.ndarray, context: int = 32, mean: int = 256, longest: int = 4096) -> np.ndarray:
    """Starts of content-defined chunks: 0, then behind each run of ``context`` bytes whose hash says so;
    chunks over ``longest`` bytes are cut again at that length."""
    h = mixed(Rolling(raw).all(context))
    at = np.flatnonzero((h & np.uint64(mean - 1)) == 0) + context
    at = np.unique(np.concatenate([[0], at[at < len(raw)]])) if len(raw) else np.zeros(0, dtype=np.int64)
    if len(at) and (gaps := np.diff(np.append(at, len(raw)))).max() > longest:
        at = np.concatenate([np.arange(a, a + g, longest) for a, g in zip(at, gaps)])
    return at
