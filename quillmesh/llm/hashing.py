"""Prefix polynomial hashes of byte strings, modulo 2^64, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _byte_values() -> np.ndarray:
    """An odd 64-bit number for each byte, from a multiplicative sequence."""
    with np.errstate(over="ignore"):
        v = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(32)
    return v | np.uint64(1)


BYTE_VALUES = _byte_values()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def forget() -> None:
    """Drop the table of powers; the next task makes its own."""
    _powers.clear()


class PrefixHash:
    """Hash of any substring of `raw` in constant time."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw = raw
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[raw] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + lengths] - self.sums[starts]) * self.down[starts]

    def every(self, length: int) -> np.ndarray:
        """The hash of each substring of this length."""
        n = len(self.raw) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    if len(values) < width:
        return values[:0]
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
