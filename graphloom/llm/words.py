"""Words of a text and fingerprints of runs of words, vectorised over one document at a time.

A word is a run of bytes outside the six ASCII blanks (space, tab, line feed, vertical tab, form feed, carriage
return), which is what ``bytes.split()`` returns. A word's fingerprint is a 64-bit polynomial hash of its bytes and a
run's one of its words' fingerprints: equal runs get equal values whatever blanks stood between the words, and all runs of
a text are read off two prefix sums.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(2**60, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.isin(np.arange(256), np.frombuffer(b"\x20\t\n\v\f\r", np.uint8))
_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, factor in (("_powers", _BASE), ("_inverse_powers", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverse_powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Fingerprints of the runs of words of one text."""

    def __init__(self, text: bytes | None):
        raw = np.frombuffer(text or b"", np.uint8)
        blank = np.ones(len(raw) + 2, bool)
        np.take(_BLANK, raw, out=blank[1:-1])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        self.n = len(starts)
        powers, back = _grown(len(raw) + 1)
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers[: len(raw)], out=prefix[1:])
        lengths = (ends - starts).astype(np.uint64)
        self._words = mix((prefix[ends] - prefix[starts]) * back[starts] ^ lengths * np.uint64(0x9E3779B97F4A7C15))
        self._sums: np.ndarray | None = None

    def hashes(self, size: int) -> np.ndarray:
        """Fingerprint of each run of ``size`` consecutive words, in order; empty if there are fewer words."""
        count = self.n - size + 1
        if count <= 0 or not size:
            return np.zeros(0, np.uint64)
        if size == 1:
            return self._words
        powers, back = _grown(self.n + 1)
        if self._sums is None:
            self._sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self._words * powers[: self.n], out=self._sums[1:])
        return mix((self._sums[size:] - self._sums[:count]) * back[:count] + np.uint64(size))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
