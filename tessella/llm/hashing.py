"""Hashes of many byte ranges of one buffer, from one running sum.

S[i] is the sum of code(byte j) * B^j over j < i, modulo 2^64, so (S[e] - S[s]) * B^-s is a hash of
bytes s to e that does not depend on where they stand. B is odd and thus has an inverse.
"""

from __future__ import annotations

import numpy as np

B = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(B), -1, 1 << 64))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatter 64-bit values; equal values stay equal, different ones different."""
    h = h + np.uint64((0x632BE59BD9B4E019 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


CODES = mix(np.arange(256, dtype=np.uint64), 7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Powers that a process keeps; those of a longer text are made for it alone.
KEPT = 8 << 20
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) >= n:
        return _powers[name]
    steps = np.full(max(n, 1 << 20), base, np.uint64)
    steps[0] = 1
    grown = np.cumprod(steps, dtype=np.uint64)
    if n <= KEPT:
        _powers[name] = grown
    return grown


def running(buf: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """S, with n + 1 entries."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * powers(len(buf)), dtype=np.uint64, out=out[1:])
    return out


def powers(n: int) -> np.ndarray:
    return _grown("up", B, n)[:n]


def inverses(n: int) -> np.ndarray:
    return _grown("down", INVERSE, n)[:n]


def ranges(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end); the ranges' lengths are not part of it."""
    return (s[ends] - s[starts]) * inverses(len(s))[starts]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a text's border: starts and ends."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = offs[(offs > 0) & (offs < n)]
    first[borders] = inside[borders]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[borders - 1] = inside[borders - 1]
    return starts, np.flatnonzero(last) + 1
