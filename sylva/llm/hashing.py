"""Hashes of words and word n-grams, computed for a whole text at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1 << 61, 1 << 63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2 to the 64th."""
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, 1 << 16), np.uint64(_BASE & (1 << 64) - 1 if which == "up" else _INVERSE))
        step[0] = 1
        have = _powers[which] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, and where its words (runs without the bytes 20 and 09 to 0D) begin and end."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_SPACE[b]
    change = np.diff(inside)
    return b, np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. Texts are hashed in pieces of a few MB, cut between words."""
    out, limit = [], 4 << 20
    while len(raw) > limit:
        cut = max(raw.rfind(c, 0, limit) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= 0:
            limit *= 2
            continue
        out.append(word_hashes(raw[:cut]))
        raw = raw[cut:]
    b, starts, ends = word_spans(raw)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power("up", len(b)), out=sums[1:])
    out.append(mix((sums[ends] - sums[starts]) * _power("down", len(b) + 1)[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out)


def shingles(raw: bytes, n: int = 5) -> np.ndarray:
    """The set of hashes of n consecutive words, sorted. A text of fewer words has one, of all its words."""
    w = word_hashes(raw)
    if not len(w):
        return w
    n = min(n, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total = total * _MIX[0] + w[k : len(w) - n + 1 + k]
    return np.unique(mix(total + np.uint64(n)))
