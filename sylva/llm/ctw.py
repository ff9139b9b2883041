"""Context-tree weighting of bytes, eight binary decisions each.

A byte is eight decisions; a decision's node is the bits before it. For each node there is a tree of contexts: the last
0, 1, ... depth bytes. A context holds the counts of zeros and ones, KT gives their block probability Pe, and with
the children's product the weighted probability is Pw = (Pe + prod Pw(child)) / 2, at the full depth Pw = Pe. The
model of the training texts is fixed; a decision's probability mixes all depths along its path,
P = s * KT + (1 - s) * P(child) with s = Pe / (2 * Pw), and unseen contexts say 1/2.
"""

from __future__ import annotations

import numpy as np

_HALF_LOG_2PI = 0.5 * np.log(2 * np.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2, by Stirling's series from x + 8 on."""
    x = np.asarray(x, np.float64)
    less = np.ones_like(x)
    for k in range(8):
        less = less * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + _HALF_LOG_2PI + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(less)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def grams(raw: bytes, depth: int) -> np.ndarray:
    """For each byte of a text the number c1 c2 ... c_depth x: the bytes before it, the nearest first, and itself.

    Before the text's start stand zero bytes.
    """
    b = np.frombuffer(b"\0" * depth + raw, np.uint8).astype(np.uint64)
    n = len(raw)
    out = b[depth:].copy()
    for k in range(1, depth + 1):
        out |= b[depth - k : depth - k + n] << np.uint64(8 * (depth + 1 - k))
    return out


class Shard:
    """All grams (sorted, different) of some contexts of `top` bytes, with counts that may be 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        self.keys, self.counts, self.depth, self.top = keys, counts.astype(np.float64), depth, top
        x = keys & np.uint64(255)
        self.orders = []
        for d in range(top, depth + 1):
            key = keys >> np.uint64(8 * (depth + 1 - d)) << np.uint64(8) | x
            order = np.arange(len(key)) if d == depth else np.argsort(key, kind="stable")
            self.orders.append((order, key[order]))

    def _level(self, level: int):
        """For one decision of a byte and each depth: a node's number for each gram, counts, logs of Pe and Pw."""
        bit = (self.keys >> np.uint64(7 - level) & np.uint64(1)).astype(np.float64)
        ones, total = self.counts * bit, self.counts
        below, out = None, []
        for order, key in reversed(self.orders):
            part = key >> np.uint64(8 - level)
            new = np.concatenate(([True], part[1:] != part[:-1])) if len(part) else np.zeros(0, bool)
            node = np.empty(len(order), np.int64)
            node[order] = np.cumsum(new) - 1
            m = int(new.sum())
            n1 = np.bincount(node, ones, m)
            n0 = np.bincount(node, total, m) - n1
            pe = log_kt(n0, n1)
            if below is None:
                pw = pe
            else:
                first = np.zeros(len(below[1]), np.int64)
                first[below[0]] = node  # the parent's number of each child
                children = np.bincount(first, below[1], m)
                pw = np.logaddexp(pe, children) - np.log(2)
            below = (node, pw)
            out.append((node, n0, n1, pe, pw))
        return out[::-1]

    def tops(self) -> tuple[np.ndarray, np.ndarray]:
        """(top context << 8 | decision node) and log Pw there, of all contexts of `top` bytes."""
        keys, logs = [], []
        shift = np.uint64(8 * (self.depth + 1 - self.top))
        for level in range(8):
            node, *_, pw = self._level(level)[0]
            first = np.zeros(len(pw), np.int64)
            first[node] = np.arange(len(node))
            context = self.keys[first] >> shift
            prefix = (self.keys[first] & np.uint64(255)) >> np.uint64(8 - level) | np.uint64(1 << level)
            keys.append(context << np.uint64(8) | prefix)
            logs.append(pw)
        return np.concatenate(keys), np.concatenate(logs)

    def log_probabilities(self, low: tuple[np.ndarray, ...]) -> np.ndarray:
        """Natural log of P(x | context) for each gram; low is from low_tables(), and reaches to depth top - 1."""
        out = np.zeros(len(self.keys))
        shift = np.uint64(8 * (self.depth + 1 - self.top))
        context = (self.keys >> shift).astype(np.int64)
        x = (self.keys & np.uint64(255)).astype(np.int64)
        for level in range(8):
            one = (x >> (7 - level) & 1).astype(bool)
            p = None
            for d, (node, n0, n1, pe, pw) in reversed(list(enumerate(self._level(level), self.top))):
                kt = (np.where(one, n1[node], n0[node]) + 0.5) / (n0[node] + n1[node] + 1.0)
                stay = np.exp(pe - pw - np.log(2))[node]
                p = kt if d == self.depth else stay * kt + (1 - stay) * p
            q = x >> (8 - level) | 1 << level
            for d in range(self.top - 1, -1, -1):
                upper = context >> 8 * (self.top - d)
                stay, p1, place = low[d]
                at = (upper if place is None else place[upper]) * 256 + q
                stay, p1 = stay[at], p1[at]
                p = stay * np.where(one, p1, 1 - p1) + (1 - stay) * p
            out += np.log(p)
        return out


def _tables(byte: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts' log Pw by node, weight s and KT's probability of a one, of their counts by byte and children's sums by node."""
    n = np.zeros((len(byte), 512))
    n[:, 256:] = byte
    for q in range(255, 0, -1):
        n[:, q] = n[:, 2 * q] + n[:, 2 * q + 1]
    n0, n1 = np.zeros((len(byte), 256)), np.zeros((len(byte), 256))
    n0[:, 1:], n1[:, 1:] = n[:, 2:512:2], n[:, 3:512:2]
    pe = log_kt(n0, n1)
    pw = np.logaddexp(pe, below) - np.log(2)
    return pw, np.exp(pe - pw - np.log(2)).ravel(), ((n1 + 0.5) / (n0 + n1 + 1.0)).ravel()


def low_tables(counts: np.ndarray, tops: np.ndarray, heavy: np.ndarray, heavy_counts: np.ndarray, heavy_tops: np.ndarray):
    """The shallow contexts, which shards share: for depth 0 to 2 the weight s, KT's probability of a one, and places.

    counts: training counts by (nearest byte, byte); tops: sums by (nearest byte, node) of log Pw over those contexts of
    two bytes that aren't split. heavy: the split contexts of two bytes; heavy_counts and heavy_tops: the same
    for (place in heavy, byte or node), the sums over contexts of three bytes.
    """
    below, byte = tops.reshape(256, 256).copy(), counts.reshape(256, 256).astype(np.float64)
    pw, *two = _tables(heavy_counts.reshape(-1, 256).astype(np.float64), heavy_tops.reshape(-1, 256))
    np.add.at(below, heavy >> 8, pw)
    place = np.zeros(1 << 16, np.int64)
    place[heavy] = np.arange(len(heavy))
    pw, *one = _tables(byte, below)
    _, *none = _tables(byte.sum(axis=0, keepdims=True), pw.sum(axis=0, keepdims=True))
    return (*none, None), (*one, None), (*two, place)
