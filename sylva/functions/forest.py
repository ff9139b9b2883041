"""The trees of many texts at once, as flat arrays by node: RowTree's reading, heads and spans in numpy.

Texts are cut in one pass over their bytes. A text of the plain shape (labelled brackets; under each of them phrases or one
word) is read that way; whatever else RowTree accepts (a root without a label, empty phrases, several words) is read by it
and joined to the others, so both agree on every text.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sylva.functions import heads
from sylva.functions.rowtree import EMPTY, PUNCTUATION, ROOTS, RowTree, simple_label

_KIND = np.zeros(256, np.uint8)
_KIND[[*range(9, 14), *range(28, 33)]], _KIND[ord("(")], _KIND[ord(")")] = 1, 2, 3
_WORD, _OPEN, _CLOSE, _NONE = 0, 2, 3, 4
_FAR_SPACE = re.compile(r"[^\S\x00-\x7f]")
_BITS = 40  # of a node's number in a key


def strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """The pieces of a byte buffer; null where mask is."""
    size = (end - begin).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
    out = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken.tobytes()))
    return out if mask is None else out.take(pa.array(np.arange(len(size)), pa.int64(), mask=mask))


class Forest:
    """row: each tree's text; first: its first node, and after the last tree the number of nodes. By node: tree, parent (-1 at
    roots, else its number among all nodes), depth, start and finish in words of its tree, code (of its label in `names`), leaf,
    and word (null at phrases)."""

    def __init__(self, row, first, parent, start, finish, code, names: list[str], word: pa.Array, leaf) -> None:
        self.row, self.first, self.parent, self.start, self.finish = row, first, parent, start, finish
        self.code, self.names, self.word, self.leaf = code, names, word, leaf

    def __len__(self) -> int:
        return len(self.parent)

    # --- reading

    @classmethod
    def read(cls, texts: pa.Array, normal: bool = False, simple: bool = False) -> Forest:
        """The trees of those texts that are one tree each; normal: without empties and function tags; simple: without the latter."""
        texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.string()).fill_null("")
        marks = _Marks(texts)
        plain = marks.plain()
        odd = [(int(i), t) for i in np.flatnonzero(~plain & (marks.count > 0)) if (t := RowTree.read(texts[int(i)].as_py())) is not None]
        if normal:
            odd = [(i, n) for i, t in odd if (n := t.normal()) is not None]
        out = marks.forest(plain)
        out = out.normal() if normal else out
        if odd:
            out = out._with(odd)
        if simple and not normal:
            out.relabel(simple_label)
        return out

    def relabel(self, change) -> None:
        new: dict[str, int] = {}
        to = np.array([new.setdefault(change(x), len(new)) for x in self.names] or [0], np.int32)
        self.code, self.names = to[self.code] if len(self.code) else self.code, list(new)

    def _with(self, odd: list[tuple[int, RowTree]]) -> Forest:
        """With more trees, read one at a time."""
        numbers = {x: i for i, x in enumerate(self.names)}
        n, at = len(self), [len(self)]
        parts: list[list] = [[], [], [], [], [], []]
        for _, t in odd:
            base = at[-1]
            for p, values in zip(parts, ([p + base if p >= 0 else -1 for p in t.parent], t.start, t.finish, [numbers.setdefault(x, len(numbers)) for x in t.label], t.word, [w is not None for w in t.word]), strict=True):
                p += values
            at.append(base + len(t))
        join = lambda a, b, kind: np.concatenate([a, np.array(b, kind)])
        word = pa.concat_arrays([self.word, pa.array(parts[4], pa.string())])
        return Forest(join(self.row, [i for i, _ in odd], np.int64), join(self.first[:-1] if n or len(self.first) else [], at, np.int64), join(self.parent, parts[0], np.int64), join(self.start, parts[1], np.int64),
                      join(self.finish, parts[2], np.int64), join(self.code, parts[3], np.int32), list(numbers), word, join(self.leaf, parts[5], bool))

    def normal(self) -> Forest:
        """What the ranker sees: nodes with words in them, labels without function tags. (Of plain trees.)"""
        keep = self.finish > self.start
        new = np.cumsum(keep) - 1
        counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[self.first])
        parent = self.parent[keep]
        out = Forest(self.row[counts > 0], np.concatenate([[0], np.cumsum(counts[counts > 0])]), np.where(parent >= 0, new[parent], -1) if len(parent) else parent, self.start[keep],
                     self.finish[keep], self.code[keep], self.names, self.word.filter(pa.array(keep)), self.leaf[keep])
        out.relabel(simple_label)
        return out

    def without_unary_repeats(self) -> Forest:
        """Phrases that are an only child with their parent's label give their children to the parent."""
        up, at = np.maximum(self.parent, 0), np.arange(len(self))
        gone = (self.parent >= 0) & ~self.leaf & (np.diff(self.kids[1])[up] == 1) & (self.code == self.code[up])
        to = np.where(gone, up, at)
        while ((new := to[to]) != to).any():
            to = new
        counted = np.concatenate([[0], np.cumsum(~gone)])
        parent = np.where(self.parent >= 0, counted[to[up]], -1)[~gone]
        return Forest(self.row, counted[self.first], parent, self.start[~gone], self.finish[~gone], self.code[~gone], self.names, self.word.filter(pa.array(~gone)), self.leaf[~gone])

    # --- writing

    def write(self, labels: pa.Array | None = None) -> pa.Array:
        """The bracketed text of each tree, with other labels by node if these are given."""
        if not len(self):
            return pa.array([], pa.string())
        out = np.ones(len(self), bool)
        for k in np.flatnonzero(self.leaf & (np.diff(self.kids[1]) > 0)):  # what stands below a word isn't written
            out[k + 1 : self.last[k] + 1] = False
        depth, n = self.depth[out], int(out.sum())
        bounds = np.concatenate([[0], np.cumsum(out)])[self.first]
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        closes = depth + 1 - np.where(first[1:], 0, np.append(depth[1:], 0))
        opened = pa.array(["(", " ("]).take(pa.array((~first[:-1]).astype(np.int64)))
        label, word = (x.filter(pa.array(out)) if n < len(self) else x for x in (self.label if labels is None else labels, self.word))
        closed = pa.array([")" * i for i in range(int(closes.max()) + 1)]).take(pa.array(closes))
        parts = pc.binary_join_element_wise(opened, label, pc.fill_null(pc.binary_join_element_wise("", word, " "), ""), closed, "")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), "")

    # --- what follows from the arrays

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def tree(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row)), self.sizes)

    @cached_property
    def base(self) -> np.ndarray:
        """By node the first node of its tree."""
        return np.repeat(self.first[:-1], self.sizes)

    @cached_property
    def depth(self) -> np.ndarray:
        up = np.append(np.where(self.parent >= 0, self.parent, len(self)), len(self))
        step = (up < len(self)).astype(np.int32)  # steps up, doubled until all are at the root
        while (up < len(self)).any():
            step, up = step + step[up], up[up]
        return step[:-1]

    @cached_property
    def kids(self) -> tuple[np.ndarray, np.ndarray]:
        """All children in the order of their parents, and where each node's begin (and the end)."""
        has = np.flatnonzero(self.parent >= 0)
        order = has[np.argsort(self.parent[has], kind="stable")]
        return order, np.concatenate([[0], np.cumsum(np.bincount(self.parent[has], minlength=len(self)))])

    @cached_property
    def last(self) -> np.ndarray:
        """The last node of each subtree: the one before the next node that is no deeper."""
        order, begin = self.kids
        to = np.arange(len(self))
        inner = np.flatnonzero(np.diff(begin))
        to[inner] = order[begin[inner + 1] - 1]  # the last child, and its last child
        while ((new := to[to]) != to).any():
            to = new
        return to

    @cached_property
    def before(self) -> np.ndarray:
        """The sibling to the left, -1 for none."""
        order, _ = self.kids
        out = np.full(len(self), -1)
        same = self.parent[order[1:]] == self.parent[order[:-1]]
        out[order[1:][same]] = order[:-1][same]
        return out

    def is_code(self, labels) -> np.ndarray:
        """By node, whether its label is one of these."""
        return np.array([x in labels for x in self.names] or [False])[self.code] if len(self) else np.zeros(0, bool)

    @cached_property
    def punct(self) -> np.ndarray:
        return self.leaf & self.is_code(PUNCTUATION)

    @cached_property
    def is_leaf(self) -> np.ndarray:
        """Preterminals with a width."""
        return self.leaf & ~self.is_code([EMPTY])

    @property
    def label(self) -> pa.Array:
        return pa.DictionaryArray.from_arrays(pa.array(self.code, pa.int32()), pa.array(self.names, pa.string())).cast(pa.string())

    def labels_at(self, nodes: np.ndarray, other: str | None = None) -> pa.Array:
        """Labels of these nodes; `other` for -1."""
        names = pa.array([*self.names, other], pa.string())
        codes = np.append(self.code, len(self.names)).astype(np.int32)
        return names.take(pa.array(codes[nodes]))

    def heads(self, rule: str) -> np.ndarray:
        """The head child of each node by a rule of sylva.functions.heads, -1 where there's none."""
        order, at = self.kids
        key = heads.keys(rule, self.names)
        out = np.full(len(self), -1, np.int64)
        if not len(order):
            return out
        up = self.parent[order]
        score, left = (x[self.code[up], self.code[order]] for x in key)
        if rule != "first":  # without a child of a tier the last tag, else the last phrase, but punctuation
            left = left & (score >= 0)
            score = np.where((score < 0) & ~self.punct[order], np.where(self.leaf[order], 1000, 1001), score)
            alone = (np.diff(at)[up] == 1) & self.is_code([EMPTY])[order]
            score = np.where(alone, 0, score)
        low = np.where(left, order, (1 << _BITS) - 1 - order)
        keyed = np.where(score < 0, np.iinfo(np.int64).max, (score.astype(np.int64) * 2 + ~left << _BITS) + low)
        parents = np.flatnonzero(np.diff(at))
        least = np.minimum.reduceat(keyed, at[parents])
        node, is_left = least & ((1 << _BITS) - 1), (least >> _BITS) % 2 == 0
        out[parents] = np.where(least == np.iinfo(np.int64).max, -1, np.where(is_left, node, (1 << _BITS) - 1 - node))
        return out

    def lexical(self, own: np.ndarray) -> np.ndarray:
        """The preterminal at the end of each node's chain of head children, -1 if it breaks off."""
        n = len(self)
        to = np.append(np.where(self.leaf, np.arange(n), np.where(own >= 0, own, n)), n)
        while True:
            new = to[to]
            if (new == to).all():
                return np.where(to[:-1] == n, -1, to[:-1])
            to = new

    def lists(self, values: pa.Array | np.ndarray, chosen: np.ndarray | None = None) -> pa.Array:
        """A list for each tree of the values by node, or of the nodes that a mask chooses."""
        values = values if isinstance(values, pa.Array) else pa.array(values.astype(bool if values.dtype == bool else np.int32))
        if chosen is None:
            return pa.ListArray.from_arrays(pa.array(self.first, pa.int32()), values)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(chosen)])[self.first], pa.int32()), values.filter(pa.array(chosen)))

    def local(self, nodes: np.ndarray) -> np.ndarray:
        """Numbers of nodes in their trees, by node; -1 stays."""
        return np.where(nodes >= 0, nodes - self.base, -1)


class _Marks:
    """Brackets and words of all texts."""

    def __init__(self, texts: pa.Array) -> None:
        data, offsets = self._bytes(texts)
        if ((data == 0xC2) | (data - 0xE1 < 3)).any() and any(_FAR_SPACE.search(x) for x in texts.to_pylist()):
            data, offsets = self._bytes(pa.array([_FAR_SPACE.sub(" ", x) for x in texts.to_pylist()], pa.string()))
        kind = _KIND[data]
        word = kind == _WORD
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.append(False, word[:-1])[: len(word)] & ~edge[:-1], np.append(word[1:], False)[: len(word)] & ~edge[1:]
        at = np.flatnonzero((word & ~before) | (kind >= _OPEN))
        self.data, self.at, self.what = data, at, kind[at]
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(at, offsets)
        self.count = np.diff(self.bounds)

    @staticmethod
    def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = texts.buffers()
        o = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets is not None and len(texts) else np.zeros(1, np.int64)
        d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
        return d, o - o[0]

    def plain(self) -> np.ndarray:
        """By text, whether it is a tree of the plain shape."""
        w, has = self.what, self.count > 0
        if not len(w):
            return has
        first, last = self.bounds[:-1][has], self.bounds[1:][has] - 1
        level = np.cumsum((w == _OPEN).astype(np.int32) - (w == _CLOSE))
        self.level = level = level - np.repeat(np.append(0, level)[self.bounds[:-1]], self.count)
        was, then = np.append(_NONE, w[:-1]), np.append(w[1:], _NONE)
        was[first], then[last] = _NONE, _NONE
        label = (w == _WORD) & (was == _OPEN)
        bad = (w == _OPEN) & ((then != _WORD) | ((level == 1) & (was != _NONE))) | (level < 0) | ((level == 0) != (then == _NONE))
        bad |= label & (then != _WORD) & (then != _OPEN) | (w == _WORD) & ~label & ~((was == _WORD) & np.append(False, label[:-1]) & (then == _CLOSE))
        out = has.copy()
        out[has] = np.add.reduceat(bad, first) == 0
        return out

    def forest(self, plain: np.ndarray) -> Forest:
        keep = np.repeat(plain, self.count)
        opens = (self.what == _OPEN) & keep
        o, c = np.flatnonzero(opens), np.flatnonzero((self.what == _CLOSE) & keep)
        n, rows = len(o), np.flatnonzero(plain)
        if not n:
            none = np.zeros(0, np.int64)
            return Forest(none, np.zeros(1, np.int64), none, none, none, none.astype(np.int32), [], pa.array([], pa.string()), none.astype(bool))
        first = np.append(0, np.cumsum(opens))[np.append(self.bounds[:-1][rows], self.bounds[rows[-1] + 1])]
        nth = np.cumsum(self.what == _WORD) - 1
        labels = strings(self.data, self.at[o + 1], self.ends[nth[o + 1]]).dictionary_encode()
        leaf, mark = self.what[o + 2] == _WORD, o + 2
        begin = self.at[mark]
        word = strings(self.data, begin, np.where(leaf, self.ends[nth[mark]], begin), ~leaf)
        names, code = labels.dictionary.to_pylist(), labels.indices.to_numpy().astype(np.int32)
        out_names = {x: i for i, x in enumerate(names)}
        for root in set(ROOTS[1:]) & set(names):
            code[first[:-1][code[first[:-1]] == out_names[root]]] = out_names.setdefault(ROOTS[0], len(out_names))
        wide = leaf & (code != out_names.get(EMPTY, -1))
        level, total = self.level[o] - 1, np.cumsum(wide)
        inner, outer = np.argsort(level, kind="stable"), np.argsort(self.level[c], kind="stable")
        last = np.empty(n, np.int64)
        last[inner] = (np.cumsum(opens)[c] - 1)[outer]  # on each level the brackets close in the order they open
        keys = level[inner] * np.int64(n) + inner
        parent = np.where(level > 0, keys[np.searchsorted(keys, (level - 1) * np.int64(n) + np.arange(n)) - 1] % n, -1)
        base = np.repeat((total - wide)[first[:-1]], np.diff(first))
        return Forest(rows, first, parent, total - wide - base, total[last] - base, code, list(out_names), word, leaf)
