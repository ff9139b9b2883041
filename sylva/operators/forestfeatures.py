"""Feature classes from many trees at once: those that no column expression has (chains of branches and heads, fragments), and the commonest others.

A class draws its features from a Forest as numbers: the tree of each occurrence, and its text's place among the different
texts. Occurrences are counted by tree and added up where the trees are read, so partial sums move. Names and texts are
those of treefeatures, whose row-wise classes stand for the parameters that aren't expressed here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.forest import Forest
from sylva.functions.rowtree import CONJUNCTION, FUNCTIONAL
from sylva.operators.treefeatures import AFTER, BEFORE, END, HEAD, quantized
from sylva.sources.ptb import PIECE_BYTES, different, pieces

Drawn = tuple[np.ndarray, np.ndarray, pa.Array]  # trees, places among the texts, texts
Class = Callable[["Grove"], Drawn]


def numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of numbers from 0: a row of each different kind, and each row's number among these."""
    return different(columns)[:2]


class Grove:
    """A forest of trees as the ranker sees them, with what classes share."""

    def __init__(self, forest: Forest) -> None:
        self.f, self.n = forest, len(forest)
        self.order, self.begin = forest.kids
        self.count = np.diff(self.begin)
        self.rank = np.zeros(self.n, np.int64)
        self.rank[self.order] = np.arange(len(self.order)) - self.begin[:-1][forest.parent[self.order]]
        self.names = pa.array([*forest.names, None], pa.string())
        self._heads: dict[str, np.ndarray] = {}

    @cached_property
    def words(self) -> tuple[np.ndarray, pa.Array]:
        """By node its word's place among the different words, and these; 0 at phrases."""
        words = self.f.word.dictionary_encode()
        return words.indices.fill_null(0).to_numpy().astype(np.int64), words.dictionary

    def heads(self, kind: str) -> np.ndarray:
        if kind not in self._heads:
            self._heads[kind] = self.f.heads(kind)
        return self._heads[kind]

    def kid(self, k: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Child i of each node k, -1 if there's none."""
        inside = (i >= 0) & (i < self.count[k])
        return np.append(self.order, -1)[np.where(inside, self.begin[k] + i, -1)]

    def code(self, nodes: np.ndarray) -> np.ndarray:
        """Labels as places in names; null for -1."""
        return np.append(self.f.code, len(self.names) - 1).astype(np.int64)[nodes]

    def inner(self, edge: str) -> np.ndarray:
        """By node, whether it is its parent's first or last child but punctuation."""
        ok = ~self.f.punct[self.order]
        kept, out = self.order[ok], np.zeros(self.n, bool)
        up = self.f.parent[kept]
        other = np.append(up[1:] != up[:-1], True) if edge == "last" else np.append(True, up[1:] != up[:-1])
        out[kept[other[: len(kept)]]] = True
        return out

    def coordination(self) -> np.ndarray:
        """By node, whether a conjunction stands between its first and its last child."""
        c = np.flatnonzero(self.f.is_code(CONJUNCTION) & (self.f.parent >= 0))
        up = self.f.parent[c]
        out = np.zeros(self.n, bool)
        out[up[(self.rank[c] > 0) & (self.rank[c] < self.count[up] - 1)]] = True
        return out

    def adjunction(self) -> np.ndarray:
        """By node, whether it is a phrase whose children but punctuation all have its label."""
        f, out = self.f, ~self.f.leaf
        kids = self.order[~f.punct[self.order]]
        up = f.parent[kids]
        out[up[f.code[kids] != f.code[up]]] = False
        return out

    def last(self) -> np.ndarray:
        """By node, whether no sibling but punctuation comes after it."""
        final = np.full(self.n, -1)  # of each node's children the last one but punctuation
        kids = self.order[~self.f.punct[self.order]]
        up = self.f.parent[kids]
        ends = np.append(up[1:] != up[:-1], True)[: len(kids)]
        final[up[ends]] = kids[ends]
        return (self.f.parent < 0) | (np.arange(self.n) >= np.append(final, -1)[self.f.parent])

    def expand(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of the nodes in order, and the place of each one's parent among the nodes."""
        times = self.count[nodes]
        at = np.repeat(np.arange(len(nodes)), times)
        return at, self.order[self.begin[nodes][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]


def _ended(to: np.ndarray) -> np.ndarray:
    """Pointers followed to their ends."""
    while ((new := to[to]) != to).any():
        to = new
    return to


def _steps(up: np.ndarray) -> np.ndarray:
    """How many steps lead from each node to the end of its chain (up: the next one, -1 at the end)."""
    up = np.append(np.where(up >= 0, up, len(up)), len(up))
    step = (up < len(up) - 1).astype(np.int64)
    while (up < len(up) - 1).any():
        step, up = step + step[up], up[up]
    return step[:-1]


def right_branch() -> Class:
    def run(g: Grove) -> Drawn:
        f, at = g.f, np.arange(g.n)
        root = f.parent < 0
        reached = _ended(np.append(np.where(root, at, np.where(g.inner("last"), f.parent, g.n)), g.n))[:-1]
        chosen = np.flatnonzero(root | ~f.punct)
        return f.tree[chosen], (reached[chosen] < g.n).astype(np.int64), pa.array(["0", "1"])

    return run


def branch_length(side: str) -> Class:
    def run(g: Grove) -> Drawn:
        f = g.f
        length = 1 + _steps(np.where(g.inner("first" if side == "left" else "last"), f.parent, -1))
        chosen = np.flatnonzero(f.leaf & (~f.punct | (f.parent < 0)))
        log = np.frexp(length[chosen].astype(float))[1].astype(np.int64) - 1
        return f.tree[chosen], log, pa.array([str(x) for x in range(int(log.max()) + 1 if len(log) else 1)])

    return run


def head_pairs(n: int = 2, governor: int = 1, dependent: int = 1, kind: int = 0) -> Class:
    which = ("syntactic", "semantic")[kind]

    def run(g: Grove) -> Drawn:
        f, own, both = g.f, g.heads(which), g.coordination()
        at, up = np.arange(g.n), f.parent
        over = np.append(own, -1)[up]
        passed = (up >= 0) & (np.append(both, False)[up] | (over < 0) | (over == at))
        above = np.append(up, -1)[_ended(np.where(passed, up, at))]  # the node over the last one that is passed
        down = np.append(np.where(f.leaf | both, at, np.where(own >= 0, own, g.n)), g.n)
        down = _ended(down)

        def governors(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Heads under each of the tops, all conjuncts' of a coordination, with the top's place."""
            place, node, found = np.arange(len(tops)), down[tops], []
            while len(node):
                place, node = place[node < g.n], node[node < g.n]
                found.append((place[f.leaf[node]], node[f.leaf[node]]))
                place, node = place[~f.leaf[node]], node[~f.leaf[node]]
                i, kids = g.expand(node)
                same = f.code[kids] == f.code[node[i]]
                place, node = place[i[same]], down[kids[same]]
            return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

        node = np.flatnonzero(f.is_leaf)
        chain = [node]
        for _ in range(n - 1):
            has = above[node] >= 0
            chain, node = [x[has] for x in chain], above[node[has]]
            i, heads = governors(own[node])
            chain, node = [*(x[i] for x in chain), heads], node[i]
        words = f.word.dictionary_encode()
        word = words.indices.fill_null(0).to_numpy().astype(np.int64)
        columns, kinds = [], []
        for j, x in enumerate(chain):
            columns.append(g.code(x))
            kinds.append(g.names)
            if governor if j else dependent:
                columns.append(word[x])
                kinds.append(words.dictionary)
        some, place = numbered(columns)
        parts = [k.take(pa.array(c[some])) for k, c in zip(kinds, columns, strict=True)]
        return f.tree[chain[0]], place, pc.binary_join_element_wise(*parts, " ")

    return run


def head_ngram(n: int = 3, direction: int = 1, distance: int = 1, categories: int = 0, root: int = 0, conjunct: int = 0, head: int = 0, functional: int = 0, every: int = 0, kind: int = 1) -> Class | None:
    if categories or root or conjunct or head or functional or every:
        return None

    def run(g: Grove) -> Drawn:
        f, own = g.f, g.heads(("semantic", "syntactic")[kind])
        k = np.flatnonzero(~f.leaf & (g.count >= n))
        times = g.count[k] + 3 - n
        at = np.repeat(k, times)
        a = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)  # the place 0 is the end before the first child
        top = own[at]
        place = np.where(top >= 0, g.rank[top] + 1, 0)
        inside = (top >= 0) & (a <= place) & (place < a + n)
        sizes = np.array([quantized(i) for i in range(6)])
        q = lambda x: sizes[np.minimum(x, 5)]
        columns, kinds = [], []
        ends = pa.array([*f.names, END], pa.string())
        for j in range(n):
            columns.append(g.code(g.kid(at, a + j - 1)))
            kinds.append(ends)
        if direction:
            columns.append(np.where(inside, q(np.maximum(place - a, 0)), np.where(a >= place, 7, 6)))
            kinds.append(pa.array([*map(str, range(6)), BEFORE, AFTER]))
        if distance:
            columns.append(q(np.where(place < a, a - place, np.maximum(0, place + 1 - a - n))))
            kinds.append(pa.array([*map(str, range(6))]))
        over = np.where(f.parent[at] >= 0, at, -1)
        columns.append(g.code(over))
        kinds.append(pa.array([*(f"{END} {x}" for x in f.names), END]))
        some, number = numbered(columns)
        return f.tree[at], number, pc.binary_join_element_wise(*[x.take(pa.array(c[some])) for x, c in zip(kinds, columns, strict=True)], " ")

    return run


def _chains(g: Grove, start: np.ndarray, to: np.ndarray, beside: bool) -> tuple[np.ndarray, list[str]]:
    """Places and texts of the trees that are left of the paths from start down to a leaf (to: the child on the path), with the labels next to it."""
    needed, front = np.zeros(g.n, bool), start
    while len(front):
        needed[front] = True
        front = np.unique(to[front[~g.f.leaf[front]]])
        front = front[~needed[front]]
    nodes = np.flatnonzero(needed)
    height = _steps(np.where(needed & ~g.f.leaf, to, -1))
    number = np.zeros(g.n, np.int64)
    label, left, right, below = [], [], [], []
    nodes = nodes[np.argsort(height[nodes], kind="stable")]
    for part in np.split(nodes, np.flatnonzero(np.diff(height[nodes])) + 1):
        if not len(part):
            continue
        phrase = ~g.f.leaf[part]
        next_ = np.where(phrase, to[part], -1)
        up, rank = np.where(phrase, part, 0), np.where(phrase, g.rank[next_], 0)
        sides = [g.code(np.where(phrase, g.kid(up, rank + d), -1)) if beside else np.full(len(part), len(g.names) - 1) for d in (-1, 1)]
        under = np.where(phrase, number[next_], -1)
        some, place = numbered([g.f.code[part].astype(np.int64), *sides, under + 1])
        number[part] = len(label) + place
        for out, x in zip((label, left, right, below), (g.f.code[part], *sides, under), strict=True):
            out += x[some].tolist()
    names = g.names.to_pylist()
    used, place = np.unique(number[start], return_inverse=True)
    texts = []
    for x in used.tolist():
        opened, closed = [], []
        while x >= 0:
            opened.append(f"({names[label[x]]}")
            if below[x] >= 0:
                if names[left[x]] is not None:
                    opened.append(f"({names[left[x]]})")
                closed.append(")" if names[right[x]] is None else f" ({names[right[x]]}))")
            x = below[x]
        texts.append(" ".join(opened) + ")" + "".join(reversed(closed)))
    return place, texts


def ngram_tree(n: int = 2, lexical: int = 0, collapse: int = 0, ancestors: int = 0) -> Class | None:
    """Of two words in a row the node over both, with the paths down to them."""
    if (n, lexical, collapse, ancestors) != (2, 0, 1, 0):
        return None

    def run(g: Grove) -> Drawn:
        f = g.f
        leaves = np.flatnonzero(f.is_leaf)
        a = np.flatnonzero((f.tree[leaves[2:]] == f.tree[leaves[:-2]]) if len(leaves) > 2 else np.zeros(0, bool))
        one, two = leaves[a], leaves[a + 1]
        # the last node that ends with a word, and the first one that begins with one, whose parents are the node over both
        at = np.arange(g.n)
        up = np.maximum(f.parent, 0)
        ends = np.where((f.parent >= 0) & (f.finish[up] == f.finish), f.parent, at)
        begins = np.where((f.parent >= 0) & (f.start[up] == f.start), f.parent, at)
        one, two = _ended(ends)[one], _ended(begins)[two]
        has = np.flatnonzero(g.count)
        first, last = np.full(g.n, -1), np.full(g.n, -1)
        first[has], last[has] = g.order[g.begin[has]], g.order[g.begin[has + 1] - 1]
        (x, left), (y, right) = _chains(g, one, last, False), _chains(g, two, first, False)
        columns, kinds = [g.code(f.parent[one]), x, y], [g.names, pa.array(left, pa.string()), pa.array(right, pa.string())]
        some, place = numbered(columns)
        top, left, right = (k.take(pa.array(c[some])) for k, c in zip(kinds, columns, strict=True))
        return f.tree[one], place, pc.binary_join_element_wise("(", top, " ", left, " ", right, ")", "")

    return run


def head_tree(collapse: int = 1, lexical: int = 0, ancestors: int = 0, kind: int = 1) -> Class | None:
    """The maximal projection of each word with the way down to it and the children next to that."""
    if not collapse or lexical or ancestors:
        return None

    def run(g: Grove) -> Drawn:
        f, own = g.f, g.heads(("syntactic", "semantic")[kind])
        at, up = np.arange(g.n), f.parent
        top = _ended(np.where((up >= 0) & (np.append(own, -1)[up] == at), up, at))[leaves := np.flatnonzero(f.is_leaf)]
        place, texts = _chains(g, top, own, True)
        return f.tree[leaves], place, pa.array(texts, pa.string())

    return run


def parallel(ignore_tags: int = 0) -> Class | None:
    if ignore_tags:
        return None

    def run(g: Grove) -> Drawn:
        f = g.f
        kept = g.order[g.coordination()[f.parent[g.order]] & ~f.punct[g.order] & ~f.is_code(CONJUNCTION)[g.order]]
        pair = np.flatnonzero(f.parent[kept[1:]] == f.parent[kept[:-1]])
        a, b = kept[pair], kept[pair + 1]
        tree, which = f.tree[a], np.arange(len(a))
        failed, trees, found = np.zeros(len(a), bool), [], []
        for depth in range(1, 6):
            failed[which[(f.code[a] != f.code[b]) | (f.leaf[a] != f.leaf[b])]] = True
            there = np.zeros(len(failed), bool)
            there[which] = True
            chosen = np.flatnonzero(failed | there)
            trees.append(tree[chosen])
            found.append(2 * (depth - 1) + ~failed[chosen])
            failed[which[g.count[a] != g.count[b]]] = True
            same = ~failed[which]  # pairs below differ no more than that
            a, b, which = a[same], b[same], which[same]
            (i, a), (_, b) = g.expand(a), g.expand(b)
            which = which[i]
        return np.concatenate(trees), np.concatenate(found).astype(np.int64), pa.array([f"{d} {m}" for d in range(1, 6) for m in (0, 1)])

    return run


def _joined(columns: list[np.ndarray], kinds: list[pa.Array], space: str = " ") -> tuple[np.ndarray, pa.Array]:
    """Each row's place among the different texts of its columns' values."""
    some, place = numbered(columns)
    return place, pc.binary_join_element_wise(*[x.take(pa.array(c[some])) for x, c in zip(kinds, columns, strict=True)], space)


def _above(g: Grove, node: np.ndarray, categories: int) -> tuple[list[np.ndarray], list[pa.Array]]:
    """The labels of the nodes and of so many above, but the root's, each with a space before it; nothing where there's none."""
    columns, up = [], np.append(g.f.parent, -1)
    for _ in range(categories + 1):
        over = up[node]
        columns.append(g.code(np.where(over >= 0, node, -1)))
        node = over
    return columns, [pa.array([*(f" {x}" for x in g.f.names), ""], pa.string())] * len(columns)


def word(categories: int = 1) -> Class:
    """A word and the labels of its tag and ancestors, all there or none."""

    def run(g: Grove) -> Drawn:
        f, node = g.f, np.flatnonzero(g.f.is_leaf)
        codes, words = g.words
        chain = [node]
        for _ in range(categories - 1):
            node = np.append(f.parent, -1)[node]
            chain.append(node)
        kept = np.flatnonzero(node >= 0)
        columns = [codes[chain[0][kept]], *(g.code(x[kept]) for x in chain[:categories])]
        place, texts = _joined(columns, [words, *[g.names] * (len(columns) - 1)])
        return f.tree[chain[0][kept]], place, texts

    return run


def rule(trees: int = 0, categories: int = 0, root: int = 0, conjunct: int = 0, head: int = 0, functional: int = 0, every: int = 0, kind: int = 1) -> Class | None:
    """Children's labels, with as much of their heads as (of the head, function words, all) ask, and labels above."""
    if trees or root or conjunct:
        return None
    levels = (head, functional, every)

    def run(g: Grove) -> Drawn:
        f, c = g.f, g.order
        k = np.flatnonzero(~f.leaf)
        if max(levels):
            own = g.heads(("semantic", "syntactic")[kind])
            lex = f.lexical(own)[c]
            has = lex >= 0
            depth = np.maximum(np.where(c == own[f.parent[c]], levels[0], 0), levels[2])
            depth = np.where(has, np.maximum(depth, np.where(np.append(f.is_code(FUNCTIONAL), False)[lex], levels[1], 0)), 0)
            codes, words = g.words
            labels = np.where((depth >= 1) & (lex != c), g.code(lex), len(f.names))
            place, texts = _joined(
                [g.code(c), labels, np.where(depth >= 2, codes[lex], len(words))],
                [g.names, pa.array([*(f" {HEAD} {x}" for x in f.names), ""], pa.string()), pa.array([*(f" {x}" for x in words.to_pylist()), ""], pa.string())], "")
            enough = np.zeros(g.n, bool)
            most = max(levels)
            enough[f.parent[c[has & (depth >= most) & ((most > 1) | (lex != c))]]] = True
            k = k[enough[k]]
            kids = texts.take(pa.array(place))
        else:
            kids = g.names.take(pa.array(g.code(c)))
        rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(g.begin, pa.int32()), kids), " ").take(pa.array(k)).dictionary_encode()
        above, kinds = _above(g, k, categories)
        ends = pc.binary_join_element_wise(rows.dictionary, END, " ")
        place, texts = _joined([rows.indices.to_numpy().astype(np.int64), *above], [ends, *kinds], "")
        return f.tree[k], place, texts

    return run


def ngram(n: int = 3, categories: int = 1, root: int = 0, conjunct: int = 0, head: int = 0, functional: int = 0, every: int = 0, kind: int = 1) -> Class | None:
    """n neighbouring children with an end on each side, before the head or from it on."""
    if root or conjunct or head or functional or every:
        return None

    def run(g: Grove) -> Drawn:
        f, own = g.f, g.heads(("semantic", "syntactic")[kind])
        k = np.flatnonzero(~f.leaf & (g.count >= n))
        times = g.count[k] + 3 - n
        at = np.repeat(k, times)
        a = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)  # the place 0 is the end before the first child
        top = own[at]
        labels = pa.array([*(f"{x} " for x in f.names), f"{END} "], pa.string())
        columns = [*(g.code(g.kid(at, a + j - 1)) for j in range(n)), (a >= np.where(top >= 0, g.rank[top] + 1, 0)).astype(np.int64)]
        above, kinds = _above(g, at, categories)
        place, texts = _joined([*columns, *above], [*[labels] * n, pa.array([f"{BEFORE} {END}", f"{AFTER} {END}"]), *kinds], "")
        return f.tree[at], place, texts

    return run


def _spans(values: str, binned: int, places: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> Class:
    """For each phrase its quantised length, if that is asked for, its label, and the tags or words at places near its ends."""

    def run(g: Grove) -> Drawn:
        f, k, leaves = g.f, np.flatnonzero(~g.f.leaf), np.flatnonzero(g.f.is_leaf)
        codes, texts = (f.code.astype(np.int64), pa.array(f.names, pa.string())) if values == "tags" else g.words
        size = np.bincount(f.tree[leaves], minlength=len(f.row))
        base, n, found = (np.cumsum(size) - size)[f.tree[k]], size[f.tree[k]], np.append(codes[leaves], len(texts))
        a, b = f.start[k], f.finish[k]
        around = [found[np.where((p >= 0) & (p < n), base + p, len(leaves))] for p in places(a, b)]
        sizes = np.array([quantized(i) for i in range(6)], np.int64)
        columns, kinds = [g.code(k), *around], [g.names, *[pa.array([*texts.to_pylist(), END], pa.string())] * len(around)]
        if binned:
            columns, kinds = [sizes[np.minimum(b - a, 5)], *columns], [pa.array([str(i) for i in range(6)]), *kinds]
        place, made = _joined(columns, kinds)
        return f.tree[k], place, made

    return run


def neighbours(values: str, binned: int = 1, left: int = 0, right: int = 0) -> Class:
    return _spans(values, binned, lambda a, b: [*(a - d for d in range(left)), *(b + d for d in range(right))])


def edges(values: str, binned: int = 0, before: int = 0, first: int = 0, last: int = 0, after: int = 0) -> Class:
    return _spans(values, binned, lambda a, b: [*(a - 1 - d for d in range(before)), *(a + d for d in range(first)), *(b - 1 - d for d in range(last)), *(b + d for d in range(after))])


def heavy() -> Class:
    """Quantised length and distance to the end, label, and punctuation at the end of the span and after it."""

    def run(g: Grove) -> Drawn:
        f, k = g.f, np.flatnonzero(~g.f.leaf)
        (codes, words), leaves = g.words, np.flatnonzero(f.is_leaf)
        none = len(words)
        ends = np.where(f.punct, codes, none)[leaves]
        size = np.bincount(f.tree[leaves], minlength=len(f.row))
        at, b, n = (np.cumsum(size) - size)[f.tree[k]], f.finish[k], size[f.tree[k]]
        after = np.append(ends, none)[np.where(b < n, at + b, len(ends))]
        columns = [np.minimum(b - f.start[k], 5), np.minimum(n - b, 5), g.code(k), ends[at + b - 1], after]
        marks = pa.array([*words.to_pylist(), END], pa.string())
        columns[:2] = (np.array([quantized(i) for i in range(6)])[x] for x in columns[:2])
        sizes = pa.array([str(i) for i in range(6)])
        some, place = numbered(columns)
        return f.tree[k], place, pc.binary_join_element_wise(*[x.take(pa.array(c[some])) for x, c in zip((sizes, sizes, g.names, marks, marks), columns, strict=True)], " ")

    return run


CLASSES: dict[str, Callable[..., Class | None]] = {
    "RightBranch": right_branch, "LeftBranchLength": lambda: branch_length("left"), "RightBranchLength": lambda: branch_length("right"), "Heads": head_pairs,
    "NNGram": head_ngram, "NGramTree": ngram_tree, "HeadTree": head_tree, "CoPar": parallel,
    "Heavy": heavy, "Word": word, "Rule": rule, "NGram": ngram, "Neighbours": lambda *p: neighbours("tags", 1, *p), "WordNeighbours": lambda *p: neighbours("words", *(p or (0,))),
    "Edges": lambda *p: edges("tags", *p), "WordEdges": lambda *p: edges("words", *p),
}


def build(name: str) -> Class | None:
    """The class of a name; None if it isn't one of these."""
    first, *parameters = name.split(":")
    return CLASSES[first](*map(int, parameters)) if first in CLASSES else None


def feature_totals(parses: DataFrame, names: list[str], tree: str = "tree") -> DataFrame:
    """cls, feat, parses, total: the trees that have each feature, and how often it occurs in all."""
    if missing := [n for n in names if build(n) is None]:
        raise ValueError(f"not drawn from many trees at once: {missing[0]}")

    def run(batches):
        built = {n: build(n) for n in names}
        for batch in batches:
            for part in pieces(batch, ["_t"]):
                g = Grove(Forest.read(part.column("_t"), normal=True))
                if not g.n:
                    continue
                for name, draw in built.items():
                    trees, place, texts = draw(g)
                    each, times = np.unique(place * len(g.f.row) + trees, return_counts=True)
                    of = each // len(g.f.row)
                    parses, total = np.bincount(of, minlength=len(texts)), np.bincount(of, times, len(texts))
                    some = np.flatnonzero(parses)
                    yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(some), np.int64))), texts.take(pa.array(some)), pa.array(parses[some].astype(np.int64)), pa.array(total[some].astype(float))], ["cls", "feat", "parses", "total"])

    partial = parses.select(F.col(tree).alias("_t")).mapInArrow(run, "cls string, feat string, parses long, total double")
    return partial.groupBy("cls", "feat").agg(F.sum("parses").alias("parses"), F.sum("total").alias("total"))


def list_values(lists: DataFrame, names: list[str], key: str = "sent_id", trees: str = "trees") -> DataFrame:
    """key, cls, feat, vals: of each list of trees the features that one of them has, with the values of all, 0 where a tree lacks it."""
    if missing := [n for n in names if build(n) is None]:
        raise ValueError(f"not drawn from many trees at once: {missing[0]}")
    kind = lists.schema[key].dataType.simpleString()

    def run(batches):
        built = {n: build(n) for n in names}
        for batch in batches:
            size = pc.list_value_length(batch.column("_t")).fill_null(0).to_numpy().astype(np.int64)
            texts = batch.column("_t").flatten()
            flat = pa.RecordBatch.from_arrays([texts, pa.array(np.repeat(np.arange(len(size)), size)), pa.array(np.arange(len(texts)) - np.repeat(np.cumsum(size) - size, size))], ["_t", "row", "at"])
            begin = np.cumsum(size) - size
            # whole lists, about as many at once as pieces() takes of trees
            weight = np.cumsum(np.append(0, pc.binary_length(texts.cast(pa.string())).fill_null(0).to_numpy().astype(np.int64)))
            part = weight[begin] // PIECE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = flat.slice(begin[a] if a < len(size) else 0, int(size[a:b].sum()))
                g = Grove(Forest.read(own.column("_t"), normal=True)) if own.num_rows else None
                if g is None or not g.n:
                    continue
                row, at = (own.column(c).to_numpy()[g.f.row] for c in ("row", "at"))
                for name, draw in built.items():
                    tree, place, texts_ = draw(g)
                    if not len(tree):
                        continue
                    each, which = np.unique((row[tree] - a) * len(texts_) + place, return_inverse=True)
                    lists_ = a + each // len(texts_)
                    offsets = np.append(0, np.cumsum(size[lists_]))
                    vals = np.bincount(offsets[which] + at[tree], minlength=offsets[-1]).astype(float)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(lists_)), pa.array([name]).take(pa.array(np.zeros(len(each), np.int64))), texts_.take(pa.array(each % len(texts_))),
                                                      pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(vals))], [key, "cls", "feat", "vals"])

    return lists.select(key, F.col(trees).alias("_t")).mapInArrow(run, f"`{key}` {kind}, cls string, feat string, vals array<double>")
