"""The ranker's feature classes on whole trees: one pass over a row computes every class of a set, with no join or shuffle.

A class is a function of a View (a tree without empties and function tags, its heads and leaves) that yields features
as tuples; its name carries its parameters, as in Rule:0:1. CLASSES builds a class from its name, SETS names lists of
classes, and register() adds a class of one's own.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions import heads
from sylva.functions.rowtree import BOUNDING, CLOSED, CONJUNCTION, FUNCTIONAL, RowTree

# Marks inside features.
END, CHILD, HEAD, BEFORE, AFTER, INNER = "_", "*CHILD*", "*HEAD*", "*PREHEAD*", "*POSTHEAD*", "*NONROOT*"
CONJUNCT, LAST_CONJUNCT, ADJUNCT, LAST_ADJUNCT = "*CONJ*", "*LASTCONJ*", "*ADJ*", "*LASTADJ*"


def quantized(n: int) -> int:
    return n if n < 3 else 4 if n < 5 else 5


class View:
    """A normalised tree, with what classes share."""

    def __init__(self, tree: RowTree) -> None:
        self.tree, self.label, self.word, self.kids, self.parent = tree, tree.label, tree.word, tree.kids, tree.parent
        self.start, self.finish = tree.start, tree.finish
        self.leaves = tree.leaves()
        self.phrases = [k for k in range(len(tree)) if tree.word[k] is None]
        self.tags, self.words = [tree.label[k] for k in self.leaves], [tree.word[k] for k in self.leaves]
        self.coordination = [tree.word[k] is None and tree.is_coordination(k) for k in range(len(tree))]

    @cached_property
    def heads(self) -> dict[str, tuple[list[int], list[int]]]:
        """By kind: head children and lexical heads."""
        out = {}
        for kind in ("syntactic", "semantic"):
            own = heads.head_children(self.tree, heads.RULES[kind])
            out[kind] = own, heads.lexical_heads(self.tree, own)
        return out

    @cached_property
    def ends(self) -> list[str]:
        return [w if self.tree.is_punctuation(k) else END for k, w in zip(self.leaves, self.words, strict=True)]


Feature = tuple
Class = Callable[[View], Iterator[Feature]]


def _child(v: View, c: int, parent: int, kind: str, levels: tuple[int, int, int]) -> tuple[list[str], int]:
    """A child's label with as much of its head as (of the head, function words, all) ask; and how far that went (0 to 2)."""
    children, lexical = v.heads[kind]
    out, lex = [v.label[c]], lexical[c]
    if lex < 0:
        return out, 0
    depth = max(levels[2], levels[0] if c == children[parent] else 0, levels[1] if v.label[lex] in FUNCTIONAL else 0)
    reached = 0
    if depth >= 1 and lex != c:
        out += [HEAD, v.label[lex]]
        reached = 1
    if depth >= 2:
        out.append(v.word[lex])
        reached = 2
    return out, reached


def _above(v: View, k: int, categories: int, root: bool, conjunct: bool) -> list[str]:
    """Labels of a node and its ancestors, with marks of conjuncts and adjuncts, and of a node inside another bounding one."""
    out, up = [END], v.parent[k]
    for _ in range(categories + 1):
        if up < 0:
            break
        out.append(v.label[k])
        if conjunct:
            last = v.tree.is_last(up)
            if v.coordination[up]:
                out.append(LAST_CONJUNCT if last else CONJUNCT)
            elif v.tree.is_adjunction(up):
                out.append(LAST_ADJUNCT if last else ADJUNCT)
        k, up = up, v.parent[up]
    if root:
        while up >= 0:
            if v.label[up] in BOUNDING and not (v.parent[up] >= 0 and v.label[v.parent[up]] in BOUNDING):
                out.append(INNER)
                break
            up = v.parent[up]
    return out


def rule(trees: int = 0, categories: int = 0, root: int = 0, conjunct: int = 0, head: int = 0, functional: int = 0, every: int = 0, kind: int = 1) -> Class:
    """Rule: children's labels (0 no words, 1 tags, 2 words of heads, function words, all), rules above, labels above."""
    levels, which = (head, functional, every), ("semantic", "syntactic")[kind]

    def run(v: View):
        for k in v.phrases:
            out, reached, node = [], 0, k
            for c in v.kids[k]:
                part, r = _child(v, c, k, which, levels)
                out += part
                reached = max(reached, r)
            for _ in range(trees):
                up = v.parent[node]
                if up < 0:
                    break
                out.append(END)
                for c in v.kids[up]:
                    part, r = ([CHILD, v.label[c]], 0) if c == node else _child(v, c, node, which, levels)
                    out += part
                    reached = max(reached, r)
                node = up
            if reached == max(levels):
                yield (*out, *_above(v, node, categories, bool(root), bool(conjunct)))

    return run


def ngram(n: int = 3, categories: int = 1, root: int = 0, conjunct: int = 0, head: int = 0, functional: int = 0, every: int = 0, kind: int = 1) -> Class:
    """NGram: n neighbouring children with an end on each side, before or after the head. A node's grams end with the first that lacks the words asked for."""
    levels, which = (head, functional, every), ("semantic", "syntactic")[kind]

    def run(v: View):
        for k in v.phrases:
            if len(v.kids[k]) < n:
                continue
            top, side, padded = v.heads[which][0][k], BEFORE, [-1, *v.kids[k], -1]
            above = _above(v, k, categories, bool(root), bool(conjunct))
            for a in range(len(padded) - n + 1):
                if padded[a] == top:
                    side = AFTER
                out, reached = [], 0
                for c in padded[a : a + n]:
                    part, r = _child(v, c, k, which, levels) if c >= 0 else ([END], 0)
                    out += part
                    reached = max(reached, r)
                out.append(side)
                if head and top >= 0 and top not in padded[a : a + n]:
                    part, r = _child(v, top, k, which, levels)
                    out += part
                    reached = max(reached, r)
                if reached != max(levels):
                    break
                yield (*out, *above)

    return run


def head_ngram(n: int = 3, direction: int = 1, distance: int = 1, categories: int = 0, root: int = 0, conjunct: int = 0, head: int = 0, functional: int = 0, every: int = 0, kind: int = 1) -> Class:
    """NNGram: n neighbouring children with the head's place among them or side of them, and its quantised distance."""
    levels, which = (head, functional, every), ("semantic", "syntactic")[kind]

    def run(v: View):
        for k in v.phrases:
            if len(v.kids[k]) < n:
                continue
            top, side, padded = v.heads[which][0][k], BEFORE, [-1, *v.kids[k], -1]
            at = padded.index(top) if top >= 0 else 0
            above = _above(v, k, categories, bool(root), bool(conjunct))
            for a in range(len(padded) - n + 1):
                if padded[a] == top:
                    side = AFTER
                part = [_child(v, c, k, which, levels) if c >= 0 else ([END], 0) for c in padded[a : a + n]]
                out, reached = [x for p, _ in part for x in p], max(r for _, r in part)
                inside = top >= 0 and a <= at < a + n
                if direction:
                    out.append(str(quantized(at - a)) if inside else side)
                if distance:
                    out.append(str(quantized(a - at if at < a else max(0, at + 1 - a - n))))
                if head:
                    p, r = _child(v, top, k, which, levels) if top >= 0 else ([HEAD], 0)
                    out += p
                    reached = max(reached, r)
                if reached != max(levels):
                    break
                yield (*out, *above)

    return run


def word(categories: int = 1) -> Class:
    """Word: a word and the labels of its tag and ancestors."""

    def run(v: View):
        for k in v.leaves:
            out, node = [v.word[k]], k
            for _ in range(categories):
                if node < 0:
                    break
                out.append(v.label[node])
                node = v.parent[node]
            else:
                yield tuple(out)

    return run


def projection(kind: int = 0, inner: int = 0, ancestors: int = 1) -> Class:
    """WProj: a word, its maximal projection (with inner the steps to it) and the labels above."""
    which = ("semantic", "syntactic")[kind]

    def run(v: View):
        children = v.heads[which][0]
        for k in v.leaves:
            if v.tree.is_punctuation(k):
                continue
            out, node = [v.word[k]], k
            while v.parent[node] > 0 and children[v.parent[node]] == node:  # the root isn't a projection
                if inner:
                    out.append(v.label[node])
                node = v.parent[node]
            for _ in range(ancestors + 1):
                if node < 0:
                    break
                out.append(v.label[node])
                node = v.parent[node]
            yield tuple(out)

    return run


def right_branch() -> Class:
    """RightBranch: 1 for nodes on the way to the last word that isn't punctuation, 0 for others; no punctuation."""

    def run(v: View):
        stack = [(0, 1)]
        while stack:
            k, on = stack.pop()
            yield (on,)
            kids = [c for c in v.kids[k] if not v.tree.is_punctuation(c)]
            stack += [(c, on if c == kids[-1] else 0) for c in kids]

    return run


def branch_length(side: str) -> Class:
    """LeftBranchLength, RightBranchLength: floor(log2) of the length of the chain that ends in each tag."""

    def run(v: View):
        stack = [(0, 1)]
        while stack:
            k, n = stack.pop()
            if v.word[k] is not None:
                yield (int(math.log2(n)),)
                continue
            kids = [c for c in v.kids[k] if not v.tree.is_punctuation(c)]
            edge = kids[0 if side == "left" else -1] if kids else -1
            stack += [(c, n + 1 if c == edge else 1) for c in kids]

    return run


def head_pairs(n: int = 2, governor: int = 1, dependent: int = 1, kind: int = 0) -> Class:
    """Heads: chains of n heads, each governing the one before; every conjunct of a coordination governs and is governed."""
    which = ("syntactic", "semantic")[kind]

    def run(v: View):
        children = v.heads[which][0]

        def governors(top: int) -> list[int]:
            while top >= 0 and v.word[top] is None and not v.coordination[top]:
                top = children[top]
            if top < 0:
                return []
            if v.word[top] is not None:
                return [top]
            return [g for c in v.kids[top] if v.label[c] == v.label[top] for g in governors(c)]

        def chains(node: int, so_far: tuple, count: int):
            if count == n:
                yield so_far
                return
            up = v.parent[node]
            while up >= 0 and (v.coordination[up] or children[up] < 0 or children[up] == node):
                node, up = up, v.parent[up]
            if up >= 0:
                for g in governors(children[up]):
                    yield from chains(up, (*so_far, v.label[g], *([v.word[g]] if governor else [])), count + 1)

        for k in v.leaves:
            yield from chains(k, (v.label[k], *([v.word[k]] if dependent else [])), 1)

    return run


def _beside(values: list[str], places) -> list[str]:
    return [values[i] if 0 <= i < len(values) else END for i in places]


def neighbours(left: int = 0, right: int = 0) -> Class:
    """Neighbours: quantised length, label, `left` tags from the span's first one to the left, and `right` after it."""

    def run(v: View):
        for k in v.phrases:
            a, b = v.start[k], v.finish[k]
            yield (quantized(b - a), v.label[k], *_beside(v.tags, range(a, a - left, -1)), *_beside(v.tags, range(b, b + right)))

    return run


def word_neighbours(binned: int = 0, left: int = 0, right: int = 0) -> Class:
    """WordNeighbours: the same with words."""

    def run(v: View):
        for k in v.phrases:
            a, b = v.start[k], v.finish[k]
            yield (*([str(quantized(b - a))] if binned else []), v.label[k], *_beside(v.words, range(a, a - left, -1)), *_beside(v.words, range(b, b + right)))

    return run


def edges(values: str, binned: int = 0, before: int = 0, first: int = 0, last: int = 0, after: int = 0) -> Class:
    """Edges, WordEdges: tags or words before and after the span's beginning, before and after its end."""

    def run(v: View):
        of = v.tags if values == "tags" else v.words
        for k in v.phrases:
            a, b = v.start[k], v.finish[k]
            around = [*range(a - 1, a - 1 - before, -1), *range(a, a + first), *range(b - 1, b - 1 - last, -1), *range(b, b + after)]
            yield (*([str(quantized(b - a))] if binned else []), v.label[k], *_beside(of, around))

    return run


def heavy() -> Class:
    """Heavy: quantised length and distance to the end, label, the span's last word and the next one if they're punctuation."""

    def run(v: View):
        n = len(v.leaves)
        for k in v.phrases:
            a, b = v.start[k], v.finish[k]
            yield (quantized(b - a), quantized(n - b), v.label[k], v.ends[b - 1], v.ends[b] if b < n else END)

    return run


def _wanted(v: View, k: int, lexical: int) -> bool:
    return lexical == 3 or (lexical == 2 and v.label[k] in FUNCTIONAL) or (lexical == 1 and v.label[k] in CLOSED)


def ngram_tree(n: int = 2, lexical: int = 0, collapse: int = 0, ancestors: int = 0) -> Class:
    """NGramTree: the least tree over n words in a row (not the last such n), cut down to what holds them.

    lexical: words of none, closed-class, functional or all tags. With collapse what holds none of the words goes.
    """

    def run(v: View):
        def text(k: int, a: int, b: int) -> str:
            inside = v.start[k] < b and v.finish[k] > a
            if v.word[k] is not None:
                return f"({v.label[k]} {v.word[k]})" if inside and _wanted(v, k, lexical) else f"({v.label[k]})"
            kids = [c for c in v.kids[k] if not collapse or (v.start[c] < b and v.finish[c] > a)] if inside else []
            return "(" + " ".join([v.label[k], *(text(c, a, b) for c in kids)]) + ")"

        for a in range(len(v.leaves) - n):
            top = v.leaves[a]
            while v.finish[top] < a + n:
                top = v.parent[top]
            for _ in range(ancestors):
                top = v.parent[top] if top >= 0 else -1
            if top < 0:
                return
            yield (text(top, a, a + n),)

    return run


def head_tree(collapse: int = 1, lexical: int = 0, ancestors: int = 0, kind: int = 1) -> Class:
    """HeadTree: the maximal projection of each word; with collapse only children next to the way down to the word."""
    which = ("syntactic", "semantic")[kind]

    def run(v: View):
        children = v.heads[which][0]

        def text(k: int, at: int) -> str:
            if v.word[k] is not None:
                return f"({v.label[k]} {v.word[k]})" if lexical and v.start[k] == at else f"({v.label[k]})"
            return "(" + " ".join([v.label[k], *(text(c, at) for c in around(v.kids[k], at))]) + ")"

        def around(kids: list[int], at: int) -> list[int]:
            if not collapse:
                return kids
            out = []
            for i, c in enumerate(kids):
                right = v.finish[kids[i + 1]] if i + 1 < len(kids) else v.finish[c]
                left = v.start[kids[i - 1]] if i else v.start[c]
                if right <= at:
                    continue
                if left > at:
                    break
                out.append(c)
            return out

        for at, k in enumerate(v.leaves):
            while v.parent[k] >= 0 and children[v.parent[k]] == k:
                k = v.parent[k]
            for _ in range(ancestors):
                k = v.parent[k] if k >= 0 else -1
            if k < 0:
                return
            yield (text(k, at),)

    return run


def agreement() -> Class:
    """SubjVerbAgr: tags of the head of the last NP before the VP, and of the clause's head."""

    def run(v: View):
        for k in v.phrases:
            if v.label[k] not in ("S", "SINV") or v.heads["syntactic"][1][k] < 0:
                continue
            subject = -1
            for c in v.kids[k]:
                if v.label[c] == "NP":
                    subject = c
                elif v.label[c] == "VP":
                    break
            if subject >= 0 and v.heads["semantic"][1][subject] >= 0:
                yield v.label[v.heads["semantic"][1][subject]], v.label[v.heads["syntactic"][1][k]]

    return run


def both_heads(words: int = 0) -> Class:
    """SynSemHeads: tags of the two heads of a node where they differ; with the first's word, or both words."""

    def run(v: View):
        for syn, sem in zip(v.heads["syntactic"][1], v.heads["semantic"][1], strict=True):
            if syn == sem or (words and syn < 0) or (words == 2 and sem < 0):
                continue
            one = [v.label[syn] if syn >= 0 else END, *([v.word[syn]] if words else [])]
            yield (*one, v.label[sem] if sem >= 0 else END, *([v.word[sem]] if words == 2 else []))

    return run


def parallel(ignore_tags: int = 0) -> Class:
    """CoPar: neighbouring conjuncts that match (1) or differ (0) down to each depth from 1 to 5."""

    def run(v: View):
        def pair(depth: int, a: int, b: int) -> int:
            if v.label[a] != v.label[b] or (v.word[a] is None) != (v.word[b] is None):
                return 0
            if depth == 1:
                return 1
            return -1 if v.word[a] is not None else rows(depth - 1, v.kids[a], v.kids[b])

        def rows(depth: int, a: list[int], b: list[int]) -> int:
            if ignore_tags:
                a, b = ([c for c in x if v.word[c] is None] for x in (a, b))
            found = [pair(depth, x, y) for x, y in zip(a, b, strict=False)]
            return 0 if len(a) != len(b) or 0 in found else 1 if 1 in found else -1

        for k in v.phrases:
            if v.coordination[k]:
                conjuncts = [c for c in v.kids[k] if not v.tree.is_punctuation(c) and v.label[c] not in CONJUNCTION]
                for depth in range(1, 6):
                    for a, b in zip(conjuncts, conjuncts[1:], strict=False):
                        if (m := pair(depth, a, b)) >= 0:
                            yield depth, m

    return run


def parallel_lengths() -> Class:
    """CoLenPar: differences of neighbouring conjuncts' lengths, within 5, and whether the second is the last child."""

    def run(v: View):
        for k in v.phrases:
            if v.coordination[k]:
                conjuncts = [c for c in v.kids[k] if not v.tree.is_punctuation(c) and v.label[c] not in CONJUNCTION]
                for a, b in zip(conjuncts, conjuncts[1:], strict=False):
                    more = v.finish[b] - v.start[b] - v.finish[a] + v.start[a]
                    yield max(-5, min(5, more)), int(b == v.kids[k][-1])

    return run


def local_context(left: int = 1, right: int = 1) -> Class:
    """RBContext: on or off the right branch, with the tags around the node's span."""

    def run(v: View):
        stack = [(0, 1)]
        while stack:
            k, on = stack.pop()
            yield (on, v.label[k], *_beside(v.tags, range(v.start[k] - 1, v.start[k] - 1 - left, -1)), *_beside(v.tags, range(v.finish[k], v.finish[k] + right)))
            kids = [c for c in v.kids[k] if not v.tree.is_punctuation(c)]
            stack += [(c, on if c == kids[-1] else 0) for c in kids]

    return run


#: Families of classes by the first part of a name; the other parts are the parameters.
CLASSES: dict[str, Callable[..., Class]] = {
    "Rule": rule, "NGram": ngram, "NNGram": head_ngram, "Word": word, "WProj": projection, "RightBranch": right_branch,
    "LeftBranchLength": lambda: branch_length("left"), "RightBranchLength": lambda: branch_length("right"), "Heads": head_pairs,
    "Neighbours": neighbours, "WordNeighbours": word_neighbours, "Edges": lambda *a: edges("tags", *a), "WordEdges": lambda *a: edges("words", *a),
    "Heavy": heavy, "NGramTree": ngram_tree, "HeadTree": head_tree, "SubjVerbAgr": agreement, "SynSemHeads": both_heads,
    "CoPar": parallel, "CoLenPar": parallel_lengths, "RBContext": local_context,
}


def register(name: str, family: Callable[..., Class]) -> None:
    """Add a family of classes (the extension point for features of one's own)."""
    if name in CLASSES:
        raise ValueError(f"there is a class {name}")
    CLASSES[name] = family


def build(name: str) -> Class:
    family, *parameters = name.split(":")
    if family not in CLASSES:
        raise ValueError(f"unknown feature class {family}")
    return CLASSES[family](*map(int, parameters))


def _all_edges(family: str, width: int = 2) -> list[str]:
    sizes = [(a, b, c, d) for a in range(width + 1) for b in range(width + 1) for c in range(width + 1) for d in range(width + 1) if a + b + c + d <= width]
    return [f"{family}:{binned}:{a}:{b}:{c}:{d}" for binned in (0, 1) for a, b, c, d in sizes]


_BASE = [
    "RightBranch", "Heavy", "CoPar:0", "CoLenPar", "Word:1", "Word:2", "WProj:0:0:1", "Rule:0:0:0:0:0:0:0:1", "Rule:0:1:0:0:0:0:0:1",
    "Rule:0:0:1:0:0:0:0:1", "Rule:0:0:0:1:0:0:0:1", "Rule:0:0:0:0:2:0:0:1", "Rule:0:0:0:0:0:2:0:1", "Rule:0:0:0:0:2:2:0:1",
    "NGram:1:1:0:1:0:0:0:1", "NGram:2:1:1:1:0:0:0:1", "NGram:3:1:1:1:0:0:0:1", "NGram:2:1:0:0:2:0:0:1", "NGram:2:1:0:0:0:2:0:1",
    "NGramTree:2:0:1:0", "NGramTree:2:3:1:0", "NGramTree:3:2:1:0", "HeadTree:1:0:0:0", "HeadTree:1:0:0:1", "HeadTree:1:1:0:1",
    "Heads:2:0:0:0", "Heads:2:1:1:0", "Heads:2:1:1:1", "Heads:3:0:0:0",
]
#: The classes with the head's place among neighbours that spnn adds.
_HEAD_NGRAMS = ["NNGram:1:1:1:1:0:1:0:0:0:1", "NNGram:2:1:1:1:1:1:0:0:0:1", "NNGram:3:1:1:1:1:1:0:0:0:1", "NNGram:2:1:1:1:0:0:2:0:0:1", "NNGram:2:1:1:1:0:0:2:2:0:1"]
_FULL = [*_BASE, *_all_edges("Edges"), *_all_edges("WordEdges")]
#: Named lists of classes of trees. full (the default), sp, spnn and nlogp are as rankers name them, each besides the parser's
#: own score (set_features adds it); base, wide and heads are smaller or other ones.
SETS: dict[str, list[str]] = {
    "full": _FULL,
    "sp": _FULL,
    "spnn": [*_BASE, *_HEAD_NGRAMS, *_all_edges("Edges"), *_all_edges("WordEdges")],
    "nlogp": [],
    "base": _BASE,
    "wide": [*_BASE, "NNGram:2:1:1:0", "NNGram:3:1:1:0", "LeftBranchLength", "RightBranchLength", "SubjVerbAgr", "SynSemHeads:0", "Neighbours:1:1", "WordNeighbours:1:1:1"],
    "heads": [n for n in _BASE if n.startswith("Heads")],
}


def row_features(tree: RowTree | None, classes: list[tuple[str, Class]]) -> Counter:
    """(class, feature text) of one tree with their counts."""
    out: Counter = Counter()
    if tree is not None:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(tree) + 1000))  # fragments are written recursively
    if tree is not None and (tree := tree.normal()) is not None:
        view = View(tree)
        for name, run in classes:
            out.update((name, " ".join(map(str, f))) for f in run(view))
    return out


def _names(classes: str | list[str]) -> list[str]:
    if isinstance(classes, str) and classes not in SETS:
        raise ValueError(f"unknown feature set {classes}")
    return SETS[classes] if isinstance(classes, str) else classes


def tree_features(parses: DataFrame, classes: str | list[str], key: tuple[str, ...] = ("sent_id", "k"), tree: str = "tree") -> DataFrame:
    """key, cls, feat, val of every parse: the set's features, computed where the row is. Trees that can't be read have none."""
    names = _names(classes)
    [build(n) for n in names]  # errors come here, not in a task
    kinds = ", ".join(f"`{c}` {parses.schema[c].dataType.simpleString()}" for c in key)

    def run(batches):
        built = [(n, build(n)) for n in names]
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, at, cls, feat, val = batch.slice(a, 512), [], [], [], []
                for i, text in enumerate(part.column("_tree").to_pylist()):
                    for (c, f), n in row_features(RowTree.read(text), built).items():
                        at.append(i)
                        cls.append(c)
                        feat.append(f)
                        val.append(float(n))
                rows = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in key), pa.array(cls, pa.string()), pa.array(feat, pa.string()), pa.array(val, pa.float64())], [*key, "cls", "feat", "val"])

    return parses.select(*key, F.col(tree).alias("_tree")).mapInArrow(run, f"{kinds}, cls string, feat string, val double")


def set_features(lists: DataFrame, classes: str | list[str] = "full", key: tuple[str, ...] = ("sent_id", "k"), tree: str = "tree") -> DataFrame:
    """key, cls, feat, val of a set's classes and of NLogP, the parser's own score; parses without a logprob lack the latter.

    Scores need no tree, so nlogp doesn't read any.
    """
    score = lists.where("logprob IS NOT NULL").select(*key, F.lit("NLogP").alias("cls"), F.lit("0").alias("feat"), (-F.col("logprob")).cast("double").alias("val"))
    return score.unionAll(tree_features(lists, classes, key, tree)) if _names(classes) else score


def feature_totals(parses: DataFrame, classes: str | list[str], tree: str = "tree", held: int = 200_000) -> DataFrame:
    """cls, feat, parses with the feature and the sum of its values. Counts are added up where rows are read before they move."""
    names = _names(classes)
    [build(n) for n in names]

    def run(batches):
        built = [(n, build(n)) for n in names]
        some: dict[tuple[str, str], list] = {}

        def flush():
            return pa.RecordBatch.from_pydict({
                "cls": pa.array([c for c, _ in some], pa.string()), "feat": pa.array([f for _, f in some], pa.string()),
                "parses": pa.array([x[0] for x in some.values()], pa.int64()), "total": pa.array([x[1] for x in some.values()], pa.float64()),
            })

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for f, n in row_features(RowTree.read(text), built).items():
                    x = some.setdefault(f, [0, 0.0])
                    x[0] += 1
                    x[1] += n
                if len(some) >= held:
                    yield flush()
                    some.clear()
        if some:
            yield flush()

    partial = parses.select(tree).mapInArrow(run, "cls string, feat string, parses long, total double")
    return partial.groupBy("cls", "feat").agg(F.sum("parses").alias("parses"), F.sum("total").alias("total"))


def probability_features(lists: DataFrame, bins: int = 7, base: float = 2.0, key: str = "sent_id") -> DataFrame:
    """key, k, cls, feat, val of NLogP, NLogCondP, BinnedLogCondP and InterpLogCondP, of parses with logprob and lcp (the log conditional probability)."""
    steps = -F.col("lcp") / F.lit(math.log(base))
    at = F.greatest(F.lit(1), F.least(F.lit(bins), steps.cast("int"))).cast("string")
    name = f"{bins}:{base:g}"
    each = F.array(*[F.struct(F.lit(c).alias("cls"), f.alias("feat"), v.cast("double").alias("val")) for c, f, v in (
        ("NLogP", F.lit("0"), -F.col("logprob")), ("NLogCondP", F.lit("0"), -F.col("lcp")), (f"BinnedLogCondP:{name}", at, F.lit(1.0)), (f"InterpLogCondP:{name}", at, steps),
    )])
    return lists.select(key, "k", F.explode(each).alias("f")).select(key, "k", "f.*")
