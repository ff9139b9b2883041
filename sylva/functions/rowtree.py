"""One tree in memory, as lists by node in pre-order. Kernels on whole rows read, change, measure and write it."""

from __future__ import annotations

import re
from collections import Counter

_MARKS = re.compile(r"[()]|[^\s()]+")
_SIMPLE = re.compile(r"(.[^-=|^]*)[-=|^].")
_PARTS = re.compile(r"(.[^-=|^]*)((?:-[^=|^]*)?)((?:=[^|^]*)?)((?:\|[^^]*)?)((?:\^.*)?)$")

#: Labels that stand for the root, and the classes of labels that operators tell apart.
ROOTS = ("S1", "TOP", "ROOT")
PUNCTUATION = frozenset("'' : # , . `` -LRB- -RRB-".split())
CONJUNCTION = frozenset("CC CONJP".split())
CLOSED = frozenset("CC DT EX IN MD PDT POS PRP PRP$ PRT RP TO UH WDT WP WP$ WRB $".split())
FUNCTIONAL = frozenset("CC DT EX IN MD POS PRP PRP$ PRT RP TO WDT WP WP$ WRB".split())
BOUNDING = frozenset("NP ROOT S SBAR".split())
SCORED_PUNCTUATION = frozenset(", : `` '' .".split())
EMPTY = "-NONE-"


def simple_label(label: str) -> str:
    """A label without function tags: NP for NP-SBJ=2; -LRB- stays."""
    m = _SIMPLE.match(label)
    return m.group(1) if m else label


def label_parts(label: str) -> tuple[str, str, str, str, str]:
    """Category, -tag, =number, |alternative and ^number of a label; the last four with their marks or empty."""
    m = None if label.startswith("-") else _PARTS.match(label)  # -LRB- has no parts
    return m.groups() if m else (label, "", "", "", "")


class RowTree:
    """label, word (None but at preterminals), parent (-1 at the root), kids, and start and finish in words (EMPTY has no width)."""

    __slots__ = ("finish", "kids", "label", "parent", "start", "word")

    def __init__(self) -> None:
        self.label: list[str] = []
        self.word: list[str | None] = []
        self.parent: list[int] = []
        self.kids: list[list[int]] = []
        self.start: list[int] = []
        self.finish: list[int] = []

    def __len__(self) -> int:
        return len(self.label)

    def _add(self, label: str, parent: int) -> int:
        n = len(self.label)
        self.label.append(label)
        self.word.append(None)
        self.parent.append(parent)
        self.kids.append([])
        if parent >= 0:
            self.kids[parent].append(n)
        return n

    def _measure(self) -> RowTree:
        """Starts and ends from the leaves."""
        self.start, self.finish = [0] * len(self), [0] * len(self)
        at, stack = 0, [(0, False)] if len(self) else []
        while stack:
            node, done = stack.pop()
            if done:
                self.finish[node] = at
                continue
            self.start[node] = at
            if self.word[node] is not None and self.label[node] != EMPTY:
                at += 1
            stack.append((node, True))
            stack += [(k, False) for k in reversed(self.kids[node])]
        return self

    @classmethod
    def read(cls, text: str | None, root: str = "S1") -> RowTree | None:
        """The tree of a bracketed text; None if it isn't one tree. A root without a label, or TOP or ROOT, is `root`."""
        marks = _MARKS.findall(text or "")
        tree, here, expect = cls(), -1, False
        for mark in marks:
            if mark == "(":
                if not len(tree) and expect:  # a label-less root
                    here = tree._add(root, -1)
                elif expect:
                    return None
                elif len(tree) and here < 0:
                    return None
                expect = True
            elif mark == ")":
                if expect or here < 0:
                    return None
                here = tree.parent[here]
            elif expect:
                if not len(tree) and mark in ROOTS:
                    mark = root
                here, expect = tree._add(mark, here), False
            elif here < 0 or tree.kids[here]:
                return None
            else:
                tree.word[here] = mark
        if expect or here >= 0 or not len(tree):
            return None
        return tree._without([k for k in range(len(tree)) if tree.word[k] is None and not tree.kids[k]])

    def _without(self, dead: list[int]) -> RowTree | None:
        """A copy without these nodes and all that's left without leaves; None if nothing is left."""
        gone = set(dead)
        for k in range(len(self) - 1, -1, -1):  # children come after their parents
            if self.kids[k] and all(c in gone for c in self.kids[k]):
                gone.add(k)
        if 0 in gone or not len(self):
            return None
        if not gone:
            return self._measure()
        out, place = RowTree(), {}
        for k in range(len(self)):
            if k not in gone and (self.parent[k] < 0 or self.parent[k] in place):
                place[k] = out._add(self.label[k], place.get(self.parent[k], -1))
                out.word[place[k]] = self.word[k]
        return out._measure()

    def write(self, node: int = 0) -> str:
        """The bracketed text of a subtree."""
        out, stack = [], [(node, False)]
        while stack:
            k, done = stack.pop()
            if done:
                out.append(")")
                continue
            out.append(f" ({self.label[k]}" if k != node else f"({self.label[k]}")
            if self.word[k] is not None:
                out.append(f" {self.word[k]})")
            else:
                stack.append((k, True))
                stack += [(c, False) for c in reversed(self.kids[k])]
        return "".join(out)

    def leaves(self) -> list[int]:
        """Preterminals with a width, from left to right."""
        return [k for k in range(len(self)) if self.word[k] is not None and self.label[k] != EMPTY]

    # --- changes, each a copy

    def relabelled(self, label) -> RowTree:
        """label(old) for every node."""
        out = RowTree()
        out.label, out.word, out.parent, out.kids, out.start, out.finish = [label(x) for x in self.label], list(self.word), list(self.parent), [list(k) for k in self.kids], list(self.start), list(self.finish)
        return out

    def without_empties(self) -> RowTree | None:
        return self._without([k for k in range(len(self)) if self.word[k] is not None and self.label[k] == EMPTY])

    def without_unary_repeats(self) -> RowTree:
        """An only child with its parent's label, not a preterminal, gives its children to the parent."""
        up = {k: self.parent[k] for k in range(1, len(self)) if self.word[k] is None and len(self.kids[self.parent[k]]) == 1 and self.label[k] == self.label[self.parent[k]]}
        if not up:
            return self
        out, place = RowTree(), {}
        for k in range(len(self)):
            if k in up:
                place[k] = place[up[k]]
            else:
                place[k] = out._add(self.label[k], place.get(self.parent[k], -1))
                out.word[place[k]] = self.word[k]
        return out._measure()

    def normal(self) -> RowTree | None:
        """What the ranker sees: no empties, no function tags."""
        tree = self.without_empties()
        return tree and tree.relabelled(simple_label)

    # --- predicates

    def is_punctuation(self, k: int) -> bool:
        return self.word[k] is not None and self.label[k] in PUNCTUATION

    def is_coordination(self, k: int) -> bool:
        """A conjunction between its first and its last child."""
        return any(self.label[c] in CONJUNCTION for c in self.kids[k][1:-1])

    def is_adjunction(self, k: int) -> bool:
        """All children but punctuation have its label."""
        return self.word[k] is None and all(self.label[c] == self.label[k] or self.is_punctuation(c) for c in self.kids[k])

    def is_last(self, k: int) -> bool:
        """No sibling after it but punctuation."""
        siblings = self.kids[self.parent[k]] if self.parent[k] >= 0 else [k]
        return all(self.is_punctuation(c) for c in siblings[siblings.index(k) + 1 :])

    # --- evaluation

    def rebased_spans(self) -> Counter:
        """Labelled spans between words that aren't punctuation or empty; neither the root nor spans of no width; PRT is ADVP."""
        out, at = Counter(), [0] * (self.finish[0] + 1 if len(self) else 1)
        for k in self.leaves():
            at[self.finish[k]] = self.label[k] not in SCORED_PUNCTUATION
        for i in range(1, len(at)):
            at[i] += at[i - 1]
        for k in range(1, len(self)):
            if self.word[k] is None and at[self.finish[k]] > at[self.start[k]]:
                out[at[self.start[k]], at[self.finish[k]], "ADVP" if self.label[k] == "PRT" else self.label[k]] += 1
        return out

    def moved_spans(self, ends: list[int]) -> Counter:
        """Labelled spans of phrases but S1, their ends moved over punctuation; PRT is ADVP. ends: from punctuation_ends()."""
        move = lambda i: ends[i] if i < len(ends) else i
        return Counter((move(self.start[k]), move(self.finish[k]), "ADVP" if self.label[k] == "PRT" else self.label[k]) for k in range(len(self)) if self.word[k] is None and self.label[k] not in ("", "S1"))

    def punctuation_ends(self) -> list[int]:
        """For each place between words the place before the punctuation to its left (brackets don't count as such)."""
        ends = [0]
        for i, k in enumerate(self.leaves(), 1):
            ends.append(ends[i - 1] if self.label[k] in MOVED_OVER else i)
        return ends


#: Tags that count as punctuation when ends of spans are moved.
MOVED_OVER = frozenset(". , : `` ''".split())
