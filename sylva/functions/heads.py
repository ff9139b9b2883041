"""Head children of phrases by tables of labels: the first-stage rule, syntactic and semantic heads, ordered lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from sylva.functions.rowtree import EMPTY, RowTree, simple_label

# For each parent label the children of the first, and of the second list of the first-stage rule.
FIRST = {
    "ADJP": "JJ JJR JJS", "ADVP": "RB RBB", "LST": "LS", "NAC": "NNS NN PRP NNPS NNP", "NX": "NNS NN PRP NNPS NNP",
    "NP": "NNS NN PRP NNPS NNP $ POS", "PP": "IN TO RP", "PRT": "RP", "S": "VP", "S1": "S", "SBAR": "IN WHNP", "SBARQ": "SQ VP",
    "SINV": "VP", "SQ": "MD AUX", "VP": "VB VBZ VBP VBG VBN VBD AUX AUXG TO MD", "WHADJP": "WRB",
    "WHADVP": "WRB", "WHNP": "WP WDT WP$", "WHPP": "IN TO",
}
SECOND = {
    "ADJP": "VBN RB", "NAC": "NP CD FW ADJP JJ", "NX": "NP CD FW ADJP JJ", "NP": "CD ADJP JJ NX", "QP": "$ NN", "S": "SINV SBARQ X",
    "PRT": "RB IN", "SBAR": "WHADJP WHADVP WHPP", "SBARQ": "S SINV X", "SINV": "SBAR", "SQ": "VP",
}
# Tags and phrase labels of the first stage, by class (open-class tags, other tags, punctuation, phrases).
OPEN_TAGS = frozenset("CD EX FW JJ JJR JJS NN NNS NNP NNPS RB RBR RBS SYM UH VB VBD VBG VBN VBP VBZ # $".split())
PHRASES = frozenset("ADJP ADVP CONJP FRAG INTJ LST NAC NP NX PP PRN PRT QP RRC S S1 SBAR SBARQ SINV SQ UCP VP WHADJP WHADVP WHNP WHPP X -NONE-".split())
TAGS = frozenset("AUX AUXG CC CD DT EX FW IN JJ JJR JJS LS MD NN NNS NNP NNPS PDT POS PRP PRP$ RB RBR RBS RP SYM TO UH VB VBD VBG VBN VBP VBZ WDT WP WP$ WRB # $ . , : -RRB- -LRB- `` '' STOP".split())
PUNCTUATION_TAGS = frozenset(". , : -RRB- -LRB- `` ''".split())

# Tiers of child labels by kind of parent, for syntactic and for semantic heads.
_ADJECTIVE = ("$ CD JJ JJR JJS RB RBR RBS WRB", "ADJP ADVP")
_PREPOSITION = ("IN RP TO", "PP")
SYNTACTIC = {
    "adjective": _ADJECTIVE, "conjunction": ("CC",), "interjection": ("INTJ UH",), "preposition": _PREPOSITION, "unknown": (),
    "noun": ("POS", "DT WDT WP$ WP PRP EX", "NN NNS", "$ NNP NNPS", "-NONE- QP NP NP$ WHNP", "CD IN JJ JJR JJS PDT RB PP"),
    "verb": ("AUX AUXG MD", "VB VBD VBG VBN VBP VBZ", "VP", "ADJP JJ S SINV SQ TO"),
}
SEMANTIC = {
    "adjective": _ADJECTIVE, "conjunction": ("CC",), "interjection": ("INTJ UH",), "preposition": _PREPOSITION, "unknown": (),
    "noun": ("EX NN NNS PRP WP", "$ NNP NNPS", "QP NP WP$", "CD DT IN JJ JJR JJS PDT POS RB WDT"),
    "verb": ("VP", "VB VBD VBG VBN VBP VBZ", "ADJP JJ S SINV SQ TO", "AUX AUXG MD"),
}
KINDS = {
    "adjective": "ADJP UCP WHADJP WHADVP", "conjunction": "CONJP", "interjection": "INTJ", "preposition": "PP PRT WHPP", "unknown": "X",
    "noun": "FRAG LST NAC NML NP NX PRN QP WHNP", "verb": "ADVP ROOT RRC S SBAR SBARQ SINV SQ S1 VP",
}
RIGHT_HEADED = frozenset("NN NNS NNP NNPS $".split())
# The same for German; both kinds of heads are alike there.
GERMAN = {
    "adjective": ("CARD ORD ADJA ADJD ADV PAV PROAV", "AA AP AVP"), "conjunction": ("KOUI KOUS KON KOKOM",), "interjection": ("ITJ",), "unknown": (),
    "noun": ("ART", "CARD ORD FM", "NN NE", "PDS PDAT PIS PIAT PIDAT PPER PPOSS PPOSAT", "PRELS PRELAT PRF", "PWS PWAT PWAV", "XY SGML SPELL TRUNC --", "NP"),
    "preposition": ("APPR APPRART", "APPO", "APZR", "PTKZU PTKNEG PTKVZ PTKANT PTKA", "PP"),
    "verb": ("VAFIN VAIMP VAINF VAPP VMFIN VMINF VMPP", "VVFIN VVIMP VVINF VVIZU VVPP", "VP", "S S1 VZ"),
}
GERMAN_KINDS = {
    "adjective": "AA AP AVP MTA", "conjunction": "CAC CAP CAVP CCP CNP CO CPP CS CVP CVZ", "noun": "-- MPN NM NP QL", "preposition": "PP",
    "unknown": "DL ISU", "verb": "CH S S1 VP VZ",
}

HeadRule = Callable[[RowTree, int], int]
#: Rules that are tables of tiers, with what by_tiers() takes.
TIERS = {"syntactic": (SYNTACTIC, KINDS, RIGHT_HEADED), "semantic": (SEMANTIC, KINDS, frozenset()), "german": (GERMAN, GERMAN_KINDS, frozenset(["NN", "NE"]))}
LEFTMOST = ("verb", "preposition")


def first_stage(tree: RowTree, k: int) -> int:
    """The head child of a phrase by the first-stage rule; -1 if it has none.

    Children are ranked, lists first, then the parent's own label, tags, phrases, PP and punctuation; a later child wins a
    tie, save that a PP keeps its first child of the first list, and a phrase the first child with its own label.
    """
    label, best, found = tree.label[k], 10, -1
    first, second = FIRST.get(label, "").split(), SECOND.get(label, "").split()
    for c in tree.kids[k]:
        x = tree.label[c]
        if x not in TAGS and x not in PHRASES:
            rank = 11
        elif label == "PP" and best == 1:
            rank = 10
        elif x in first:
            rank = 1
        elif best <= 2:
            rank = 10
        elif x == label:
            rank = 2
        elif x in second:
            rank = 3
        else:
            rank = 4 if x in TAGS and x not in PUNCTUATION_TAGS else 5 if x in PHRASES and x != "PP" else 6 if x in PHRASES else 7
        if rank <= best:
            best, found = rank, c
    return found


def by_tiers(tiers: dict[str, tuple[str, ...]], kinds: dict[str, str], right_headed: frozenset = frozenset(), leftmost: tuple[str, ...] = LEFTMOST) -> HeadRule:
    """The rule of a table of tiers: the first tier with a child among the parent's children decides.

    Of a tier's children the leftmost for the kinds in `leftmost`, else the rightmost; for nouns with right_headed the leftmost
    that isn't in it. Without any, the last preterminal that isn't punctuation, or the last child that isn't.
    """
    kind_of = {label: kind for kind, labels in kinds.items() for label in labels.split()}
    sets = {kind: [frozenset(t.split()) for t in ts] for kind, ts in tiers.items()}

    def head(tree: RowTree, k: int) -> int:
        kids = tree.kids[k]
        if len(kids) == 1 and tree.label[kids[0]] == EMPTY:
            return kids[0]
        kind = kind_of.get(tree.label[k], "unknown")
        for tier in sets[kind]:
            inside = [c for c in kids if tree.label[c] in tier]
            if inside:
                if kind in leftmost:
                    return inside[0]
                if kind == "noun" and right_headed:
                    return next((c for c in inside if tree.label[c] not in right_headed), inside[-1])
                return inside[-1]
        rest = [c for c in kids if not tree.is_punctuation(c)]
        return next((c for c in reversed(rest) if tree.word[c] is not None), rest[-1] if rest else -1)

    return head


syntactic, semantic, german = (by_tiers(*TIERS[kind]) for kind in ("syntactic", "semantic", "german"))


def by_lists(lists: dict[str, list[str]]) -> HeadRule:
    """The rule of ordered lists 'R label label' or 'L label': the first list with a child decides, its last or first such child.

    A list without labels takes the last or first child. Without a list S1 takes its last child, others have no head.
    """

    def head(tree: RowTree, k: int) -> int:
        kids = tree.kids[k]
        for line in lists.get(tree.label[k], ()):
            side, *labels = line.split()
            inside = [c for c in kids if tree.label[c] in labels] if labels else kids
            if inside:
                return inside[-1] if side == "R" else inside[0]
        return kids[-1] if tree.label[k] == "S1" and kids else -1

    return head


RULES: dict[str, HeadRule] = {"first": first_stage, "syntactic": syntactic, "semantic": semantic, "german": german}


def _first_key(up: str, x: str) -> tuple[int, bool]:
    if x not in TAGS and x not in PHRASES:
        return -1, False
    if x in FIRST.get(up, "").split():
        return 1, up == "PP"
    if x == up:
        return 2, True
    if x in SECOND.get(up, "").split():
        return 3, False
    return (4 if x in TAGS and x not in PUNCTUATION_TAGS else 5 if x in PHRASES and x != "PP" else 6 if x in PHRASES else 7), False


def _tier_key(up: str, x: str, tiers, kinds, right_headed) -> tuple[int, bool]:
    kind = next((k for k, labels in kinds.items() if up in labels.split()), "unknown")
    left = kind in LEFTMOST or kind == "noun" and bool(right_headed) and x not in right_headed
    return next((i for i, t in enumerate(tiers[kind]) if x in t.split()), -1), left


def keys(rule: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The rule as tables by parent's and child's label: the child's rank (the least is the head; -1 for none of the rule's),
    and whether the first child of that rank wins, before one of that rank whose last wins."""
    find = _first_key if rule == "first" else lambda up, x: _tier_key(up, x, *TIERS[rule])
    rows = [[find(up, x) for x in names] for up in names]
    n = len(names)
    return np.array([r[0] for row in rows for r in row], np.int64).reshape(n, n), np.array([r[1] for row in rows for r in row], bool).reshape(n, n)


def head_children(tree: RowTree, rule: HeadRule) -> list[int]:
    """The head child of each node, -1 at preterminals and where there is none."""
    return [rule(tree, k) if tree.kids[k] else -1 for k in range(len(tree))]


def lexical_heads(tree: RowTree, heads: list[int]) -> list[int]:
    """The preterminal at the end of each node's chain of head children, whatever its length; -1 if the chain breaks off."""
    out = [-1] * len(tree)
    for k in range(len(tree) - 1, -1, -1):
        out[k] = k if tree.word[k] is not None else out[heads[k]] if heads[k] >= 0 else -1
    return out


def dependencies(tree: RowTree, lexical: list[int]) -> list[tuple[int, int]]:
    """(governor, dependent) as preterminals: each child whose head isn't its parent's hangs on that; inner phrases first."""
    return [(lexical[k], lexical[c]) for k in range(len(tree) - 1, -1, -1) for c in tree.kids[k] if lexical[c] != lexical[k] and lexical[c] >= 0 and lexical[k] >= 0]


def seen_by(tree: RowTree, rule: str) -> RowTree | None:
    """The tree that a rule looks at: labels without function tags, and for the ranker's rules no empties."""
    return tree.relabelled(simple_label) if rule == "first" else tree.normal()
