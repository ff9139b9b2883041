"""Many trees at once against one at a time."""

import random

import pyarrow as pa
import pytest

from sylva.functions import heads
from sylva.functions.forest import Forest
from sylva.functions.rowtree import RowTree

LABELS = "S1 S NP VP PP NP-SBJ PP-LOC=1 SBAR ADVP PRT QP X CONJP DT NN NNS VBD IN CC , . : -NONE- -LRB- ROOT RBB AUX POS $".split()


def a_tree(r: random.Random, depth: int = 0) -> str:
    label = r.choice(LABELS)
    if depth > 6 or r.random() < 0.35:
        return f"({label} {r.choice(['a', 'é', 'dog', '“x”', '*', '-LRB-'])})"
    return f"({label} " + r.choice(["", " "]).join(a_tree(r, depth + 1) for _ in range(r.randint(1, 4))) + ")"


ODD = [None, "", "   ", "(S1 (S (NP a)))", "((S (NP a)))", "(TOP (NP a))", "(S (NP))", "(S (NP) (VP x))", "(S a b)", "(S a (NP b))", "(S (NP a)) (S (NP b))", "(S (NP a)", "(S (NP a)))", "word", "word (S a)",
       "(S (NP a) b)", "()", "(())", "((S (NP a)) (S (NP b)))", "(S (NP　a) (VP b))", "(S (-NONE- *))", "(S (NP (-NONE- *)) (VP x))", ")", "(", "(S\x1c(NP a))", "(S (-NONE- (NP a)))", "(S (-NONE- * (NP a)) (X y))"]


def texts() -> list[str | None]:
    r = random.Random(5)
    out = [*ODD, *(f"(S1 {a_tree(r)} {a_tree(r)})" for _ in range(300)), "(S " * 3000 + "(NN x)" + ")" * 3000]
    r.shuffle(out)
    return out


def by_row(f: Forest) -> dict:
    out = {}
    word, label, local, depth = f.word.to_pylist(), f.label.to_pylist(), f.local(f.parent).tolist(), f.depth.tolist()
    for i, row in enumerate(f.row.tolist()):
        a, b = int(f.first[i]), int(f.first[i + 1])
        out[row] = label[a:b], word[a:b], local[a:b], f.start[a:b].tolist(), f.finish[a:b].tolist(), depth[a:b]
    return out


def depths(t: RowTree) -> list[int]:
    out: list[int] = []
    for up in t.parent:
        out.append(out[up] + 1 if up >= 0 else 0)
    return out


@pytest.mark.parametrize("normal", [False, True])
@pytest.mark.parametrize("step", [1, 7, 1000])
def test_trees_are_row_trees(normal, step):
    ts = texts()
    for a in range(0, len(ts), step):
        part = ts[a : a + step]
        want = {i: t for i, x in enumerate(part) if (t := RowTree.read(x)) is not None and (not normal or (t := t.normal()) is not None)}
        assert by_row(Forest.read(pa.array(part, pa.string()), normal)) == {i: (t.label, t.word, t.parent, t.start, t.finish, depths(t)) for i, t in want.items()}


@pytest.mark.parametrize("rule", ["first", "syntactic", "semantic"])
def test_heads_are_those_of_row_trees(rule):
    ts = [x for x in texts() if x not in ODD]
    f = Forest.read(pa.array(ts, pa.string()), normal=rule != "first", simple=True)
    own = f.heads(rule)
    lexical, own = f.local(f.lexical(own)).tolist(), f.local(own).tolist()
    for i, row in enumerate(f.row.tolist()):
        t = heads.seen_by(RowTree.read(ts[row]), rule)
        a, b = int(f.first[i]), int(f.first[i + 1])
        children = heads.head_children(t, heads.RULES[rule])
        assert own[a:b] == children
        assert lexical[a:b] == heads.lexical_heads(t, children)


def test_a_slice_of_texts_is_read_from_its_place():
    ts = pa.array(["(S (NP a))", "(S (NP b) (VP c))", None, "(S (NP d))"])
    assert Forest.read(ts.slice(1, 2)).word.to_pylist() == [None, "b", "c"]
    assert len(Forest.read(ts.slice(0, 0))) == 0
