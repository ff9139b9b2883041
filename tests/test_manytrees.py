"""Trees changed, marked and counted many at a time against one at a time."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.test_forest import ODD, texts

from sylva.functions import heads
from sylva.functions.forest import Forest
from sylva.functions.rowtree import RowTree
from sylva.operators import forestfeatures as ff
from sylva.operators import trees
from sylva.sources import ptb


def normals() -> list[RowTree | None]:
    return [(t := RowTree.read(x)) and t.normal() for x in texts()]


def test_predicates_are_those_of_row_trees():
    g = ff.Grove(Forest.read(pa.array(texts(), pa.string()), normal=True))
    found = np.stack([g.f.punct, g.coordination(), g.adjunction(), g.last()], axis=1).tolist()
    own = normals()
    for i, row in enumerate(g.f.row.tolist()):
        t, a = own[row], int(g.f.first[i])
        assert found[a : a + len(t)] == [[t.is_punctuation(k), t.word[k] is None and t.is_coordination(k), t.is_adjunction(k), t.is_last(k)] for k in range(len(t))]


@pytest.mark.parametrize("change", ["same", "unary"])
def test_changed_trees_are_those_of_row_trees(spark, change):
    many = [*texts(), "(S1 (NP (NP (NP (NN a)))))", "(NP (NP a))", "(S1 (NP (NP (DT a) (NP (NP (NN b))))))"]
    df = spark.createDataFrame(list(enumerate(many)), "sent_id long, tree string").repartition(3)
    one = (lambda t: t.normal()) if change == "same" else lambda t: (x := t.normal()) and x.without_unary_repeats()
    got = ptb.changed_forests(df, (lambda f: f) if change == "same" else Forest.without_unary_repeats, normal=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ptb.changed_trees(df, one).collect()))


def test_marked_phrases_equal_a_walk(spark):
    many = [x for x in texts() if x not in ODD][:200]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(many, [*many[:100], *many[1:101]], strict=True))]
    pairs += [(500, "(S (NP (NP a)))", "(S (NP (NP (NP a))))"), (501, None, "(S (NP a))"), (502, "(S (NP a))", "no tree"), (503, "(S (X a))", "((S (NP b) (VP (VP c))))")]
    got = {r.sent_id: r.tree for r in trees.marked_diff(spark.createDataFrame(pairs, "sent_id long, gold string, tree string").repartition(3)).collect()}
    want = {}
    for i, gold, test in pairs:
        g, t = RowTree.read(gold), RowTree.read(test)
        if g is not None and t is not None:
            left = Counter((g.start[k], g.finish[k], g.label[k]) for k in range(len(g)) if g.word[k] is None)
            for k in range(len(t)):
                if t.word[k] is None:
                    span = t.start[k], t.finish[k], t.label[k]
                    left[span] -= 1
                    t.label[k] = t.label[k] if left[span] >= 0 else f"!{t.label[k]}!"
            want[i] = t.write()
    assert got == want and any("!" in x for x in want.values())


@pytest.mark.parametrize("rule", ["first", "syntactic", "semantic"])
def test_dependencies_and_heads_equal_a_walk(spark, rule):
    many = texts()
    df = spark.createDataFrame(list(enumerate(many)), "sent_id long, tree string").repartition(3)
    want, totals = [], Counter()
    for s, text in enumerate(many):
        t = RowTree.read(text)
        if t is not None and (t := heads.seen_by(t, rule)) is not None:
            own = heads.head_children(t, heads.RULES[rule])
            lexical = heads.lexical_heads(t, own)
            label = lambda k: t.label[k] if k >= 0 else "_"  # noqa: B023, E731
            totals.update((t.label[k], label(own[k]), label(lexical[k])) for k in range(len(t)) if t.word[k] is None)
            want += [(s, i, t.start[g], t.start[d], t.word[g], t.word[d]) for i, (g, d) in enumerate(heads.dependencies(t, lexical))]
    assert sorted(map(tuple, trees.dependencies(df, rule).collect())) == sorted(want)
    assert {r.distance: r.n for r in trees.dependency_distances(df, rule).collect()} == Counter(d - g for _, _, g, d, _, _ in want)
    assert {(r.label, r.head, r["lex"]): r.n for r in trees.head_totals(df, rule).collect()} == totals
    assert trees.dependency_distances(df.limit(0), rule).count() == 0
