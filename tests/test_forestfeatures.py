"""Features drawn from many trees at once against the row-wise classes."""

import random

import pytest

from sylva.operators import forestfeatures as ff
from sylva.operators import treefeatures as tf

NAMES = ["RightBranch", "LeftBranchLength", "RightBranchLength", "Heads:2:1:1:0", "Heads:3:0:0:0", "Heads:3:1:0:1", "NGramTree:2:0:1:0", "HeadTree:1:0:0:1", "HeadTree:1:0:0:0", "CoPar:0", "NNGram:2:1:1", "NNGram:3:0:1", "NNGram:2:1:0:0:0:0:0:0:0:0"]


def random_tree(rng, depth=0):
    if depth > 6 or rng.random() < 0.3:
        return f"({rng.choice(['NN', 'VB', 'CC', ',', ':', '.', 'IN', 'DT', 'XYZ', '-NONE-'])} {rng.choice(['a', 'b', 'Éa', ';'])})"
    label = rng.choice(["NP", "NP", "VP", "S", "SBAR-TMP=2", "ODD", "CONJP"])
    return f"({label} {' '.join(random_tree(rng, depth + 1) for _ in range(rng.choice([1, 1, 2, 3, 3, 4])))})"


def test_totals_equal_the_row_classes(spark):
    rng = random.Random(3)
    texts = [f"(S1 (S {' '.join(random_tree(rng) for _ in range(rng.randrange(1, 5)))}))" for _ in range(300)]
    deep = "(S1 " + "(S (NP (NN a)) " * 300 + "(NP (NP (NN a) (CC and)) (CC or) (NP (NN b) (CC and)))" + ")" * 300 + ")"
    texts += [deep, deep, "(S1 (NN one))", "(NN one)", "(, ,)", "(S1 (S (-NONE- 0)))", "not a tree", None, "", "(S1 (NP (NP (DT a) (NN b)) (CC and) (NP (DT c) (NN d)) (, ,) (NP (NN e))))"]
    df = spark.createDataFrame([(t,) for t in texts], "tree string").repartition(2)
    rows = lambda x: sorted((r.cls, r.feat, r.parses, r.total) for r in x.collect())
    got, expected = rows(ff.feature_totals(df, NAMES)), rows(tf.feature_totals(df, NAMES))
    assert {n for n, *_ in expected} == set(NAMES)
    assert got == expected
    assert ff.feature_totals(df.limit(0), NAMES).count() == 0


def test_other_parameters_are_refused(spark):
    with pytest.raises(ValueError, match="NGramTree:3"):
        ff.feature_totals(spark.createDataFrame([("(S1 (NN a))",)], "tree string"), ["RightBranch", "NGramTree:3:0:1:0"])


SPANS = ["Word:1", "Word:2", "Word:3", "Rule:0:0", "Rule:0:1:0:0:0:0:0:1", "Rule:0:0:0:0:2:0:0:1", "Rule:0:1:0:0:1:1:0:0", "Rule:0:0:0:0:0:1:2:1", "Rule:0:0:0:0:0:0:1:0", "NGram:2:1:0:0:0:0:0:1", "NGram:3:0:0:0:0:0:0:0", "Neighbours:1:1", "Neighbours:2:0", "WordNeighbours:1:0:1", "WordNeighbours:0:2:2",
         "Edges:0:1:1:0:0", "Edges:1:0:0:1:1", "Edges:0:2:0:0:0", "Edges:0:0:0:0:2", "WordEdges:0:0:2:0:0", "WordEdges:1:0:0:0:1", "WordEdges:0:1:0:2:0", "Heavy"]


def test_classes_of_spans_equal_the_row_classes(spark):
    rng = random.Random(11)
    texts = [f"(S1 (S {' '.join(random_tree(rng) for _ in range(rng.randrange(1, 5)))}))" for _ in range(250)]
    texts += ["(S1 " + "(S (NP (NN a)) " * 200 + "(NN b)" + ")" * 200 + ")", "(S1 (NN one))", "(NN one)", "(, ,)", "(S1 (S (-NONE- 0)))", "not a tree", None, "", "(S1 (S (NP (DT the) (NN é)) (VP (VBZ is) (PP (IN of) (NP (NN x)))) (. .)))"]
    df = spark.createDataFrame([(t,) for t in texts], "tree string").repartition(2)
    rows = lambda x: sorted((r.cls, r.feat, r.parses, r.total) for r in x.collect())
    got, expected = rows(ff.feature_totals(df, SPANS)), rows(tf.feature_totals(df, SPANS))
    assert {n for n, *_ in expected} == set(SPANS)
    assert got == expected
