"""Feature classes, heads and changes on known trees."""

import pytest

from sylva.functions import heads
from sylva.functions.rowtree import RowTree, label_parts, simple_label
from sylva.operators import treefeatures as tf

T = "(S1 (S (NP-SBJ (DT The) (JJ red) (NN fox)) (VP (MD may) (VP (VB see) (NP (NP (DT a) (NN hen)) (, ,) (NP (CD two) (NNS geese)) (CC and) (NP (NNS ducks))) (PP (IN in) (NP (NNP May))))) (. .)))"


def features(name, text=T):
    return {f: n for (_, f), n in tf.row_features(RowTree.read(text), [(name, tf.build(name))]).items()}


def test_heads_of_the_ranker():
    t = RowTree.read(T).normal()
    for rule, top, nominal in (("syntactic", "may", "geese"), ("semantic", "see", "geese")):
        lexical = heads.lexical_heads(t, heads.head_children(t, heads.RULES[rule]))
        assert t.word[lexical[0]] == top
        phrase = next(k for k in range(len(t)) if t.kids[k] and t.word[t.kids[k][0]] == "two")
        assert t.word[lexical[phrase]] == nominal


def test_head_pairs_spread_over_conjuncts():
    got = features("Heads:2:1:1:1")
    # each conjunct hangs on the verb's phrase; what hangs on a coordination hangs on every conjunct's head
    assert got["NN hen VB see"] == got["NNS geese VB see"] == got["NNS ducks VB see"] == 1
    assert got["DT a NN hen"] == 1 and got["IN in VB see"] == 1
    assert features("Heads:3:0:0:1")["DT NN VB"] == 2  # The and a, below fox and hen, below see


def test_tree_fragments():
    got = features("NGramTree:2:0:1:0")
    assert got["(NP (DT) (JJ))"] == 1 and got["(S (NP (NN)) (VP (MD)))"] == 1 and "(S (VP (VP (PP (NP (NNP))))) (.))" not in got  # the last pair isn't counted
    assert "(NP (DT The) (JJ red))" in features("NGramTree:2:3:1:0") and "(NP (DT The) (JJ))" in features("NGramTree:2:2:1:0")
    assert features("HeadTree:1:0:0:1")["(NP (JJ) (NN))"] == 1
    assert "(PP (IN in) (NP))" in features("HeadTree:1:1:0:0")
    assert features("HeadTree:0:0:0:1")["(NP (DT) (JJ) (NN))"] == 1


def test_coordination():
    assert features("CoPar:0") == {"1 1": 2, "2 0": 2, "3 0": 2, "4 0": 2, "5 0": 2}
    assert features("CoLenPar") == {"0 0": 1, "-1 1": 1}
    same = "(S1 (S (NP (NP (DT a) (NN b)) (CC or) (NP (DT c) (NN d)))))"
    assert features("CoPar:0", same) == {"1 1": 1, "2 1": 1} and features("CoPar:1", same) == {"1 1": 1}


def test_others():
    assert features("SubjVerbAgr") == {"NN MD": 1}
    assert features("SynSemHeads:0")["MD VB"] == 3 and features("SynSemHeads:2")["MD may VB see"] == 3
    assert features("WProj:0:0:1")["fox NP S"] == 1 and features("WProj:0:1:1")["see VB VP VP S S1"] == 1
    assert features("NNGram:2:1:1:0:0:0:0:0:0:0")["DT JJ *PREHEAD* 1 _ NP"] == 1
    assert features("Rule:1")["DT NN _ *CHILD* NP , NP CC NP _ NP"] == 1
    assert features("NGram:2:0:0:0:2:0:0:0")["JJ NN fox *PREHEAD* _ NP"] == 1
    assert features("RBContext:1:1")["1 S1 _ _"] == 1
    assert features("Neighbours:1:1")["2 NP DT ,"] == 1 and features("Edges:1:1:0:0:1")["2 NP VB ,"] == 1
    assert tf.row_features(None, []) == {} == features("Word:9")


def test_registry():
    with pytest.raises(ValueError, match="unknown feature class"):
        tf.build("Nothing:1")
    with pytest.raises(ValueError, match="there is a class"):
        tf.register("Word", tf.word)
    tf.register("Leaves", lambda: lambda v: iter([(len(v.leaves),)]))
    try:
        assert features("Leaves") == {"15": 1}
    finally:
        del tf.CLASSES["Leaves"]
    assert len(tf.SETS["full"]) == len(set(tf.SETS["full"])) == 29 + 60
    for name in {n for names in tf.SETS.values() for n in names}:
        tf.build(name)


def test_named_sets(spark):
    assert tf.SETS["sp"] == tf.SETS["full"] and set(tf.SETS["spnn"]) > set(tf.SETS["sp"]) and len(tf.SETS["spnn"]) == 29 + 60 + 5
    tree = "(S1 (S (NP (DT the) (NN cat)) (VP (VBD sat)) (. .)))"
    lists = spark.createDataFrame([(1, 0, -3.5, tree), (1, 1, None, tree), (2, 0, -1.0, None)], "sent_id long, k int, logprob double, tree string")
    assert {tuple(r) for r in tf.set_features(lists, "nlogp").collect()} == {(1, 0, "NLogP", "0", 3.5), (2, 0, "NLogP", "0", 1.0)}
    got = tf.set_features(lists, "spnn").collect()
    own = tf.row_features(RowTree.read(tree), [(n, tf.build(n)) for n in tf.SETS["spnn"]])
    assert {(r.cls, r.feat): r.val for r in got if r.k == 1} == own and {r.cls for r in got if r.sent_id == 2} == {"NLogP"}
    heads = {r.feat for r in got if r.cls == "NNGram:1:1:1:1:0:1:0:0:0:1" and r.k == 1}
    assert any(f.startswith("DT ") for f in heads) and any(f.startswith("NN ") for f in heads)
    with pytest.raises(ValueError, match="unknown feature set"):
        tf.set_features(lists, "none")


def test_deep_trees():
    deep = "(S1 " + "(SBAR " * 3000 + "(S (NP (NN x)) (VP (VB y)))" + ")" * 3000 + ")"
    got = tf.row_features(RowTree.read(deep), [(n, tf.build(n)) for n in {*tf.SETS["wide"], *tf.SETS["spnn"]}])
    assert got["RightBranch", "1"] == 3004 and RowTree.read(deep).write() == deep


def test_reading_and_changing():
    assert RowTree.read("((S (NN a)))").label == ["S1", "S", "NN"] and RowTree.read("(TOP (X (NN a)))").label[0] == "S1"
    for bad in ("", None, "(S1", "(S1 (", "(S1 ((", "(S1 a) (S1 b)", "x", "(())", ")", "(S1 (NP"):
        assert RowTree.read(bad) is None
    t = RowTree.read("(S1 (S (NP (-NONE- *)) (VP-X (VP (VB go) (-NONE- t)))))")
    assert t.finish[0] == 1 and t.normal().write() == "(S1 (S (VP (VP (VB go)))))" and t.normal().without_unary_repeats().write() == "(S1 (S (VP (VB go))))"
    assert RowTree.read("(S1 (-NONE- x))").without_empties() is None
    assert [simple_label(x) for x in ("NP-SBJ=2", "-LRB-", "-NONE-", "PP=1", "S|X", "NP")] == ["NP", "-LRB-", "-NONE-", "PP", "S", "NP"]
    assert label_parts("NP-SBJ=2|X^3") == ("NP", "-SBJ", "=2", "|X", "^3") and label_parts("-LRB-")[0] == "-LRB-"


def test_evaluation():
    gold = RowTree.read("(S1 (S (NP (NN a)) (, ,) (VP (VB b) (PRT (RP c))) (. .)))")
    test = RowTree.read("(S1 (S (NP (NN a) (, ,)) (VP (VB b) (ADVP (RP c))) (. .)))")
    assert gold.rebased_spans() == test.rebased_spans() == {(0, 3, "S"): 1, (0, 1, "NP"): 1, (1, 3, "VP"): 1, (2, 3, "ADVP"): 1}
    ends = gold.punctuation_ends()
    assert ends == [0, 1, 1, 3, 4, 4] and (gold.moved_spans(ends) & test.moved_spans(ends)).total() == 4


def test_totals_of_arrays_are_those_of_rows(spark):
    from pyspark.sql import functions as F

    from sylva.operators import features

    rows = [(1, 0, ["a", "b", "a", None]), (1, 1, ["a"]), (2, 0, []), (3, 0, None), (4, 0, ["b", "b", "b", "c"])]
    df = spark.createDataFrame(rows, "sent_id long, k int, f array<string>")
    got = features.array_totals(df, "X", F.col("f"))
    assert sorted(map(tuple, got.collect())) == [("X", "a", 2, 3.0), ("X", "b", 2, 4.0), ("X", "c", 1, 1.0)]
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(sent_id") == 0
