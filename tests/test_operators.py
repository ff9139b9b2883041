"""Small cases of the operators and formats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.functions import text
from sylva.operators import losses, nbest, trees
from sylva.sources import formats, ptb

TREE = "(S1 (SINV (ADVP (RB Here)) (VP (VBZ comes)) (NP (NP (DT the) (NN bus)) (PP (TO to) (NP (NNP Bergen))))))"


@pytest.fixture
def nodes(spark):
    return ptb.read_nodes(spark.createDataFrame([(1, TREE), (2, "( (S (NN x)))")], "sent_id long, tree string"))


def test_read_and_write(nodes):
    rows = {(r.sent_id, r.node): r for r in nodes.collect()}
    assert rows[1, 0].label == "S1" and rows[1, 0].parent is None and (rows[1, 0].start, rows[1, 0].finish) == (0, 6)
    assert [rows[1, k].label for k in range(14)] == "S1 SINV ADVP RB VP VBZ NP NP DT NN PP TO NP NNP".split()
    assert [rows[1, k].parent for k in range(1, 14)] == [0, 1, 2, 1, 4, 1, 6, 7, 7, 6, 10, 10, 12]
    assert rows[2, 0].label == "S1"
    back = {r.sent_id: r.tree for r in ptb.write_trees(nodes).collect()}
    assert back == {1: TREE, 2: "(S1 (S (NN x)))"}


def test_leaves_heads_and_dependencies(nodes):
    leaves = {r.sent_id: (r.forms, r.tags) for r in trees.tokens_and_tags(nodes).collect()}
    assert leaves[1] == ("Here comes the bus to Bergen", "RB VBZ DT NN TO NNP")


def test_heads_and_dependencies(spark):
    df = spark.createDataFrame([(1, TREE), (2, "broken (")], "sent_id long, tree string")
    heads = {r.node: (r.lex_word, r.lex_start) for r in trees.row_heads(df).collect()}
    assert heads == {0: ("comes", 1), 1: ("comes", 1), 2: ("Here", 0), 4: ("comes", 1), 6: ("bus", 3), 7: ("bus", 3), 10: ("to", 4), 12: ("Bergen", 5)}
    assert [(r.gov, r.dep) for r in trees.dependencies(df).orderBy("i").collect()] == [(4, 5), (3, 2), (3, 4), (1, 0), (1, 3)]
    assert [(r.id, r.head) for r in trees.conll(df).orderBy("id").collect()] == [(1, 2), (2, 0), (3, 4), (4, 2), (5, 4), (6, 5)]
    assert [r.sent_id for r in ptb.errors(df).collect()] == [2]


def test_last_descendants(nodes):
    last = {r.node: r.last_desc for r in trees.last_descendants(nodes).where("sent_id = 1").collect()}
    assert last[0] == 13 and last[2] == 3 and last[4] == 5 and last[3] == 3 and last[6] == 13 and last[7] == 9


def test_parseval_counts_are_multisets(spark):
    gold = spark.createDataFrame([(1, 0, 2, "NP"), (1, 0, 2, "NP"), (1, 2, 3, "VP")], "sent_id long, start int, finish int, label string")
    test = spark.createDataFrame([(1, 0, 2, "NP"), (1, 2, 3, "PP")], "sent_id long, start int, finish int, label string")
    r = trees.ratios(trees.matched_spans(gold, test, ("sent_id",))).first()
    assert (r.n_gold, r.n_test, r.n_matched, r.precision, r.fscore) == (3, 2, 1, 0.5, 0.4)


def test_escapes_and_kv(spark):
    row = spark.createDataFrame([("a(b)[c]{d}", "1=2 5 7=0.5", "NP-SBJ=2")], "a string, b string, c string").select(
        text.unescape_brackets(text.escape_brackets(F.col("a"))).alias("a"), text.parse_kv(F.col("b")).alias("b"), text.write_kv(text.parse_kv(F.col("b"))).alias("w"), *[c.alias(n) for c, n in zip(text.term_parts(F.col("c")), ("t", "s"), strict=True)]
    ).first()
    assert row.a == "a(b)[c]{d}" and row.b == {"1": 2.0, "5": 1.0, "7": 0.5} and row.w == "1=2, 5, 7=0.5" and (row.t, row.s) == ("NP", "-SBJ=2")


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([(1, -1000.0), (1, -1001.0), (2, 3.0)], "sent_id long, s double")
    p = df.withColumn("p", nbest.softmax(F.col("s"))).groupBy("sent_id").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-12 for r in p)


def test_nbest_round_trip(spark):
    df = spark.createDataFrame([("x", 0, -1.5, "(S1 (S a))"), ("x", 1, -2.0, "(S1 (S b))"), ("y", 0, 0.0, "(S1 (S c))")], "sent_id string, k int, logprob double, tree string")
    assert sorted(map(tuple, formats.read_nbest(formats.write_nbest(df)).collect())) == sorted(map(tuple, df.collect()))


def test_feature_lines(spark):
    lines = spark.createDataFrame([(1, "G=3 N=2 P=4 W=3 0=1.5 7, P=5 W=1 8=2,")], "sent long, text string")
    rows = sorted(map(tuple, formats.read_features(lines).collect()))
    assert rows == [(1, 3.0, 0, 4.0, 3.0, {"0": 1.5, "7": 1.0}), (1, 3.0, 1, 5.0, 1.0, {"8": 2.0})]


def test_lbfgs_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x, value = losses.lbfgs(lambda v: (float(0.5 * (v - 1) @ a @ (v - 1)), a @ (v - 1)), np.zeros(3))
    assert np.allclose(x, 1, atol=1e-3) and value < 1e-6


def test_log_linear_fit_prefers_the_winner(spark):
    lists = spark.createDataFrame([(s, k, 1.0 if k == s % 2 else 0.2) for s in range(20) for k in (0, 1)], "sent_id long, k int, fscore double")
    values = spark.createDataFrame([(s, k, "good" if k == s % 2 else "bad", 1.0) for s in range(20) for k in (0, 1)], "sent_id long, k int, feat string, val double")
    weights, loss = losses.fit_log_linear(lists, values, ["good", "bad"], penalty=0.01, rounds=8)
    assert weights["good"] > 0 > weights["bad"] and loss < 20 * np.log(2)


def test_crossing_pairs(spark):
    import itertools

    spans = [(1, a, b) for a, b in itertools.combinations(range(7), 2)]
    df = spark.createDataFrame(spans, "sent_id long, start int, finish int")
    got = sorted((r.start, r.finish, r.gold_start, r.gold_finish) for r in trees.crossing_pairs(df, df).collect())
    assert got == sorted((a, b, c, d) for _, a, b in spans for _, c, d in spans if a < c < b < d or c < a < d < b)
