"""What is computed where a tree's row is, against the same by joins or one tree at a time; and that nothing moves for it."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.functions.rowtree import RowTree, simple_label
from sylva.operators import conditional, lists, nbest, trees, units
from sylva.plans import catalog, nested
from sylva.plans import treebank as tb
from sylva.sources import ptb
from tests.test_forest import texts

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(i, x) for i, x in enumerate(texts()) if x != "(S a (NP b))" and (x is None or len(x) < 10_000)]
    return spark.createDataFrame(rows, "sent_id int, tree string"), rows


@pytest.mark.parametrize("make", [nested.pairs, nested.lists, catalog._scored, lambda s, d: trees.row_subtrees(nested.trees(s, d)), lambda s, d: trees.row_last_descendants(tb.trees(s, d))])
def test_nothing_is_joined_or_dealt_by_key(spark, make):
    text = plan(make(spark, SF))
    assert "Join" not in text and "hashpartitioning" not in text


def test_merged_lists_are_dealt_once(spark):
    n = nested.lists(spark, SF)
    assert plan(lists.merge_by_tree({"a": n.where("k <> 1"), "b": n.where("k <> 0")})).count("hashpartitioning") == 1
    small = spark.createDataFrame([(1, "(S (A x))", 1.0), (2, "(S (A y))", 2.0)], "sent_id int, tree string, logprob double")
    assert {tuple(r) for r in nbest.merge_lists({"a": small, "b": small.where("sent_id = 1")}, ["sent_id", "tree"], "logprob").collect()} == {(1, "(S (A x))", 1.0, 1.0), (2, "(S (A y))", 2.0, 0.0)}


def test_children_and_descendants(sample):
    df, rows = sample
    found = {(r.sent_id, r.node): (r.label, r.children) for r in trees.row_subtrees(df).collect()}
    last = {(r.sent_id, r.node): r.last_desc for r in trees.row_last_descendants(df).collect()}
    kids, ends = {}, {}
    for i, x in rows:
        if (t := RowTree.read(x)) is not None:
            for k in reversed(range(len(t))):
                ends[i, k] = ends[i, t.kids[k][-1]] if t.kids[k] else k
                if t.kids[k]:
                    kids[i, k] = t.label[k], t.kids[k]
    assert found == kids
    assert last == ends


def test_unary_rules(sample):
    df, _ = sample
    want = {tuple(r) for r in units.unary_counts(ptb.read_nodes(df)).collect()}
    assert want and {tuple(r) for r in units.row_unary_counts(df).collect()} == want


def test_shapes(sample):
    import re

    df, rows = sample
    want = {i: t and re.sub(r" [^\s()]+\)", ")", t.relabelled(simple_label).write()) for i, x in rows for t in [RowTree.read(x)]}
    assert {r.sent_id: r.shape for r in lists.shapes(df, "sent_id").collect()} == want


def test_context_functions(sample):
    df, rows = sample
    nodes, events, deeper = Counter(), Counter(), Counter()
    for i, x in rows:
        if (t := RowTree.read(x)) is not None:
            c = conditional.Contexts(t.relabelled(simple_label))
            for k in range(len(t)):
                own = c.node(k)
                nodes[i, own["t"], own["l"], own["m"], own["b"], own["Bl"], own["Br"], int(own["size"])] += 1
            for y, ctx in conditional.events_of(c.t, "r"):
                events[i, y, tuple(ctx[:3])] += 1
                deeper[i, y, tuple(ctx[:5])] += 1
    assert Counter(tuple(r) for r in conditional.node_functions(df).collect()) == nodes
    assert Counter((r.sent_id, r.y, tuple(r.ctx)) for r in conditional.events(df, "r", levels=3).collect()) == events
    assert Counter((r.sent_id, r.y, tuple(r.ctx)) for r in conditional.events(df, "r", levels=5).collect()) == deeper


def test_first_levels_are_those_of_all(sample):
    df, _ = sample
    want = {tuple(r) for r in conditional.count_levels(conditional.events(df, "r"), "r").where("level <= 3").collect()}
    assert {tuple(r) for r in conditional.count_levels(conditional.events(df, "r", levels=3), "r", levels=3).collect()} == want


@pytest.mark.parametrize("way", ["rebased", "moved"])
def test_parseval_of_any_two_trees(spark, way):
    ts = [x for x in texts() if x is None or len(x) < 10_000]
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(ts, [*ts[1:], ts[0]], strict=True))] + [(len(ts) + i, a, a) for i, a in enumerate(ts)]
    want = {}
    for i, a, b in rows:
        g, t = RowTree.read(a), RowTree.read(b)
        if g is not None and t is not None:
            x, y = (g.rebased_spans(), t.rebased_spans()) if way == "rebased" else (g.moved_spans(g.punctuation_ends()), t.moved_spans(g.punctuation_ends()))
            want[i] = x.total(), y.total(), (x & y).total()
    got = trees.parseval(spark.createDataFrame(rows, "sent_id int, gold string, tree string"), way)
    assert {r.sent_id: (r.n_gold, r.n_test, r.n_matched) for r in got.collect()} == want


def test_common_spans(spark):
    counts = trees.matched_spans(*catalog._gold_and_test(spark, SF), ("sent_id", "k"))
    assert {tuple(r) for r in catalog._counted(spark, SF).drop("n").collect()} == {tuple(r) for r in counts.collect()}


def test_logprobs_are_the_lists(spark):
    assert nested.lists(spark, SF).select("sent_id", "k", "logprob").exceptAll(tb.nbest(spark, SF).select("sent_id", "k", "logprob")).count() == 0
    assert nested.pairs(spark, SF).select("sent_id", F.lit(tb.GOLD).alias("k"), F.col("gold").alias("tree")).distinct().exceptAll(nested.trees(spark, SF)).count() == 0
