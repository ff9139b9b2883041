"""Table functions in SQL against the DataFrame operators."""

import pytest

from sylva.functions import tables
from sylva.functions.tokenizer import tokenize
from sylva.operators import trees
from sylva.sources import ptb

TREES = ["(S1 (S (NP (DT The) (NN crow)) (VP (VBZ sings)) (. .)))", "(S1 (NP (NP (NNS Crows)) (CC and) (NP (NNS dogs))))", "no tree", None, "(S1 (NN x))"]


@pytest.fixture(scope="module")
def views(spark):
    tables.register(spark)
    spark.createDataFrame(list(enumerate(TREES)), "sent_id long, tree string").createOrReplaceTempView("some_trees")
    lists = [(s, k, -float((s * 7 + k * 3) % 5), f"t{s}{k}") for s in range(20) for k in range(6)] + [(None, 0, -1.0, "n")]
    spark.createDataFrame(lists, "sent_id long, k int, logprob double, tree string").repartition(5).createOrReplaceTempView("some_lists")
    return lists


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_trees_and_tokens(spark, views):
    table = spark.table("some_trees")
    assert rows(spark.sql("SELECT t.sent_id, n.* FROM some_trees t, LATERAL tree_nodes(t.tree) n")) == rows(ptb.read_nodes(table))
    assert rows(spark.sql("SELECT t.sent_id, d.* FROM some_trees t, LATERAL tree_dependencies(t.tree) d")) == rows(trees.dependencies(table))
    assert [r[0] for r in spark.sql("SELECT DISTINCT t.sent_id FROM some_trees t, LATERAL tree_nodes(t.tree) n ORDER BY 1").collect()] == [0, 1, 4]
    got = spark.sql("SELECT pos, form FROM VALUES ('Is it so?'), (''), (null) AS v(s), LATERAL sentence_tokens(s)").collect()
    assert [r.form for r in sorted(got)] == tokenize("Is it so?")


@pytest.mark.parametrize("n", [1, 3, 99])
def test_best_parses(spark, views, n):
    want = []
    for s in {r[0] for r in views}:
        own = sorted((r for r in views if r[0] == s), key=lambda r: (-r[2], r[1]))
        want += [(*r, i) for i, r in enumerate(own[:n], 1)]
    assert rows(spark.sql(f"SELECT * FROM best_parses(TABLE(some_lists), {n})")) == sorted(map(str, want))


def test_wrong_calls(spark, views):
    with pytest.raises(Exception, match="sent_id, k and logprob"):
        spark.sql("SELECT * FROM best_parses(TABLE(some_trees), 2)").collect()
    with pytest.raises(Exception, match="how many"):
        spark.sql("SELECT * FROM best_parses(TABLE(some_lists), 0)").collect()
