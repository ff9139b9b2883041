"""Third relations against a walk over each tree."""

import pytest
from tests.test_treemodel import made

from sylva.functions import heads
from sylva.functions.rowtree import RowTree, simple_label
from sylva.operators import thirds as th


def walk(t, k, heads_first):
    """rel: third node of node k."""
    head = heads.head_children(t, heads.first_stage)
    lex = heads.lexical_heads(t, head)
    up = t.parent[k]
    over = t.parent[up]
    kids, h = t.kids[up], head[up]
    at = kids.index(k)
    out = {}
    if not heads_first:
        out[1] = up
    elif lex[up] != lex[k] and over >= 0 and lex[over] != lex[k]:
        out[1] = over
    if h >= 0:
        hx = kids.index(h)
        if abs(at - hx) > 1:
            out[2] = kids[at - 1] if at > hx else kids[at + 1]
        if abs(at - hx) == 1 and head[h] >= 0:
            inner = t.kids[h] if at < hx else t.kids[h][::-1]
            if inner[0] != head[h]:
                out[3] = inner[0]
            elif len(inner) > 1:
                out[3] = inner[1]
    if lex[up] != lex[k]:
        out[4] = up
    return out, lex


@pytest.mark.parametrize("heads_first", [True, False])
def test_relations_equal_a_walk(spark, heads_first):
    texts = [*made(50, 5), None, "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "sent_id long, tree string").repartition(3)
    got = {(r.sent_id, r.node, r.rel): (r.third, r.dep, r.above, r.term) for r in th.relations(df, heads_first).collect()}
    want = {}
    for s, text in enumerate(texts):
        t = RowTree.read(text)
        if t is not None:
            t = t.relabelled(simple_label)
            for k in range(1, len(t)):
                for rel, third in walk(t, k, heads_first)[0].items():
                    want[s, k, rel] = third, t.label[k], t.label[t.parent[k]], t.label[third]
    assert got == want and {r for *_, r in got} == {1, 2, 3, 4}


def test_words_by_rules(spark):
    texts = made(60, 9)
    df = spark.createDataFrame(list(enumerate(texts)), "sent_id long, tree string").repartition(3)
    rules = [("NP", "S", 1, "S1"), ("NN", "NP", 4, "NP"), ("NP", "S", 4, "S"), ("VP", "S", 2, "NP"), ("NP", "VP", 3, "NN")]
    special = [("DT", "NP", 2, "NN"), ("NP", "S", 2, "NP")]
    got = {(r.sent_id, r.node): r.word for r in th.third_words(df, True, rules, special).collect()}
    seen = set()
    for s, text in enumerate(texts):
        t = RowTree.read(text).relabelled(simple_label)
        for k in range(1, len(t)):
            found, lex = walk(t, k, True)
            holds = lambda r: (t.label[k], t.label[t.parent[k]]) == r[:2] and r[2] in found and t.label[found[r[2]]] == r[3]  # noqa: B023, E731
            word = lambda x: "^^" if lex[x] < 0 else "".join(c.lower() if c < "\x80" else c for c in t.word[lex[x]])  # noqa: B023, E731
            rule = next((r for r in rules if holds(r)), None)
            want = word(t.parent[k]) if any(map(holds, special)) else word(found[rule[2]]) if rule else "^^"
            if found:
                assert got[s, k] == want
                seen.add(rule)
    assert len(seen) >= 4


def test_rule_table(spark):
    assert len(th.SPECIAL) == 111 and len(set(th.SPECIAL)) == len(th.SPECIAL)
    assert th.rule_table(spark, [*th.THIRDS, th.THIRDS[0]]).count() == len(th.THIRDS)
    with pytest.raises(ValueError, match="relation"):
        th.rule_table(spark, [("A", "B", 5, "C")])


def test_totals_are_those_of_the_rules_by_node(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate([*made(60, 9), None, "none", "(S1 (NN a))"])), "sent_id long, tree string").repartition(3)
    rules = [("NP", "S", 1, "S1"), ("NN", "NP", 4, "NP"), ("NP", "S", 4, "S"), ("VP", "S", 2, "NP"), ("NP", "VP", 3, "NN"), ("NP", "S", 1, "S1")]
    held = th.thirds(th.relations(df), th.rule_table(spark, rules))
    want = held.groupBy("dep", "above", "rel", "term", F.col("third_word").alias("word")).agg(F.count("*").alias("n"), F.sum("third").alias("thirds"))
    got = th.third_totals(df, rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 4
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="relation"):
        th.third_totals(df, [("A", "B", 5, "C")])
