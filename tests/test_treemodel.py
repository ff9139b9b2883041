"""Events, probabilities and scores of trees as a plan against the row-wise functions of the conditional model."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylva.functions import heads
from sylva.functions.rowtree import RowTree, simple_label
from sylva.operators import conditional as co
from sylva.operators import treemodel as tm


def random_tree(rng, depth=0):
    if depth > 5 or rng.random() < 0.35:
        tag = rng.choice(["NN", "NNS", "VB", "AUX", "DT", "CC", ",", "``", "''", ".", "IN", "XYZ", "-NONE-"])
        return f"({tag} {rng.choice(['is', 'Were', 'CROW', 'the', 'Éa', ';', ',', 'x'])})"
    label = rng.choice(["NP", "NP", "VP", "S", "S", "PP", "SBAR-TMP=2", "ODD", "ADVP", "NP-SBJ"])
    return f"({label} {' '.join(random_tree(rng, depth + 1) for _ in range(rng.choice([1, 1, 2, 3, 4])))})"


def made(n, seed):
    rng = random.Random(seed)
    return [f"(S1 (S {' '.join(random_tree(rng) for _ in range(rng.randrange(1, 4)))}))" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return [*made(60, 1), "(S1 (NN one))", "(S1 (S (NP (NP (NN a)) (CC and) (NP (NN b))) (VP (VP (VB c)) (, ,) (VP (VB d)))))", "not a tree", None, ""]


@pytest.fixture(scope="module")
def trees(spark, texts):
    return spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "sent_id long, k int, tree string").repartition(3)


def row_events(texts, calc):
    for k, text in enumerate(texts):
        t = RowTree.read(text)
        for y, ctx in co.events_of(t and t.relabelled(simple_label), calc):
            yield k, y, tuple(ctx)


def test_events_equal_the_row_functions(trees, texts):
    got = tm.tree_events(trees, key=("sent_id", "k")).collect()
    for calc in co.CALCS:
        assert Counter((r.sent_id, r.y, tuple(r.ctx)) for r in got if r.calc == calc) == Counter(row_events(texts, calc)), calc


def plain_tables(texts):
    counts = Counter()
    for calc in co.CALCS:
        for _, y, ctx in row_events(texts, calc):
            for level, path in enumerate(co.level_paths(calc), 1):
                counts[calc, level, tuple(ctx[p] for p in path), y] += 1
    totals, outcomes = Counter(), Counter()
    for (calc, level, path, _), n in counts.items():
        totals[calc, level, path] += n
        outcomes[calc, level, path] += 1
    return counts, totals, outcomes


class Buckets(dict):
    """Weights that are bucket / 15."""

    def get(self, key, default=None):
        return min(0.998, key[1] / 15)


@pytest.mark.parametrize(("weights", "factor"), [(None, None), ("some", None), ("some", 1.3)])
def test_probabilities_equal_the_chain(spark, trees, texts, weights, factor):
    known = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts[:30])], "sent_id long, k int, tree string")
    counts, totals, outcomes = plain_tables(texts[:30])
    rng = random.Random(8)
    table = None if weights is None else {(c, i, b): rng.random() for c in co.CALCS for i in range(1, 10) for b in range(15) if rng.random() < 0.9}
    tables = tm.level_tables(tm.tree_events(known, key=("sent_id", "k")))
    got = {(r.calc, tuple(r.ctx), r.y): r for r in tm.event_scores(tm.tree_events(trees, key=("sent_id", "k")), tables, table, factor).collect()}
    seen = 0
    for calc in co.CALCS:
        own = Buckets() if table is None else {(i, b): w for (c, i, b), w in table.items() if c == calc}
        for (y, ctx), n in Counter((y, ctx) for _, y, ctx in row_events(texts, calc)).items():
            values = []
            for level, path in enumerate(co.level_paths(calc), 1):
                at = (calc, level, tuple(ctx[p] for p in path))
                if at in totals:
                    values.append({"level": level, "tot": totals[at], "outcomes": outcomes[at], "g": counts[(*at, y)] / totals[at]})
            p = co.chain(values, own, calc, factor)
            r = got[calc, ctx, y]
            assert r.n == n and math.isclose(r.p, p, rel_tol=1e-12) and abs(r.micro - math.log2(p) * tm.MICRO) <= 0.51
            seen += 1
    assert seen == len(got)


def test_scores_are_sums(spark, trees, texts):
    key = ("sent_id", "k")
    tables = tm.level_tables(tm.tree_events(trees, key=key))
    each = tm.event_scores(tm.tree_events(trees, key=key), tables).collect()
    micro = {(r.calc, tuple(r.ctx), r.y): r.micro for r in each}
    got = {r.sent_id: r for r in tm.tree_scores(trees, tables, key=key).collect()}
    for calc in tm.TREE_CALCS:
        sums = Counter()
        for k, y, ctx in row_events(texts, calc):
            sums[k] += micro[calc, ctx, y]
        assert all(got[k][f"micro_{calc}"] == sums[k] for k in got)
    assert all(r.micro == sum(r[f"micro_{c}"] for c in tm.TREE_CALCS) for r in got.values())
    assert got.keys() == {k for k, t in enumerate(texts) if RowTree.read(t) is not None}
    sums = {r.calc: (r.n, r.micro) for r in tm.calc_scores(trees, tables).collect()}
    for calc in co.CALCS:
        events = list(row_events(texts, calc))
        assert sums[calc] == (len(events), sum(micro[calc, ctx, y] for _, y, ctx in events))
    inside = tm.inside_scores(trees, tables, key=key).collect()
    assert {r.sent_id: r.micro for r in inside if r.node == 0} == {k: r.micro for k, r in got.items()}
    by_node = Counter()
    for r in tm.tree_events(trees, tm.TREE_CALCS, key).collect():
        by_node[r.sent_id, r.node] += micro[r.calc, tuple(r.ctx), r.y]
    for r in inside:
        t = RowTree.read(texts[r.sent_id])
        below = [r.node]
        for x in below:
            below += t.kids[x]
        assert r.micro == sum(by_node[r.sent_id, x] for x in below)


def test_nothing_to_score(trees):
    tables = tm.level_tables(tm.tree_events(trees, key=("sent_id", "k")))
    assert tm.tree_scores(trees.limit(0), tables, key=("sent_id", "k")).collect() == []
    assert heads.TAGS and trees.where(F.col("tree").isNull()).count() == 1


def test_counted_events_are_the_events_by_group(spark, trees, texts):
    """Events of trees read together are counted before they move; a null group is one of its own."""
    by = {k: (None, "a", "b")[k % 3] for k in range(len(texts))}
    given = trees.withColumn("g", F.get(F.array(F.lit(None), F.lit("a"), F.lit("b")), (F.col("sent_id") % 3).cast("int")))
    got = {(r.g, r.calc, r.y, tuple(r.ctx)): r.n for r in tm.counted_events(given, by="g").collect()}
    assert got == Counter((by[k], calc, y, ctx) for calc in co.CALCS for k, y, ctx in row_events(texts, calc))
    assert tm.counted_events(trees.limit(0)).count() == 0
    whole = {(r.calc, r.y, tuple(r.ctx)): r.n for r in tm.counted_events(trees).collect()}
    assert whole == Counter((calc, y, ctx) for calc in co.CALCS for _, y, ctx in row_events(texts, calc))
    counted, plain = (sorted(map(tuple, tm.level_tables(e).collect())) for e in (tm.counted_events(trees), tm.tree_events(trees, key=("sent_id", "k"))))
    assert counted == plain
