"""Unit rules and the perceptron."""

from sylva.operators import perceptron, units
from sylva.sources import ptb


def test_unit_rules(spark):
    trees = [(k, "(S1 (S (NP (NP (NN a)))(VP (S (VP (VB b))))))") for k in range(5)] + [(9, "(S1 (VP (S (NN x))))")]
    nodes = ptb.read_nodes(spark.createDataFrame(trees, "sent_id long, tree string"))
    counts = {(r.parent, r.child): r.cnt for r in units.unary_counts(nodes).collect()}
    assert counts == {("S1", "S"): 5, ("S", "VP"): 5, ("VP", "S"): 6, ("S1", "VP"): 1}
    assert units.order_labels([(a, b, n) for (a, b), n in counts.items()]) == {("VP", "S"), ("S1", "S")}
    assert units.order_labels([("A", "B", 9), ("B", "C", 8), ("C", "A", 7)]) == {("A", "B"), ("B", "C"), ("A", "C")}


def test_perceptron(spark):
    lists = spark.createDataFrame([(s, k, 1.0 if k == s % 2 else 0.3) for s in range(40) for k in (0, 1)], "sent_id long, k int, fscore double")
    values = spark.createDataFrame([(s, k, "good" if k == s % 2 else "bad", 1.0) for s in range(40) for k in (0, 1)], "sent_id long, k int, feat string, val double")
    w = {r.feat: r.w for r in perceptron.fit_perceptron(lists, values, epochs=2, parts=3).collect()}
    assert w["good"] > 0 > w["bad"]


def plain_fit(lists, values, epochs, parts, part_of, burn_in, reduce, decay, factors):
    """Parameter mixing in plain Python, with every weight in every part."""
    import zlib

    sents = sorted({s for s, *_ in lists})
    x = {(s, k): {} for s, k, _ in lists}
    for s, k, f, v in values:
        x[s, k][f] = v
    weights, kept = {}, []
    for epoch in range(epochs):
        total = dict.fromkeys({f for _, _, f, _ in values}, 0.0)
        for p in range(parts):
            own = sorted((s for s in sents if part_of[s] == p), key=lambda s: (zlib.crc32(f"{epoch} {s}".encode()), str(s)))
            w = perceptron._sweep([[(f, x[s, k]) for t, k, f in sorted(lists) if t == s] for s in own], weights, reduce**epoch, decay, factors)
            for f in total:
                total[f] += w.get(f, 0.0) * len(own) / len(sents)
        weights = total
        kept += [weights] if epoch >= burn_in else []
    return {f: sum(w[f] for w in kept) / len(kept) for f in weights} if burn_in else weights


def test_weights_in_tables_equal_weights_in_memory(spark):
    import random

    import pytest
    from pyspark.sql import functions as F

    rng = random.Random(6)
    lists = [(s, k, round(rng.random(), 2)) for s in range(60) for k in range(rng.randint(1, 4))]
    values = [(s, k, f"C{f % 3}:{f}", float(rng.randint(1, 3))) for s, k, _ in lists for f in rng.sample(range(25), rng.randint(0, 6))]
    frames = spark.createDataFrame(lists, "sent_id long, k int, fscore double").repartition(5), spark.createDataFrame(values, "sent_id long, k int, feat string, val double").repartition(4)
    for parts, burn_in, factors in ((1, 0, None), (4, 2, {"C1": 0.5})):
        part_of = {r.sent_id: r.p for r in frames[0].select("sent_id", F.pmod(F.xxhash64("sent_id"), F.lit(parts)).alias("p")).distinct().collect()}
        got = {r.feat: r.w for r in perceptron.fit_perceptron(*frames, 4, parts, burn_in, 0.8, 0.99, factors).collect()}
        assert got == pytest.approx(plain_fit(lists, values, 4, parts, part_of, burn_in, 0.8, 0.99, factors), abs=1e-9) and any(got.values())


def test_pretty():
    import pytest

    from sylva.operators import pretty

    tree = "(S1 (S (NP (DT the) (NN cat)) (VP (VB sat) (PP (IN on) (NP (DT the) (NN mat))))))"
    text = pretty.pretty(tree, 40)
    assert max(map(len, text.split("\n"))) <= 40 + 8 and " ".join(text.split()) == tree and text.count("\n") >= 2
    assert pretty.pretty(tree, 200) == tree
    for bad in ("(S (NP", "a) b", "(S a) (S b)"):
        with pytest.raises(ValueError):
            pretty.pretty(bad)
