"""Gradients by differences, penalties, searches, and the perceptron's and the hidden layer's training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.operators import losses, neural, perceptron

X = {(1, 0): (1.0, 0.0, 2.0), (1, 1): (0.0, 1.0, 1.0), (1, 2): (0.5, 0.5, 0.0), (2, 0): (2.0, 1.0, 0.0), (2, 1): (0.0, 0.0, 1.0), (3, 0): (1.0, 1.0, 1.0), (3, 1): (1.0, 0.0, 1.0), (3, 2): (0.0, 2.0, 0.0)}
COUNTS = {(1, 0): (4, 4, 3), (1, 1): (4, 5, 4), (1, 2): (4, 4, 1), (2, 0): (6, 5, 5), (2, 1): (6, 6, 2), (3, 0): (3, 3, 3), (3, 1): (3, 3, 3), (3, 2): (3, 2, 0)}
W = np.array([0.3, -0.2, 0.1])


def frame(spark, w):
    rows = [(s, k, float(np.dot(x, w)), 2 * m / (g + t), g, t, m) for (s, k), x in X.items() for g, t, m in [COUNTS[s, k]]]
    return spark.createDataFrame(rows, "sent_id long, k int, score double, fscore double, n_gold int, n_test int, n_matched int")


@pytest.fixture
def values(spark):
    return spark.createDataFrame([(s, k, f"f{i}", v) for (s, k), x in X.items() for i, v in enumerate(x) if v], "sent_id long, k int, feat string, val double")


@pytest.mark.parametrize("name", sorted(losses.LOSSES))
def test_gradients(spark, values, name):
    value, gradient = losses.LOSSES[name]
    got = {r.feat: r.grad for r in gradient(frame(spark, W), values).collect()}
    for i in range(3):
        step = np.zeros(3)
        step[i] = 1e-4
        slope = (value(frame(spark, W + step)).first()[0] - value(frame(spark, W - step)).first()[0]) / 2e-4
        assert got[f"f{i}"] == pytest.approx(slope, abs=1e-6)


def test_orthants():
    a, b = np.diag([1.0, 4.0, 2.0]), np.array([3.0, 0.1, -2.0])
    evaluate = lambda x: (float(0.5 * x @ a @ x - b @ x), a @ x - b)
    x, value = losses.lbfgs(evaluate, np.zeros(3), l1=0.5)
    assert np.allclose(x, [2.5, 0.0, -0.75], atol=1e-4) and x[1] == 0.0
    assert value == pytest.approx(evaluate(x)[0] + 0.5 * np.abs(x).sum())
    assert losses.penalty(np.array([1.0, -2.0]), np.array([1.0, 0.5]))[0] == 3.0


def test_fit_with_factors(spark, values):
    lists = frame(spark, W).drop("score")
    w, _ = losses.fit_log_linear(lists, values, ["f0", "f1", "f2"], penalty=0.4, rounds=5, p=1)
    assert set(w) == {"f0", "f1", "f2"} and any(x != 0 for x in w.values())
    free, _ = losses.fit_log_linear(lists, values, ["f0", "f1", "f2"], penalty=0.01, rounds=3, loss="em", factors={"f0": 1e4})
    assert abs(free["f0"]) < 0.01


def test_searches():
    best, value = losses.search_factors(lambda f: -((np.log(f["a"]) - np.log(8)) ** 2) - (np.log(f["b"]) + 1) ** 2, ["a", "b"])
    assert abs(np.log(best["a"] / 8)) < 0.2 and abs(np.log(best["b"]) + 1) < 0.2 and value > -0.1
    assert losses.search_classes(lambda c: len(c & {"x", "y"}) - len(c - {"x", "y"}), ["x", "y", "z", "w"]) == ({"x", "y"}, 2)
    hill = {frozenset("ab"): 2.0, frozenset("a"): 1.0, frozenset("b"): 1.5, frozenset(): 5.0}  # a step down before the best
    calls = []
    assert losses.search_classes(lambda c: calls.append(c) or hill[frozenset(c)], ["a", "b"]) == (set(), 5.0) and len(calls) == 4


def test_trained_rankers(spark):
    lists = spark.createDataFrame([(s, k, 1.0 if k == s % 3 else 0.2) for s in range(30) for k in range(3)], "sent_id long, k int, fscore double")
    values = spark.createDataFrame([(s, k, f"C:{'good' if k == s % 3 else 'bad'}", 1.0) for s in range(30) for k in range(3)], "sent_id long, k int, feat string, val double")
    w = {r.feat: r.w for r in perceptron.fit_perceptron(lists, values, epochs=4, parts=2, burn_in=1, reduce=0.5, decay=0.99, factors={"C": 2.0}).collect()}
    assert w["C:good"] > 0 > w["C:bad"]
    _, _, track = neural.fit(lists, values, ["C:good", "C:bad"], rounds=12)
    assert track[-1] < 0.8 * track[0]
    x, gold, rng = np.random.default_rng(1).normal(size=(4, 2)), np.array([0.5, 0.5, 0, 0]), np.random.default_rng(2)
    inner, outer = rng.normal(size=(2, 3)), rng.normal(size=3)
    _, gi, go = neural.sentence_gradient(x, gold, inner, outer)
    for i in range(3):
        e = np.zeros(3)
        e[i] = 1e-6
        assert go[i] == pytest.approx((neural.sentence_gradient(x, gold, inner, outer + e)[0] - neural.sentence_gradient(x, gold, inner, outer - e)[0]) / 2e-6, abs=1e-5)
    d = np.zeros((2, 3))
    d[1, 2] = 1e-6
    assert gi[1, 2] == pytest.approx((neural.sentence_gradient(x, gold, inner + d, outer)[0] - neural.sentence_gradient(x, gold, inner - d, outer)[0]) / 2e-6, abs=1e-5)
    assert lists.where(F.lit(False)).count() == 0


def test_values_made_in_the_list_rows(spark):
    """features that follow from a list's row aren't joined, and give what a table of values gives."""
    from sylva.operators import evaluation

    rows = [(s, k, 2 + s % 3, -0.5 * k - s % 2, (s + 2 * k) % 4 / 4.0, (s + k) % 3 / 2.0, 3, 2 + k, (s + k) % 3) for s in range(12) for k in range(3)]
    lists = spark.createDataFrame(rows, "sent_id long, k int, n int, logprob double, fscore double, score double, n_gold int, n_test int, n_matched int")

    def values(x):
        each = x.withColumn("c", F.explode(F.sequence(F.lit(1), "n")))
        return each.select(*x.columns, F.when(F.col("c") > 1, "A").otherwise("B").alias("cls"), F.concat_ws(" ", "k", (F.col("c") + F.col("sent_id")) % 3).alias("feat"), F.lit(1.0).alias("val"))

    table = values(lists).groupBy("sent_id", "k", "cls", "feat").agg(F.sum("val").alias("val"))
    for name, (_, gradient) in losses.LOSSES.items():
        one, two = ({r.feat: round(r.grad, 9) for r in gradient(lists, v).collect()} for v in (values, table))
        assert one == two and len(one) == 9, name
    assert "Join" not in losses.pairwise_gradient(lists, values)._jdf.queryExecution().executedPlan().toString()
    weights = table.select("cls", "feat").distinct().withColumn("w", F.expr("(ascii(feat) + length(cls) * 3 + cast(right(feat, 1) as int)) % 5 - 2.0D"))
    one, two = (sorted(map(tuple, evaluation.class_ablation(lists, v, weights).collect())) for v in (values, table))
    assert one == two and len(one) == 3
