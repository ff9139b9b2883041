"""Comparison of two systems against plain arithmetic on the same draws."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sylva.operators import comparison as cmp


def f(g, t, m):
    return 2 * m / (g + t) if g + t else 0.0


def number(key, trial, seed):
    return int(hashlib.md5(f"{key}:{trial}:{seed}".encode()).hexdigest()[:8], 16)


def percentile(xs, q):
    xs = sorted(xs)
    at = q * (len(xs) - 1)
    low = int(at)
    return xs[low] + (at - low) * (xs[min(low + 1, len(xs) - 1)] - xs[low])


@pytest.fixture(scope="module")
def systems():
    rng = random.Random(3)
    one = lambda better: [(k, g := rng.randint(0, 9), t := rng.randint(0, 9), min(g, t, rng.randint(0, 9) + better)) for k in range(120)]
    return one(0), one(2)


def test_compare(spark, systems):
    a, b = systems
    frames = [spark.createDataFrame(x, "sent_id long, n_gold int, n_test int, n_matched int").repartition(5) for x in systems]
    got = cmp.compare(*frames, trials=60, seed=4).first()
    fa, fb = [f(*r[1:]) for r in a], [f(*r[1:]) for r in b]
    wins = [sum(x > y for x, y in zip(fa, fb, strict=True)), sum(x < y for x, y in zip(fa, fb, strict=True))]
    assert (got.n, got.better_a, got.better_b, got.tied) == (120, *wins, 120 - sum(wins))
    total = lambda rows, w: f(*(sum(w(r[0]) * r[c] for r in rows) for c in (1, 2, 3)))
    assert math.isclose(got.f_a, total(a, lambda _: 1)) and math.isclose(got.f_b, total(b, lambda _: 1))
    n = sum(wins)
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins) + 1)) / 2**n)
    assert math.isclose(got.binomial_p, exact, rel_tol=1e-9)
    bounds = cmp.poisson_bounds()
    samples = [[total(x, lambda k, t=t: sum(number(k, t, 4) >= y for y in bounds)) for t in range(1, 61)] for x in systems]
    for name, xs in zip("ab", samples, strict=True):
        assert math.isclose(got[f"low_{name}"], percentile(xs, 0.025)) and math.isclose(got[f"high_{name}"], percentile(xs, 0.975))
    gaps = []
    for t in range(61):
        sides = [(y, x) if t and number(x[0], t, 5) % 2 else (x, y) for x, y in zip(a, b, strict=True)]
        gaps.append(abs(total([x for x, _ in sides], lambda _: 1) - total([y for _, y in sides], lambda _: 1)))
    assert math.isclose(got.permutation_p, (sum(g >= gaps[0] - 1e-12 for g in gaps[1:]) + 1) / 61)


def test_draws_are_poisson():
    bounds = cmp.poisson_bounds()
    shares = [b / 2**32 for b in [0, *bounds, 2**32]]
    assert all(math.isclose(y - x, math.exp(-1) / math.factorial(k), abs_tol=1e-9) for k, (x, y) in enumerate(zip(shares, shares[1:], strict=False)))


@pytest.mark.parametrize(("wins", "losses"), [(0, 0), (1, 0), (3, 3), (91, 98), (219, 284), (5000, 5200), (40, 2000)])
def test_binomial(spark, wins, losses):
    n = wins + losses
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)
    got = spark.range(1).select(cmp.binomial_two_sided(F.lit(wins), F.lit(losses)).alias("p")).first().p
    assert math.isclose(got, exact, rel_tol=1e-8, abs_tol=1e-300)


def test_nothing_to_compare(spark, systems):
    empty = spark.createDataFrame([], "sent_id long, n_gold int, n_test int, n_matched int")
    got = cmp.compare(empty, empty, 10).first()
    assert got.n == 0 and got.f_a == 0 and got.binomial_p == 1.0 and got.low_a is None
