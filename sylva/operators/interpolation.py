"""Interpolation weights of two backoff levels, by expectation maximisation over buckets of context counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import bucket


def paired_levels(counts: DataFrame, low: str = "c1", high: str = "c2", outcome: str = "y") -> DataFrame:
    """n, g_low, g_high, bucket for each (contexts, outcome) of counting.context_counts(): events are kept as counts."""
    one = counts.where("level = 1").select(low, outcome, F.col("g").alias("g_low"))
    two = counts.where("level = 2").select(low, high, outcome, F.col("cnt").alias("n"), F.col("g").alias("g_high"), F.col("tot"))
    return two.join(one, [low, outcome]).select("n", "g_low", "g_high", bucket(F.col("tot") / F.lit(10.0)).alias("bucket"))


def em_pass(pairs: DataFrame, weights: dict[int, float], start: float = 0.5) -> DataFrame:
    """bucket, n, lam: the share of the high level in the events of each bucket under the weights (start where there's none)."""
    lam = F.lit(start)
    for b, w in sorted(weights.items()):
        lam = F.when(F.col("bucket") == b, F.lit(float(w))).otherwise(lam)
    high, low = lam * F.col("g_high"), (1 - lam) * F.col("g_low")
    return pairs.withColumn("_p", F.when(high + low > 0, high / (high + low)).otherwise(0.0)).groupBy("bucket").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("_p")) / F.sum("n")).alias("lam"))


def fit_weights(pairs: DataFrame, rounds: int = 10) -> dict[int, float]:
    """Weights by bucket; the driver gets a row for each of the 15 buckets and pass."""
    weights: dict[int, float] = {}
    for _ in range(rounds):
        weights = {r.bucket: r.lam for r in em_pass(pairs, weights).collect()}
    return weights
