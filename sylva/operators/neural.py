"""A ranker with one hidden layer of logistic units, trained by gradient descent on the log loss of the best parses.

The driver holds features * hidden weights; each round is one pass in which every part of the data returns its summed gradient.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(x: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of rows of feature values, and the hidden units."""
    hidden = 1 / (1 + np.exp(-(x @ inner)))
    return hidden @ outer, hidden


def sentence_gradient(x: np.ndarray, gold: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss of one sentence's parses against gold shares, and its gradients."""
    s, hidden = scores(x, inner, outer)
    p = np.exp(s - s.max())
    p /= p.sum()
    d = p - gold
    return float(-(gold * np.log(np.maximum(p, 1e-300))).sum()), x.T @ (d[:, None] * outer[None] * hidden * (1 - hidden)), hidden.T @ d


def fit(lists: DataFrame, values: DataFrame, feats: list[str], hidden: int = 4, rounds: int = 30, rate: float = 0.5, seed: int = 5) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(inner, outer, losses by round) from lists (sent_id, k, fscore) and values (sent_id, k, feat, val)."""
    at = {f: i for i, f in enumerate(feats)}
    rng = np.random.default_rng(seed)
    inner, outer = rng.normal(0, 0.5, (len(feats), hidden)), rng.normal(0, 0.5, hidden)
    features = values.where(F.col("feat").isin(*feats) if len(feats) <= 1000 else F.lit(True)).groupBy("sent_id", "k").agg(F.collect_list(F.struct("feat", "val")).alias("x"))
    rows = lists.join(features, ["sent_id", "k"], "left").groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("k", "fscore", "x"))).alias("parses")).persist()
    losses = []
    try:
        for _ in range(rounds):

            def run(batches, inner=inner, outer=outer):
                gi, go, loss, n = np.zeros_like(inner), np.zeros_like(outer), 0.0, 0
                for batch in batches:
                    for parses in batch.column("parses").to_pylist():
                        f = np.array([p["fscore"] for p in parses])
                        if f.max() <= 0:
                            continue
                        x = np.zeros((len(parses), len(at)))
                        for r, p in enumerate(parses):
                            for e in p["x"] or ():
                                if e["feat"] in at:
                                    x[r, at[e["feat"]]] = e["val"]
                        gold = (f == f.max()) / (f == f.max()).sum()
                        value, a, b = sentence_gradient(x, gold, inner, outer)
                        loss, gi, go, n = loss + value, gi + a, go + b, n + 1
                vector = np.concatenate(([loss, n], gi.ravel(), go))
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(vector)), pa.int32()), "v": pa.array(vector)})

            total = np.zeros(2 + inner.size + outer.size)
            for r in rows.select("parses").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
                total[r.i] = r.v
            n = max(1.0, total[1])
            losses.append(total[0] / n)
            inner = inner - rate * total[2 : 2 + inner.size].reshape(inner.shape) / n
            outer = outer - rate * total[2 + inner.size :] / n
    finally:
        rows.unpersist()
    return inner, outer, losses
