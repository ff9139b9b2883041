"""Averaged perceptron for ranking, by parameter mixing: parts of the sentences train for themselves, and their weights are mixed in a table."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.sources.shared import written


def _sweep(sentences: Iterable[list[tuple[float, dict[str, float]]]], start: dict[str, float], rate: float = 1.0, decay: float = 1.0, factors: dict[str, float] | None = None) -> dict[str, float]:
    """One pass over sentences of (fscore, features): towards the best parse, away from a rival that scores as well.

    Steps are rate times the difference of f, times a factor by the first part of a feature's name; decay shrinks the rate after each sentence.
    """
    w, total, n = defaultdict(float, start), defaultdict(float), 0
    of = (lambda f: factors.get(f.partition(":")[0], 1.0)) if factors else (lambda f: 1.0)
    for parses in sentences:
        score = [sum(v * w[f] for f, v in x.items()) for _, x in parses]
        best = max(range(len(parses)), key=lambda k: (parses[k][0], -k))
        rivals = [k for k in range(len(parses)) if parses[k][0] < parses[best][0]]
        if rivals:
            worst = max(rivals, key=lambda k: (score[k], -k))
            if score[worst] >= score[best]:
                gap = rate * (parses[best][0] - parses[worst][0])
                for k, sign in ((best, gap), (worst, -gap)):
                    for f, v in parses[k][1].items():
                        w[f] += sign * v * of(f)
                        total[f] -= sign * v * of(f) * n  # lazy averaging: what earlier steps didn't have
        n += 1
        rate *= decay
    return {f: v + total[f] / n for f, v in w.items()} if n else dict(start)


def _parts(batches):
    """(part, start weights, sentences) from sorted rows: a part's weights come first, then its parses, a sentence's together."""
    rows = (r for batch in batches for k in range(0, batch.num_rows, 1024) for r in batch.slice(k, 1024).to_pylist())
    for part, own in groupby(rows, key=lambda r: r["part"]):
        own, start, first = iter(own), {}, None
        for r in own:
            if r["place"] is not None:
                first = r
                break
            start[r["feat"]] = r["w"]

        def sentences(own=own, first=first):
            for _, parses in groupby(chain([first] if first else [], own), key=lambda r: r["sent"]):
                yield [(r["fscore"], dict(r["x"] or ())) for r in parses]

        yield part, start, sentences()


def fit_perceptron(lists: DataFrame, values: DataFrame, epochs: int = 5, parts: int = 8, burn_in: int = 0, reduce: float = 1.0, decay: float = 1.0, factors: dict[str, float] | None = None) -> DataFrame:
    """Weights (feat, w) from lists (sent_id, k, fscore) and values (sent_id, k, feat, val).

    Weights are a table: each epoch joins it to the features that a part has, the part's task starts from these, and the
    parts' changes, by their number of sentences, are added to the table. So a task holds the weights of its own
    part's features, and the driver none. reduce multiplies the rate after each epoch; epochs before burn_in don't
    enter the average of epochs. A sentence's place in its part is by a hash of it and the epoch. factors scale the steps
    of classes of features.
    """
    features = values.groupBy("sent_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("feat", "val"))).alias("x"))
    rows = lists.join(features, ["sent_id", "k"], "left").select(F.pmod(F.xxhash64("sent_id"), F.lit(parts)).cast("int").alias("part"), F.col("sent_id").cast("string").alias("sent"), "k", F.col("fscore").cast("double").alias("fscore"), "x")
    rows = written(rows, "parses")
    of_part = written(rows.select("part", F.explode(F.map_keys("x")).alias("feat")).distinct(), "features")
    n = max(1, rows.select("sent").distinct().count())
    weights = of_part.select("feat", F.lit(0.0).alias("w")).distinct()
    kept = []
    for epoch in range(epochs):

        def run(batches, rate=reduce**epoch):
            for _, start, sentences in _parts(batches):
                seen = [0]

                def counted(sentences=sentences, seen=seen):
                    for s in sentences:
                        seen[0] += 1
                        yield s

                w = _sweep(counted(), start, rate, decay, factors)
                moved = [(f, (x - start.get(f, 0.0))) for f, x in w.items() if x != start.get(f, 0.0)]
                for a in range(0, len(moved), 50_000):
                    some = moved[a : a + 50_000]
                    yield pa.RecordBatch.from_pydict({"feat": pa.array([f for f, _ in some], pa.string()), "change": pa.array([x * seen[0] / n for _, x in some], pa.float64())})

        none = lambda kind: F.lit(None).cast(kind)
        starts = of_part.join(weights, "feat").select("part", none("long").alias("place"), none("string").alias("sent"), none("int").alias("k"), none("double").alias("fscore"), none("map<string,double>").alias("x"), "feat", "w")
        place = F.crc32(F.concat_ws(" ", F.lit(str(epoch)), "sent"))
        data = rows.select("part", place.alias("place"), "sent", F.col("k").cast("int").alias("k"), "fscore", F.col("x").cast("map<string,double>").alias("x"), none("string").alias("feat"), none("double").alias("w"))
        dealt = starts.unionAll(data).repartition(parts, "part").sortWithinPartitions("part", F.asc_nulls_first("place"), "sent", "k")
        change = dealt.mapInArrow(run, "feat string, change double").groupBy("feat").agg(F.sum("change").alias("change"))
        weights = written(weights.join(change, "feat", "left").select("feat", (F.col("w") + F.coalesce("change", F.lit(0.0))).alias("w")), "weights")
        kept += [weights] if epoch >= burn_in else []
    if not burn_in or not kept:
        return weights
    every = kept[0]
    for w in kept[1:]:
        every = every.unionAll(w)
    return every.groupBy("feat").agg((F.sum("w") / max(1, epochs - burn_in)).alias("w"))
