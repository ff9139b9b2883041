"""Reports on ranked lists: ablation, beams, histograms, features that tell winners from losers, significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators import comparison
from sylva.operators.losses import BROADCAST_WEIGHTS, Values
from sylva.sources.shared import written


def class_ablation(scored: DataFrame, values: Values, weights: DataFrame) -> DataFrame:
    """cls, n_features, fscore: corpus f of the parses ranked first without the class ('' leaves none out).

    values: sent_id, k, cls, feat, val, or a function that gives the rows of `scored` with these (a null cls for one without features);
    then nothing but rows of `scored` moves, if there are at most BROADCAST_WEIGHTS weights. The partial scores by class are summed once, and a class is subtracted from the total.
    """
    weights = written(weights, "weights")
    small = weights.count() <= BROADCAST_WEIGHTS
    names = weights.groupBy("cls").agg(F.count("*").alias("n_features")).unionAll(weights.agg(F.lit("").alias("cls"), F.count("*").alias("n_features")))
    lists = scored.repartition("sent_id")  # the sums, and the choice of the first, keep this layout
    each = values(lists) if callable(values) else lists.join(values, ["sent_id", "k"], "left")
    part = F.sum(F.coalesce(F.col("val") * F.col("w"), F.lit(0.0))).alias("part")
    partial = each.join(F.broadcast(weights) if small else weights, ["cls", "feat"], "left").groupBy(*scored.columns, "cls").agg(part)
    parts = F.map_from_entries(F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("cls", "part"))))  # a class each: they are few and fixed
    lists = partial.groupBy(*scored.columns).agg(F.sum("part").alias("total"), parts.alias("parts")).join(F.broadcast(names))
    lists = lists.withColumn("score", F.round(F.col("total") - F.coalesce(F.try_element_at("parts", F.col("cls")), F.lit(0.0)), 9))
    first = F.row_number().over(Window.partitionBy("sent_id", "cls").orderBy(F.desc("score"), F.desc("logprob"), "k"))
    best = lists.withColumn("_r", first).where("_r = 1")
    return best.groupBy("cls").agg(F.max("n_features").alias("n_features"), (2 * F.sum("n_matched") / F.sum(F.col("n_gold") + F.col("n_test"))).alias("fscore"))


def relative_beam(lists: DataFrame, steps: int, width: float = 0.25) -> DataFrame:
    """step, parses: parses whose score is within step * width of the list's best."""
    gap = F.max("logprob").over(Window.partitionBy("sent_id")) - F.col("logprob")
    least = lists.select(F.ceil(F.round(gap / width, 6)).cast("int").alias("step")).where(F.col("step") <= steps).groupBy("step").agg(F.count("*").alias("n"))
    grid = lists.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("step"))
    # at most steps + 1 rows: the window is over a grid of fixed size
    return grid.join(F.broadcast(least), "step", "left").select("step", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("step")).cast("long").alias("parses"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: equal bins from 1; values at or above `high` are in bin bins + 1."""
    return rows.groupBy(F.expr(f"width_bucket({column}, {low}D, {high}D, {bins})").alias("bin")).agg(F.count("*").alias("n"))


def distinguishing(won: DataFrame, values: DataFrame) -> DataFrame:
    """sent_id, feat: the set of a feature's values on winners (p_gold > 0) isn't that on losers; absent is 0."""
    sides = won.select("sent_id", "k", (F.col("p_gold") > 0).alias("winner"))
    sizes = sides.groupBy("sent_id").agg(F.sum(F.col("winner").cast("int")).alias("nw"), F.sum((~F.col("winner")).cast("int")).alias("nl"))
    joined = values.join(sides, ["sent_id", "k"])
    per = joined.groupBy("sent_id", "feat").agg(
        F.collect_set(F.when(F.col("winner"), F.col("val"))).alias("w"), F.collect_set(F.when(~F.col("winner"), F.col("val"))).alias("l"),
        F.sum(F.col("winner").cast("int")).alias("cw"), F.sum((~F.col("winner")).cast("int")).alias("cl"),
    ).join(sizes, "sent_id")
    full = lambda s, c, n: F.array_sort(F.when(F.col(c) < F.col(n), F.array_union(s, F.array(F.lit(0.0)))).otherwise(F.col(s)))
    return per.where(full("w", "cw", "nw") != full("l", "cl", "nl")).where("nl > 0").select("sent_id", "feat")


def randomisation_test(a: DataFrame, b: DataFrame, trials: int = 1000, seed: int = 17) -> DataFrame:
    """p_value of the difference of corpus f of two systems (sent_id, n_gold, n_test, n_matched): approximate randomisation."""
    return comparison.permutation(comparison.paired(a, b), trials, seed).withColumnRenamed("permutation_p", "p_value")
