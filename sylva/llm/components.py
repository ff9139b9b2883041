"""Connected components by alternating large-star and small-star steps; only minima per node are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in edges (a, b); root is the component's least node. Loops and repeats are allowed."""
    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        new = cut(_small_star(_large_star(now)).where("a <> b").distinct(), "edges")
        same = new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty()
        drop_cut(now)
        now = new
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
