"""Unit rules: which label may stand over which, when a node has one child."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.forest import Forest
from sylva.sources.ptb import each_forest


def unary_counts(nodes: DataFrame, key: str = "sent_id") -> DataFrame:
    """parent, child, cnt of phrase nodes whose only child is a phrase of another label."""
    above = nodes.select(key, F.col("node").alias("parent"), F.col("label").alias("up"))
    only = nodes.where("parent IS NOT NULL").groupBy(key, "parent").agg(F.count("*").alias("c"), F.max("label").alias("child"), F.max("word").alias("word")).where("c = 1 AND word IS NULL")
    return only.join(above, [key, "parent"]).where("up <> child").groupBy(F.col("up").alias("parent"), "child").agg(F.count("*").alias("cnt"))


def row_unary_counts(trees: DataFrame, key: str = "sent_id", tree: str = "tree") -> DataFrame:
    """parent, child, cnt as unary_counts() has them, found where the tree's row is; only sums move."""

    def run(texts):
        f = Forest.read(texts)
        order, begin = f.kids
        up = np.flatnonzero(np.diff(begin) == 1)
        child = order[begin[up]]
        up, child = (x[~f.leaf[child] & (f.code[up] != f.code[child])] for x in (up, child))
        return f.row[f.tree[up]], [f.labels_at(up), f.labels_at(child)]

    return each_forest(trees, run, "parent string, child string", key, tree).groupBy("parent", "child").agg(F.count("*").alias("cnt"))


def order_labels(counts: list[tuple[str, str, int]], least: int = 3) -> set[tuple[str, str]]:
    """Pairs (over, under) without cycles: by falling count, more than `least`, a pair is taken unless its reverse holds
    already, with all that follows from it. counts has a row for each pair of labels, so this runs on the driver."""
    over: set[tuple[str, str]] = set()
    for parent, child, n in sorted(counts, key=lambda r: (-r[2], r[0], r[1])):
        if n <= least or (parent, child) in over or (child, parent) in over:
            continue
        above = {parent} | {a for a, b in over if b == parent}
        below = {child} | {b for a, b in over if a == child}
        over |= {(a, b) for a in above for b in below}
    return over
