"""Operators on n-best lists: probabilities, ranks, merging, oracle scores, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(score: Column, key: str = "sent_id", exponent: float = 1.0) -> Column:
    """Probabilities within a list: natural exponent of the shifted scores over their sum."""
    w = Window.partitionBy(key)
    shifted = score * F.lit(float(exponent))
    grown = F.exp(shifted - F.max(shifted).over(w))
    return grown / F.sum(grown).over(w)


def log_conditional(score: Column, key: str = "sent_id") -> Column:
    """score less the log of the list's summed exponentials."""
    w = Window.partitionBy(key)
    top = F.max(score).over(w)
    return score - (top + F.log(F.sum(F.exp(score - F.max(score).over(w))).over(w)))


def ranked(lists: DataFrame, order: list[Column], out: str = "rank", key: str = "sent_id") -> DataFrame:
    """Ranks from 0 within a list."""
    return lists.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def rerank(lists: DataFrame, scores: DataFrame, key: str = "sent_id") -> DataFrame:
    """lists with reranker_score (0 where there is none) and both ranks; ties go to the better parser score."""
    joined = lists.join(scores.select(key, "k", F.col("score").alias("reranker_score")), [key, "k"], "left").fillna(0.0, ["reranker_score"])
    joined = ranked(joined, [F.desc("logprob"), F.asc("k")], "parser_rank", key)
    return ranked(joined, [F.desc("reranker_score"), F.desc("logprob"), F.asc("k")], "reranker_rank", key)


def oracle(scored: DataFrame, key: str = "sent_id") -> DataFrame:
    """key, first_f, best_f, best_k: the 1-best and the first parse of the greatest f."""
    return scored.groupBy(key).agg(
        F.max_by("fscore", F.struct("logprob", -F.col("k"))).alias("first_f"), F.max("fscore").alias("best_f"), (-F.max(F.struct("fscore", -F.col("k"))).getItem("col2")).alias("best_k")
    )


def beam_curve(scored: DataFrame, key: str = "sent_id") -> DataFrame:
    """beam, n, mean_f: the mean of the best f among the first 1, 2, ... parses by score."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("logprob"), "k"))
    so_far = F.max("fscore").over(Window.partitionBy(key).orderBy("beam").rowsBetween(Window.unboundedPreceding, 0))
    running = scored.withColumn("beam", place).withColumn("best", so_far)
    return running.groupBy("beam").agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean_f"))


def merge_lists(sources: dict[str, DataFrame], keys: list[str], score: str) -> DataFrame:
    """Union of lists by keys with a score column for each source, 0 where a source has no such parse; dealt by the first key alone."""
    out = None
    for name, df in sources.items():
        part = df.select(*keys, *[(F.col(score) if n == name else F.lit(None).cast("double")).alias(n) for n in sources])
        out = part if out is None else out.unionAll(part)
    return out.repartition(F.col(keys[0])).groupBy(*keys).agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in sources])


def fused_spans(spans: DataFrame, probabilities: DataFrame, least: float = 0.5, key: str = "sent_id") -> DataFrame:
    """key, start, finish, label, score: the best label of each span by summed probability, if it reaches `least`."""
    weighted = spans.join(probabilities, [key, "k"]).groupBy(key, "start", "finish", "label").agg(F.sum("p").alias("score"))
    best = F.row_number().over(Window.partitionBy(key, "start", "finish").orderBy(F.desc(F.round("score", 9)), "label"))
    return weighted.withColumn("_b", best).where((F.col("_b") == 1) & (F.round("score", 9) >= least)).drop("_b")
