"""Training counts: lexicon, unknown words, endings, context tables with backoff, n-gram discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lexicon(tokens: DataFrame) -> DataFrame:
    """word (lowered), tag, cnt, p: P(word | tag) by relative frequency."""
    counts = tokens.groupBy(F.lower("form").alias("word"), "tag").agg(F.count("*").alias("cnt"))
    return counts.withColumn("p", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("tag")), 9))


def unknown_statistics(tokens: DataFrame, rare: int = 2) -> DataFrame:
    """tag, n, p_unknown (tokens of words seen at most `rare` times), p_capital, p_hyphen: one row for each tag.

    Everything but the rare words' share is summed by word and tag first, so a frequent word is one row.
    """
    capital = ((F.col("form") != F.lower("form")) & (F.col("pos") >= 2) & (F.length("form") > 1)).cast("int")
    counted = ((F.col("pos") >= 2) & (F.length("form") > 1)).cast("int")
    words = tokens.groupBy(F.lower("form").alias("word"), "tag").agg(F.count("*").alias("c"), F.sum(capital).alias("cap"), F.sum(counted).alias("of"), F.sum(F.contains(F.col("form"), F.lit("-")).cast("int")).alias("hyphen"))
    words = words.withColumn("seen", F.sum("c").over(Window.partitionBy("word")))
    is_rare = F.col("seen") <= rare
    share = lambda a, b: F.when(b > 0, F.round(a / b, 9)).otherwise(F.lit(0.0))
    sums = words.groupBy("tag").agg(F.sum("c").alias("n"), F.sum(F.when(is_rare, F.col("c")).otherwise(0)).alias("u"), F.sum("cap").alias("cap"), F.sum("of").alias("of"), F.sum(F.when(is_rare, F.col("hyphen")).otherwise(0)).alias("h"))
    return sums.select("tag", "n", share(F.col("u"), F.col("n")).alias("p_unknown"), share(F.col("cap"), F.col("of")).alias("p_capital"), share(F.col("h"), F.col("u")).alias("p_hyphen"))


def endings(tokens: DataFrame, open_tags: tuple[str, ...], most: int = 4) -> DataFrame:
    """tag, ending, cnt, p: the last two characters of open-class words of three or more seen at most `most` times."""
    words = tokens.where(F.col("tag").isin(*open_tags) & (F.length("form") >= 3)).groupBy(F.lower("form").alias("word"), "tag").agg(F.count("*").alias("c"))
    rare = words.withColumn("seen", F.sum("c").over(Window.partitionBy("word"))).where(F.col("seen") <= most)
    counts = rare.groupBy("tag", F.substring("word", -2, 2).alias("ending")).agg(F.sum("c").alias("cnt"))
    return counts.withColumn("p", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("tag")), 9))


def context_counts(events: DataFrame, contexts: list[str], outcome: str) -> DataFrame:
    """level, the contexts (null beyond the level), outcome, cnt, tot, g: nested backoff levels.

    Events are counted at the deepest level first; each level sums those counts, not the events."""
    counts = events.groupBy(outcome, *contexts).count()
    sets = [contexts[:k] for k in range(1, len(contexts) + 1)]
    out = None
    for k, names in enumerate(sets, 1):
        part = counts.groupBy(outcome, *names).agg(F.sum("count").alias("cnt"))
        part = part.select(F.lit(k).alias("level"), *[(F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in contexts], outcome, "cnt")
        out = part if out is None else out.unionAll(part)
    total = F.sum("cnt").over(Window.partitionBy("level", *contexts))
    return out.withColumn("tot", total).withColumn("g", F.round(F.col("cnt") / F.col("tot"), 9))


def kneser_ney_discounts(grams: DataFrame, words: list[str]) -> DataFrame:
    """order_n, n1..n4, y, d1, d2, d3: count-of-counts and the discounts of modified Kneser-Ney.

    The highest order uses counts; the lower ones the number of different words before.
    """
    counts = grams.groupBy(*words).agg(F.count("*").alias("c"))
    rows = [counts.select(F.lit(len(words)).alias("order_n"), "c")]
    for k in range(1, len(words)):
        counts = counts.groupBy(*words[k:]).agg(F.count("*").alias("c"))
        rows.append(counts.select(F.lit(len(words) - k).alias("order_n"), "c"))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionAll(r)
    n = every.groupBy("order_n").agg(*[F.sum((F.col("c") == k).cast("bigint")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    n = n.withColumn("y", F.expr("n1 / nullif(n1 + 2 * n2, 0)"))
    d = lambda k: F.round(F.expr(f"{k} - {k + 1} * y * n{k + 1} / nullif(n{k}, 0)"), 6).alias(f"d{k}")
    return n.select("order_n", "n1", "n2", "n3", "n4", F.round("y", 6).alias("y"), d(1), d(2), d(3))
