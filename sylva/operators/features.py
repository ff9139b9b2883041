"""Features of candidate trees, their dictionary and their values: long tables (sent_id, k, cls, feat, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.operators.lists import numbered

KEYS = ("sent_id", "k")


def _count(rows: DataFrame, cls: str, feature) -> DataFrame:
    named = rows.select(*KEYS, feature.alias("feat")).where("feat IS NOT NULL")
    return named.groupBy(*KEYS, "feat").agg(F.count("*").cast("double").alias("val")).select(*KEYS, F.lit(cls).alias("cls"), "feat", "val")


def array_totals(parses: DataFrame, cls: str, feats) -> DataFrame:
    """cls, feat, parses, total of parses in a row each, with the features that occur in them as an array (nulls don't count).

    Of a parse's equal features the first one, in its own sorted array, counts the parse; the first shuffle is of partial sums.
    """
    rows = parses.select(F.array_sort(F.filter(feats, lambda x: x.isNotNull())).alias("s"))
    each = rows.select(F.explode(F.transform("s", lambda x, i: F.struct(x.alias("feat"), F.when((i == 0) | (F.get("s", i - 1) != x), 1).otherwise(0).alias("new")))).alias("e"))
    sums = each.select("e.feat", "e.new").groupBy("feat").agg(F.sum("new").alias("parses"), F.count("*").cast("double").alias("total"))
    return sums.select(F.lit(cls).alias("cls"), "feat", "parses", "total")


def log_probability(lists: DataFrame) -> DataFrame:
    return lists.select(*KEYS, F.lit("NLogP").alias("cls"), F.lit("NLogP").alias("feat"), (-F.col("logprob")).alias("val"))


def word(tagged: DataFrame) -> DataFrame:
    """A word with the label of the chunk above it (tagged: sent_id, k, form, label)."""
    return _count(tagged, "Word:1", F.concat_ws(" ", "form", "label"))


def rule(chunks: DataFrame) -> DataFrame:
    """A chunk's label and the tags below it (chunks: sent_id, k, label, tags as an array)."""
    return _count(chunks, "Rule:0:0", F.concat(F.array_join("tags", " "), F.lit(" _ "), F.col("label")))


def label_ngram(chunks: DataFrame, n: int = 2) -> DataFrame:
    """n neighbouring labels under the sentence, padded by _ at both ends (chunks: sent_id, k, c, label)."""
    w = Window.partitionBy(*KEYS).orderBy("c")
    parts = [F.coalesce(F.lag("label", n - 1 - i).over(w), F.lit("_")) for i in range(n)]
    last = F.when(F.lead("label").over(w).isNull(), F.concat(F.concat_ws(" ", *parts[1:]), F.lit(" _")))
    grams = chunks.select(*KEYS, F.concat_ws(" ", *parts).alias("own"), last.alias("last")).select(*KEYS, F.explode(F.array_compact(F.array("own", "last"))).alias("feat"))
    return _count(grams, f"NGram:{n}", F.col("feat"))


def edges(chunks: DataFrame) -> DataFrame:
    """A chunk's label, its size class, and the first and last tag in it."""
    size = F.least(F.col("finish") - F.col("start"), F.lit(5)).cast("string")
    return _count(chunks, "Edges:0:1:0:1", F.concat_ws(" ", size, "label", F.element_at("tags", 1), F.element_at("tags", -1)))


def heavy_feature() -> Column:
    """A chunk's size class, distance class to the sentence's end, and label (of columns n, start, finish, label)."""
    size, rest = F.col("finish") - F.col("start"), F.col("n") - F.col("finish")
    q = lambda x: F.when(x <= 2, x).when(x <= 4, 4).otherwise(5).cast("string")
    return F.concat_ws(" ", q(size), q(rest), "label")


def right_feature() -> Column:
    return F.when(F.col("finish") == F.col("n"), "1").otherwise("0")


def heavy(chunks: DataFrame) -> DataFrame:
    """A chunk's size class, distance class to the sentence's end, and label."""
    return _count(chunks, "Heavy", heavy_feature())


def right_branch(chunks: DataFrame) -> DataFrame:
    """Chunks that end at the sentence's end, and those that don't."""
    return _count(chunks, "RightBranch", right_feature())


def coordination_length(chunks: DataFrame) -> DataFrame:
    """Difference of sizes of neighbouring chunks of one label, from -5 to 5, and whether the second is the last chunk."""
    w = Window.partitionBy(*KEYS).orderBy("c")
    size = F.col("finish") - F.col("start")
    diff = F.greatest(F.lit(-5), F.least(F.lit(5), size - F.lag(size).over(w)))
    same = F.lag("label").over(w) == F.col("label")
    rows = chunks.select(*KEYS, F.when(same, F.concat_ws(" ", diff.cast("string"), (F.lead("c").over(w).isNull()).cast("int").cast("string"))).alias("feat"))
    return _count(rows, "CoLenPar", F.col("feat"))


def pseudo_constants(values: DataFrame, lists: DataFrame) -> DataFrame:
    """sent_id, cls, feat, constant: whether a feature has one value on all parses of the sentence."""
    n = lists.groupBy("sent_id").agg(F.count("*").alias("n"))
    seen = values.groupBy("sent_id", "cls", "feat").agg(F.count("*").alias("c"), F.min("val").alias("lo"), F.max("val").alias("hi"))
    return seen.join(n, "sent_id").select("sent_id", "cls", "feat", ((F.col("c") == F.col("n")) & (F.col("lo") == F.col("hi"))).alias("constant"))


def dictionary(values: DataFrame, lists: DataFrame, least: int = 5) -> DataFrame:
    """fid, cls, feat, sentences: features that vary in `least` sentences or more, numbered by class and feature from 0.

    Only the pruned dictionary is sorted, by ranges (lists.numbered).
    """
    return numbered_dictionary(pseudo_constants(values, lists).where("NOT constant"), least)


def numbered_dictionary(varied: DataFrame, least: int = 5) -> DataFrame:
    """fid, cls, feat, sentences of rows with a sentence's features that vary (cls, feat)."""
    kept = varied.groupBy("cls", "feat").agg(F.count("*").alias("sentences")).where(F.col("sentences") >= least)
    return numbered(kept, ["cls", "feat"]).select(F.col("i").alias("fid"), "cls", "feat", "sentences")


def baseline_shift(values: DataFrame, lists: DataFrame) -> DataFrame:
    """sent_id, cls, feat, base: the value to subtract, v with the greatest gain 2 * #(value = v) + #(value = v + 1).

    Parses without the feature have the value 0. Ties go to the least v.
    """
    n = lists.groupBy("sent_id").agg(F.count("*").alias("n"))
    counts = values.groupBy("sent_id", "cls", "feat", "val").agg(F.count("*").alias("c"))
    absent = counts.groupBy("sent_id", "cls", "feat").agg(F.sum("c").alias("c")).join(n, "sent_id").select("sent_id", "cls", "feat", F.lit(0.0).alias("val"), (F.col("n") - F.col("c")).alias("c")).where("c > 0")
    every = counts.unionAll(absent)
    gains = every.select("sent_id", "cls", "feat", F.explode(F.array(F.struct(F.col("val").alias("v"), (2 * F.col("c")).alias("g")), F.struct((F.col("val") - 1).alias("v"), F.col("c").alias("g")))).alias("x"))
    gains = gains.groupBy("sent_id", "cls", "feat", F.col("x.v").alias("v")).agg(F.sum("x.g").alias("g"))
    best = gains.groupBy("sent_id", "cls", "feat").agg(F.max(F.struct("g", -F.col("v"))).alias("best"))
    return best.select("sent_id", "cls", "feat", (-F.col("best").getItem("col2")).alias("base"))


def sparse_score(values: DataFrame, weights: DataFrame) -> DataFrame:
    """sent_id, k, score: the dot product of a parse's features with the weights (cls, feat, w)."""
    return values.join(weights, ["cls", "feat"]).groupBy(*KEYS).agg(F.sum(F.col("val") * F.col("w")).alias("score"))
