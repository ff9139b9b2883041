"""Two systems on the same sentences: who is better how often, and how sure that is.

Draws are made of an MD5 hash of sentence, trial and seed, so they are the same on every run, however the rows are dealt. A trial's
sums are all that moves: sentences are spread over the trials where they are and added up before the exchange. Results
have a row for each system or trial; trials are a parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("n_gold", "n_test", "n_matched")


def draw(key: Column, trial: Column, seed: int) -> Column:
    """A whole number from 0 to 2^32 - 1 for a sentence and a trial."""
    text = F.concat_ws(":", key.cast("string"), trial.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def poisson_bounds() -> list[int]:
    """How often a sentence is drawn, by bounds of its number: as many times as there are bounds at or under it (Poisson, mean 1)."""
    out, p, total = [], math.exp(-1), 0.0
    for k in range(1, 14):
        total += p
        out.append(round(total * 2**32))
        p /= k
    return [b for b in out if b < 2**32]


def paired(a: DataFrame, b: DataFrame, key: str = "sent_id") -> DataFrame:
    """key and both systems' counts (a_n_gold and so on) of the sentences that both have."""
    side = lambda df, x: df.select(key, *[F.col(c).alias(f"{x}_{c}") for c in COUNTS])
    return side(a, "a").join(side(b, "b"), key)


def _f(gold: Column, test: Column, matched: Column) -> Column:
    return F.when(gold + test > 0, 2 * matched / (gold + test)).otherwise(0.0)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of 1 or more, by the asymptotic series eight places on."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for k in range(8):
        series = series - F.log(x + k)
    return series


def binomial_two_sided(wins: Column, losses: Column) -> Column:
    """Twice the chance of at most the lesser number among wins + losses fair throws, at most 1.

    Terms are added from the lesser number down; nine standard deviations and 50 terms below it nothing is left to add.
    """
    n, least = (wins + losses).cast("double"), F.least(wins, losses).cast("long")
    low = F.greatest(F.lit(0).cast("long"), least - F.ceil(9 * F.sqrt(n)) - 50)
    log_term = lambda k: log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2)
    total = F.aggregate(F.sequence(low, least), F.lit(0.0), lambda acc, k: acc + F.exp(log_term(k.cast("double"))))
    return F.least(F.lit(1.0), 2 * total)


def better(pairs: DataFrame, key: str = "sent_id") -> DataFrame:
    """One row: n, f_a and f_b of the corpus, better_a, better_b and tied sentences by f, and binomial_p of the comparison."""
    gap = (F.round(_f(*[F.col(f"a_{c}") for c in COUNTS]), 12) - F.round(_f(*[F.col(f"b_{c}") for c in COUNTS]), 12)).alias("gap")
    sums = [F.sum(f"{x}_{c}").alias(f"{x}_{c}") for x in "ab" for c in COUNTS]
    rows = pairs.withColumn("gap", gap)
    row = rows.agg(F.count("*").alias("n"), *sums, F.count_if(F.col("gap") > 0).alias("better_a"), F.count_if(F.col("gap") < 0).alias("better_b"), F.count_if(F.col("gap") == 0).alias("tied"))
    f = lambda x: F.coalesce(_f(*[F.col(f"{x}_{c}") for c in COUNTS]), F.lit(0.0)).alias(f"f_{x}")
    return row.select("n", f("a"), f("b"), "better_a", "better_b", "tied", binomial_two_sided(F.col("better_a"), F.col("better_b")).alias("binomial_p"))


def bootstrap(pairs: DataFrame, trials: int = 1000, seed: int = 17, key: str = "sent_id") -> DataFrame:
    """trial, f_a, f_b: corpus f of resampled corpora. Both systems see the same sample; a sentence is in it a Poisson number of times."""
    each = pairs.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    number = draw(F.col(key), F.col("trial"), seed)
    times = F.lit(0)
    for b in poisson_bounds():
        times = times + F.when(F.col("_d") >= b, 1).otherwise(0)
    each = each.withColumn("_d", number).withColumn("_w", times)
    sums = each.groupBy("trial").agg(*[F.sum(F.col("_w") * F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x in "ab" for c in COUNTS])
    return sums.select("trial", *[_f(*[F.col(f"{x}_{c}") for c in COUNTS]).alias(f"f_{x}") for x in "ab"])


def interval(samples: DataFrame, share: float = 0.95) -> DataFrame:
    """low_a, high_a, low_b, high_b: the middle share of the samples, between neighbouring ones in proportion."""
    low, high = round((1 - share) / 2, 9), round((1 + share) / 2, 9)
    return samples.agg(*[F.percentile(f"f_{x}", F.lit(q)).alias(f"{name}_{x}") for x in "ab" for name, q in (("low", low), ("high", high))])


def permutation(pairs: DataFrame, trials: int = 1000, seed: int = 17, key: str = "sent_id") -> DataFrame:
    """permutation_p: how often a corpus whose sentences' results are swapped at random has at least the gap that was seen."""
    each = pairs.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    swap = (F.col("trial") > 0) & (F.pmod(draw(F.col(key), F.col("trial"), seed + 1), F.lit(2)) == 1)
    side = lambda x, y: [F.sum(F.when(swap, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}"))).alias(f"{x}_{c}") for c in COUNTS]
    sums = each.groupBy("trial").agg(*side("a", "b"), *side("b", "a"))
    gaps = sums.select("trial", F.abs(_f(*[F.col(f"a_{c}") for c in COUNTS]) - _f(*[F.col(f"b_{c}") for c in COUNTS])).alias("gap"))
    seen = gaps.agg(F.max(F.when(F.col("trial") == 0, F.col("gap"))).alias("seen"))  # one row
    return gaps.where("trial > 0").join(F.broadcast(seen)).agg(((F.count_if(F.col("gap") >= F.col("seen") - 1e-12) + 1) / (F.count("*") + 1)).alias("permutation_p"))


def compare(a: DataFrame, b: DataFrame, trials: int = 1000, seed: int = 17, key: str = "sent_id") -> DataFrame:
    """One row with better(), the bootstrap intervals and permutation_p of two systems (key, n_gold, n_test, n_matched)."""
    pairs = paired(a, b, key)
    return better(pairs, key).join(interval(bootstrap(pairs, trials, seed, key))).join(permutation(pairs, trials, seed, key))  # one row each
