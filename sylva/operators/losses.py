"""Losses of a log-linear ranker and their gradients: one distributed job for each evaluation.

lists: sent_id, k, score (the model's), fscore (against gold); values: sent_id, k, feat, val, or a function that gives rows of
lists with feat and val: features that follow from a list's row are made there, after its derivative is known, and aren't joined.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


Values = DataFrame | Callable[[DataFrame], DataFrame]


def winners(lists: DataFrame) -> DataFrame:
    """lists with p_gold: equal shares of the parses of greatest f; sentences whose greatest f is 0 are left out."""
    w = Window.partitionBy("sent_id")
    top = lists.withColumn("_top", F.max("fscore").over(w)).where("_top > 0")
    is_top = (F.col("fscore") == F.col("_top")).cast("double")
    return top.withColumn("p_gold", is_top / F.sum(is_top).over(w)).drop("_top")


def model_probabilities(lists: DataFrame) -> DataFrame:
    """lists with p_model and log_z."""
    w = Window.partitionBy("sent_id")
    top = lists.withColumn("_m", F.max("score").over(w))
    top = top.withColumn("log_z", F.col("_m") + F.log(F.sum(F.exp(F.col("score") - F.col("_m"))).over(w)))
    return top.withColumn("p_model", F.exp(F.col("score") - F.col("log_z"))).drop("_m")


def log_loss(lists: DataFrame) -> DataFrame:
    """loss: minus the sum of the gold-weighted log probabilities."""
    each = model_probabilities(winners(lists))
    return each.agg(F.sum(-F.col("p_gold") * (F.col("score") - F.col("log_z"))).alias("loss"))


def em_loss(lists: DataFrame) -> DataFrame:
    """loss: minus the log of the winners' summed probability."""
    each = model_probabilities(winners(lists)).where("p_gold > 0").groupBy("sent_id").agg((-F.log(F.sum("p_model"))).alias("l"))
    return each.agg(F.sum("l").alias("loss"))


def log_loss_gradient(lists: DataFrame, values: Values) -> DataFrame:
    """feat, grad: sums of (p_model - p_gold) * value."""
    each = model_probabilities(winners(lists))
    return _gradient(each.select(*lists.columns, (F.col("p_model") - F.col("p_gold")).alias("d")), values)


def _against_best(lists: DataFrame) -> DataFrame:
    """Each loser with its margin: the best winner's score less its own."""
    w = Window.partitionBy("sent_id")
    each = winners(lists).withColumn("_best", F.max(F.when(F.col("p_gold") > 0, F.col("score"))).over(w))
    return each.where("p_gold = 0").select("sent_id", "k", (F.col("_best") - F.col("score")).alias("margin"))


def pairwise_loss(lists: DataFrame) -> DataFrame:
    return _against_best(lists).agg(F.sum(F.log1p(F.exp(-F.col("margin")))).alias("loss"))


def exp_loss(lists: DataFrame) -> DataFrame:
    """loss and log_loss of the exponentials of minus the margins."""
    return _against_best(lists).agg(F.sum(F.exp(-F.col("margin"))).alias("loss"), F.log(F.sum(F.exp(-F.col("margin")))).alias("log_loss"))


def expected_fscore(lists: DataFrame) -> DataFrame:
    """f: twice the expected matches over expected proposals and gold (lists with n_gold, n_test, n_matched)."""
    each = model_probabilities(lists)
    sums = each.agg(F.sum(F.col("p_model") * F.col("n_matched")).alias("m"), F.sum(F.col("p_model") * (F.col("n_test") + F.col("n_gold"))).alias("pg"))
    return sums.select((2 * F.col("m") / F.col("pg")).alias("f"))


def _gradient(pushes: DataFrame, values: Values) -> DataFrame:
    """feat, grad of pushes (lists with d: the loss's derivative by a parse's score)."""
    each = values(pushes) if callable(values) else values.join(pushes.select("sent_id", "k", "d"), ["sent_id", "k"])
    return each.groupBy("feat").agg(F.sum(F.col("d") * F.col("val")).alias("grad"))


def _margin_pushes(lists: DataFrame, push) -> DataFrame:
    """lists with d: push(margin) on each loser, and minus their sum on the first best winner."""
    w = Window.partitionBy("sent_id")
    each = winners(lists).withColumn("_best", F.max(F.when(F.col("p_gold") > 0, F.struct("score", -F.col("k")))).over(w))
    each = each.withColumn("_d", F.when(F.col("p_gold") == 0, push(F.col("_best.score") - F.col("score"))).otherwise(0.0))
    best = F.col("k") == -F.col("_best").getItem("col2")
    return each.select(*lists.columns, F.when(best, -F.sum("_d").over(w)).otherwise(F.col("_d")).alias("d"))


def pairwise_gradient(lists: DataFrame, values: Values) -> DataFrame:
    """feat, grad of pairwise_loss."""
    return _gradient(_margin_pushes(lists, lambda m: 1 / (1 + F.exp(m))), values)


def exp_gradient(lists: DataFrame, values: Values, log: bool = False) -> DataFrame:
    """feat, grad of exp_loss's loss, or of its log_loss."""
    pushes = _margin_pushes(lists, lambda m: F.exp(-m))
    if log:
        total = exp_loss(lists).select(F.col("loss").alias("_total"))
        pushes = pushes.join(F.broadcast(total)).select(*lists.columns, (F.col("d") / F.col("_total")).alias("d"))
    return _gradient(pushes, values)


def em_gradient(lists: DataFrame, values: Values) -> DataFrame:
    """feat, grad of em_loss."""
    w = Window.partitionBy("sent_id")
    each = model_probabilities(winners(lists)).withColumn("_c", F.when(F.col("p_gold") > 0, F.col("p_model")).otherwise(0.0))
    return _gradient(each.select(*lists.columns, (F.col("p_model") - F.col("_c") / F.sum("_c").over(w)).alias("d")), values)


def expected_fscore_gradient(lists: DataFrame, values: Values) -> DataFrame:
    """feat, grad of expected_fscore."""
    w = Window.partitionBy("sent_id")
    each = model_probabilities(lists)
    totals = each.agg(F.sum(F.col("p_model") * F.col("n_matched")).alias("_m"), F.sum(F.col("p_model") * (F.col("n_test") + F.col("n_gold"))).alias("_d"))
    mean = lambda c: F.sum(F.col("p_model") * F.col(c)).over(w)
    each = each.withColumns({"_em": mean("n_matched"), "_et": mean("n_test")}).join(F.broadcast(totals))
    d = F.col("p_model") * (2 * (F.col("n_matched") - F.col("_em")) - 2 * F.col("_m") / F.col("_d") * (F.col("n_test") - F.col("_et"))) / F.col("_d")
    return _gradient(each.select(*lists.columns, d.alias("d")), values)


#: Losses by name: (a frame with the loss in its first column, a frame of feat and grad). expected_f is to be made great.
LOSSES = {
    "log": (log_loss, log_loss_gradient), "em": (em_loss, em_gradient), "pairwise": (pairwise_loss, pairwise_gradient), "exp": (exp_loss, exp_gradient),
    "log_exp": (lambda x: exp_loss(x).select("log_loss"), lambda x, v: exp_gradient(x, v, log=True)),
    "expected_f": (lambda x: expected_fscore(x).select(-F.col("f")), lambda x, v: expected_fscore_gradient(x, v).withColumn("grad", -F.col("grad"))),
}


def penalty(x: np.ndarray, c: np.ndarray, p: float = 2.0) -> tuple[float, np.ndarray]:
    """The sum of c * |x| ** p and its gradient (0 at 0 for p = 1, where owlqn() takes the side that helps)."""
    size = np.abs(x)
    return float((c * size**p).sum()), c * p * np.sign(x) * (size ** (p - 1) if p != 1 else 1.0)


def lbfgs(evaluate, start: np.ndarray, memory: int = 15, rounds: int = 50, tolerance: float = 1e-5, l1: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Minimise evaluate(x), which gives (loss, gradient), plus the sum of l1 * |x|. Backtracking line search; the driver holds vectors only.

    With l1 the direction and the steps keep to one orthant at a time, so weights become exactly 0.
    """
    x = np.array(start, float)
    l1 = np.broadcast_to(np.asarray(l1, float), x.shape)
    orthant = bool((l1 > 0).any())

    def total(at):
        value, grad = evaluate(at)
        return value + float((l1 * np.abs(at)).sum()), grad

    def pseudo(at, grad):
        """The gradient with the penalty; at 0 the side that falls, or 0 if none does."""
        if not orthant:
            return grad
        right, left = grad + l1, grad - l1
        return np.where(at > 0, right, np.where(at < 0, left, np.where(right < 0, right, np.where(left > 0, left, 0.0))))

    value, grad = total(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        steep = pseudo(x, grad)
        if np.abs(steep).max(initial=0) <= tolerance * max(1.0, np.abs(x).max(initial=0)):
            break
        q, alphas = steep.copy(), []
        for s, y in reversed(pairs):
            alphas.append(s @ q / (y @ s))
            q -= alphas[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += (a - y @ q / (y @ s)) * s
        if orthant:
            q = np.where(q * steep > 0, q, 0.0)
        side = np.where(x != 0, np.sign(x), -np.sign(steep))
        step, slope = (1.0 if pairs else 1.0 / max(1.0, np.linalg.norm(steep))), -(steep @ q)
        while True:
            new = x - step * q
            if orthant:
                new = np.where(new * side > 0, new, 0.0)
            new_value, new_grad = total(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        x, value, grad = new, new_value, new_grad
    return x, value


#: Weights of up to this many features (some 30 MB) are broadcast; more are joined by key.
BROADCAST_WEIGHTS = 1_000_000


def fit_log_linear(
    lists: DataFrame, values: DataFrame, feats: list[str], penalty: float = 1.0, rounds: int = 20, loss: str = "log", p: float = 2.0, factors: dict[str, float] | None = None
) -> tuple[dict[str, float], float]:
    """Weights of the named features that minimise a loss plus penalty * |w| ** p; each evaluation is one pass over the lists.

    lists needs what the loss reads (fscore; n_gold, n_test, n_matched for expected_f). factors multiply the penalty of
    features by the first part of their name. p = 1 makes weights exactly 0. The driver holds a vector of the features.
    """
    spark = lists.sparkSession
    wanted = spark.createDataFrame([(f, i) for i, f in enumerate(feats)], "feat string, i int")
    small = len(feats) <= BROADCAST_WEIGHTS
    own = values.join(F.broadcast(wanted) if small else wanted, "feat").select("sent_id", "k", F.col("i").alias("feat"), "val").cache()
    base = lists.drop("score").cache()
    c = penalty * np.array([(factors or {}).get(f.partition(":")[0], 1.0) for f in feats])
    value_of, gradient_of = LOSSES[loss]

    def evaluate(x: np.ndarray):
        weights = spark.createDataFrame([(i, w) for i, w in enumerate(x.tolist())], "feat int, w double")
        score = own.join(F.broadcast(weights) if small else weights, "feat").groupBy("sent_id", "k").agg(F.sum(F.col("val") * F.col("w")).alias("score"))
        scored = base.join(score, ["sent_id", "k"], "left").fillna(0.0, ["score"])
        value = value_of(scored).first()[0] or 0.0
        grad = np.zeros(len(feats))
        for r in gradient_of(scored, own).toLocalIterator():
            grad[r.feat] = r.grad
        if p != 1:
            more, slope = globals()["penalty"](x, c, p)
            return value + more, grad + slope
        return value, grad

    try:
        x, value = lbfgs(evaluate, np.zeros(len(feats)), rounds=rounds, l1=c if p == 1 else 0.0)
    finally:
        own.unpersist()
        base.unpersist()
    return dict(zip(feats, x.tolist(), strict=True)), value


def search_factors(score, names: list[str], rounds: int = 10, step: float = 2.0, start: dict[str, float] | None = None) -> tuple[dict[str, float], float]:
    """Positive factors by name with the greatest score(factors): one at a time by logarithmic steps, which shrink when none helps."""
    best = {n: 1.0 for n in names} | (start or {})
    value = score(best)
    for _ in range(rounds):
        moved = False
        for n in names:
            for by in (step, 1 / step):
                new = best | {n: best[n] * by}
                if (found := score(new)) > value:
                    best, value, moved = new, found, True
                    break
        if not moved:
            step = step**0.5
            if step < 1.05:
                break
    return best, value


def search_classes(score, names: list[str], patience: int = 3) -> tuple[set[str], float]:
    """A set of names with a great score(set), by best-first search from all names.

    The best set in the queue that hasn't been opened is opened: all sets with one name more or less are scored and queued.
    Scores are remembered. It ends when `patience` openings in a row found nothing better, or the queue is empty.
    """
    known: dict[frozenset, float] = {}
    queue: list[tuple[float, list[str], frozenset]] = []

    def visit(chosen: frozenset) -> None:
        if chosen not in known:
            known[chosen] = score(set(chosen))
            heapq.heappush(queue, (-known[chosen], sorted(chosen), chosen))

    best = frozenset(names)
    visit(best)
    waited = 0
    while queue and waited < patience:
        _, _, chosen = heapq.heappop(queue)
        for n in names:
            visit(chosen ^ {n})
        top = min(queue, default=(0.0, [], chosen))
        if top[2] in known and known[top[2]] > known[best]:
            best, waited = top[2], 0
        else:
            waited += 1
    return set(best), known[best]
