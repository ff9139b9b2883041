"""URL filter: host and path rules first, then gradient-boosted trees on lexical features, all in SQL functions.

The trees are fitted on URLs with a label (1: block). Every feature is an expression over the URL: length, depth,
digit ratio, character entropy, numbers of parameters and host labels, and the share of blocked URLs among the
training URLs of the same host suffix (last label, last two labels). Shares are counted on one half of the training
URLs, by hash, and the trees are fitted on the other half: a share that a URL's own label goes into, or is taken out
of, tells the trees that label, which no other URL has. Features are cut at quantiles of the training rows; a split needs the sums of gradients by leaf, feature and bin, which is
one grouped aggregate for each level of a tree; the finished trees compile into one CASE expression.

At most `max_rows` labelled rows are used for fitting, those with the lowest hash of the URL; they bound the table
of suffix shares too, which is broadcast. Everything else runs over all rows.

A null URL, or one without "://", has an empty host and path and no rule; its features are those of an empty text.
Without labelled rows the model says allow. Equal URLs get equal verdicts. Only page_id and url are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import cut, drop_cut

#: (host, path, verdict), fixed by the contract of the query.
RULES = (
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
)

#: The half of the training URLs that suffixes are counted on.
SHARED = "pmod(shiftright(_o, 20), 2) = 0"

FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_suffix1", "f_suffix2")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    rest = f"if(locate('://', `{url}`) > 0, substr(`{url}`, locate('://', `{url}`) + 3), '')"
    return df.withColumn("_rest", F.expr(f"coalesce({rest}, '')")).withColumns({
        "host": F.expr(f"translate(regexp_extract(_rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')"),
        "path": F.expr("regexp_extract(_rest, '^[^/?#]*([^?#]*)', 1)"),
    }).drop("_rest")


def rule_of(rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def with_lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Features that need the URL alone, and the suffixes s1 and s2 of the host."""
    u = f"coalesce(`{url}`, '')"
    return df.withColumns({
        "f_length": F.expr(f"cast(length({u}) as double)"),
        "f_depth": F.expr("cast(size(array_remove(split(path, '/'), '')) as double)"),
        "f_digits": F.expr(f"if({u} = '', 0D, length(regexp_replace({u}, '[^0-9]', '')) / length({u}))"),
        "f_entropy": F.expr(f"aggregate(array_distinct(split({u}, '')), 0D, (a, c) -> if(c = '', a, a - (length({u}) - length(replace({u}, c, ''))) / length({u}) * log2((length({u}) - length(replace({u}, c, ''))) / length({u}))))"),
        "f_params": F.expr(f"cast(length({u}) - length(replace({u}, '=', '')) as double)"),
        "f_labels": F.expr("cast(size(array_remove(split(host, '[.]'), '')) as double)"),
        "s1": F.expr("substring_index(host, '.', -1)"),
        "s2": F.expr("substring_index(host, '.', -2)"),
    })


@dataclass
class Model:
    """Log odds of block: base plus the trees. A tree is a leaf value or (feature, threshold, at most, above)."""

    base: float = -1.0
    prior: float = 0.0
    trees: list = field(default_factory=list)
    suffixes: tuple[DataFrame, DataFrame] | None = None

    def score(self) -> F.Column:
        return F.expr(" + ".join([repr(float(self.base)) + "D", *map(_case, self.trees)]))


def _case(tree) -> str:
    if not isinstance(tree, tuple):
        return repr(float(tree)) + "D"
    feature, threshold, low, high = tree
    return f"(CASE WHEN {feature} <= {float(threshold)!r}D THEN {_case(low)} ELSE {_case(high)} END)"


def _grow(rows: DataFrame, margin: str, cuts: dict[str, list[float]], depth: int, rate: float, smooth: float):
    """One tree, level by level; the driver sees sums for (leaf, feature, bin) only."""
    paths: list[str] = ["true"]  # the conditions of open leaves
    splits: dict[tuple, tuple] = {}  # place in the tree -> (feature, threshold)
    places, leaves = [()], {}
    for level in range(depth + 1):
        leaf = "CASE " + " ".join(f"WHEN {p} THEN {k}" for k, p in enumerate(paths)) + " ELSE -1 END"
        bins = ", ".join(f"'{f}', {' + '.join(f'int({f} > {c!r}D)' for c in cuts[f]) or '0'}" for f in cuts) if level < depth else "'', 0"
        n = len(cuts) if level < depth else 1
        prob = f"(1 / (1 + exp(-({margin}))))"
        sums = rows.selectExpr(f"{leaf} AS leaf", f"y - {prob} AS g", f"{prob} * (1 - {prob}) AS h", "*").where("leaf >= 0")
        sums = sums.selectExpr("leaf", "g", "h", f"stack({n}, {bins}) AS (f, b)").groupBy("leaf", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        next_paths, next_places = [], []
        for k, place in enumerate(places):
            mine = sorted((r.f, r.b, r.g, r.h) for r in sums if r.leaf == k)
            if not mine:
                leaves[place] = 0.0
                continue
            first = [x for x in mine if x[0] == mine[0][0]]
            g, h = sum(x[2] for x in first), sum(x[3] for x in first)
            leaves[place] = rate * g / (h + smooth)
            best = (1e-6, None, None)
            for f in cuts if level < depth else ():
                gl = hl = 0.0
                by = {x[1]: x for x in mine if x[0] == f}
                for b, c in enumerate(cuts[f]):
                    gl, hl = gl + by.get(b, (0, 0, 0, 0))[2], hl + by.get(b, (0, 0, 0, 0))[3]
                    gain = gl * gl / (hl + smooth) + (g - gl) ** 2 / (h - hl + smooth) - g * g / (h + smooth)
                    best = max(best, (round(gain, 9), f, c), key=lambda x: x[0])
            if best[1]:
                f, c = splits[place] = best[1:]
                next_paths += [f"({paths[k]}) AND {f} <= {c!r}D", f"({paths[k]}) AND {f} > {c!r}D"]
                next_places += [(*place, 0), (*place, 1)]
        paths, places = next_paths, next_places
        if not paths:
            break
    build = lambda place: (*splits[place], build((*place, 0)), build((*place, 1))) if place in splits else leaves.get(place, 0.0)
    return build(())


def fit(labelled: DataFrame, url: str = "url", label: str = "y", max_rows: int = 20_000, rounds: int = 8, depth: int = 3, rate: float = 0.5, bins: int = 16, smooth: float = 1.0) -> Model:
    """Boost on at most max_rows of labelled (url, label 0 or 1); a half counts suffixes, a half grows the trees."""
    rows = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    rows = rows.withColumn("_o", F.xxhash64("url")).orderBy("_o", "url", "y").limit(max_rows)
    rows = cut(with_lexical(with_host_path(rows)), "urls")
    n, s = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n:
        drop_cut(rows)
        return Model()
    prior = (s + 0.5) / (n + 1)
    counted = rows.where(SHARED)
    tables = tuple(cut(counted.groupBy(k).agg(F.sum("y").alias(f"{k}_y"), F.count("*").alias(f"{k}_n")), "suffixes") for k in ("s1", "s2"))
    model = Model(math.log(prior / (1 - prior)), prior, [], tables)
    every, rows = rows, cut(_with_shares(rows.where(f"NOT ({SHARED})"), model), "urls")
    drop_cut(every)
    steps = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f] or [])) for f in FEATURES}
    for _ in range(rounds):
        margin = " + ".join([repr(model.base) + "D", *map(_case, model.trees)])
        model.trees.append(_grow(rows, margin, cuts, depth, rate, smooth))
    drop_cut(rows)
    return model


def _with_shares(df: DataFrame, model: Model, weight: float = 5.0) -> DataFrame:
    """f_suffix1 and f_suffix2: smoothed share of blocked URLs among the suffix's rows in the half that is counted."""
    for k, table in zip(("s1", "s2"), model.suffixes or (), strict=False):
        share = f"coalesce(({k}_y + {weight} * {model.prior!r}D) / ({k}_n + {weight}), {model.prior!r}D)"
        df = df.join(F.broadcast(table), k, "left").withColumn(f"f_suffix{k[1]}", F.expr(share)).drop(f"{k}_y", f"{k}_n")
    return df


def predict(df: DataFrame, model: Model, url: str = "url", out: str = "score") -> DataFrame:
    """df, with host and path, and the log odds of block; the model's own columns go again."""
    df = with_lexical(df, url)
    if model.suffixes is None:
        df = df.withColumns({"f_suffix1": F.lit(0.0), "f_suffix2": F.lit(0.0)})
    else:
        df = _with_shares(df, model)
    return df.withColumn(out, model.score()).drop(*FEATURES, "s1", "s2")


def op8_url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """Judge pages; the URLs that a rule decides are the labelled ones that the trees are fitted on."""
    name, verdict = rule_of(rules)
    judged = with_host_path(pages.select("page_id", "url")).withColumns({"rule": name, "_says": verdict})
    labelled = judged.where("_says IS NOT NULL").select("url", F.expr("int(_says = 'block')").alias("y"))
    scored = predict(judged, fit(labelled))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_says", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.round("score", 9).alias("block_score"))
