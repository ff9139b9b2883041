"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Every measure is an expression over the text; RULES names a measure, a lowest and a highest value. A document
passes when each rule holds. There is no user function, no join and no shuffle: the plan is scan, project.

Nulls and empty texts have no words; all their measures are 0 and they fail on length. Repeated rows are judged
each for itself, and an empty table gives an empty result. Only the asked-for columns of the input are kept, so
extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for with was on as be by at this are or an a have had he you not "
    "le la de des et les en un une du que qui dans pour par sur au est ne pas plus "
    "der die das und ist von den mit zu ein eine auf im für nicht dem sich "
    "el los las del y que en un una por con para se su al es lo como"
).split()

#: Words are runs without these characters.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: (name, measure, lowest, highest); None is no bound. Measures are 0 where their divisor is 0.
RULES = (
    ("words", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("mean_word_length", "mean_word_length", 2.0, 15.0),
    ("symbols_per_word", "symbol_ratio", None, 0.25),
    ("stop_words", "stop_ratio", 0.01, None),
    ("duplicate_lines", "dup_line_ratio", None, 0.4),
    ("shouted_words", "shout_ratio", None, 0.4),
)


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop, n_shout."""
    base = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    split = base.select(*keep, "_t", F.expr(f"array_remove(split(_t, r'{SPACES}'), '')").alias("_w"), F.expr(rf"filter(split(_t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')").alias("_l"))
    hashed = split.select(
        *keep, "_t", "_w", "_l",
        F.expr("if(size(_w) < 4, cast(array() as array<bigint>), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))").alias("_h"),
    )
    # windows that stand twice: sort (hash, place) and look at the neighbours; only texts that have any are sorted
    ordered = hashed.select(
        *keep, "_t", "_w", "_l",
        F.expr("if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, p: int>>), sort_array(transform(_h, (h, p) -> named_struct('h', h, 'p', p))))").alias("_s"),
    )
    placed = ordered.select(
        *keep, "_t", "_w", "_l",
        F.expr("sort_array(transform(filter(_s, (x, i) -> (i > 0 and _s[i - 1].h = x.h) or (i < size(_s) - 1 and _s[i + 1].h = x.h)), x -> x.p))").alias("_p"),
    )
    # a row number is never under 0; with it in the projection the optimizer leaves filters above it and computes all this once
    return placed.select(
        *keep,
        F.expr("cast(size(_w) as bigint)").alias("n_words"),
        F.expr(rf"cast(length(regexp_replace(_t, r'{SPACES}', '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(length(_t) - length(translate(_t, '{SYMBOLS}', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(_l) as bigint)").alias("n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(if(monotonically_increasing_id() < 0, null, aggregate(_p, named_struct('n', 0, 'e', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.e), 'e', p + 3), a -> a.n)) as bigint)").alias("n_repeat_words"),
        F.expr(f"cast(size(filter(_w, x -> lower(x) in ({_sql_list(STOP_WORDS)}))) as bigint)").alias("n_stop"),
        F.expr("cast(size(filter(_w, x -> length(x) > 1 and x = upper(x) and x <> lower(x))) as bigint)").alias("n_shout"),
    )


def ratios(df: DataFrame) -> DataFrame:
    over = lambda a, b: F.expr(f"if({b} = 0, 0D, {a} / {b})")
    return df.withColumns({
        "repeat_ratio": over("n_repeat_words", "n_words"), "mean_word_length": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"), "stop_ratio": over("n_stop", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"), "shout_ratio": over("n_shout", "n_words"),
    })


def failed_rules(rules=RULES) -> F.Column:
    """Names of the rules that a row of ratios() breaks."""
    tests = []
    for name, measure, low, high in rules:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(measure) >= F.lit(low))
        if high is not None:
            ok = ok & (F.col(measure) <= F.lit(high))
        tests.append(F.when(~ok, F.lit(name)))
    return F.array_compact(F.array(*tests))


def apply_rules(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=RULES) -> DataFrame:
    """measures(), ratios(), failed (list of rule names) and passed."""
    out = ratios(measures(df, text, keep)).withColumn("failed", failed_rules(rules))
    return out.withColumn("passed", F.size("failed") == 0)


def op10_quality_rules(df: DataFrame) -> DataFrame:
    out = apply_rules(df)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.col("passed")).alias("kept"))


def keep_good(df: DataFrame, rules=RULES) -> DataFrame:
    """The rows of df that pass, with their own columns (the pipeline's filter; also a plain projection)."""
    spare = "_sylva_row"
    while spare in df.columns:
        spare += "_"
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(spare), F.col("text").alias("text"))
    judged = apply_rules(packed, "text", (spare,), rules).where("passed")
    return judged.select(f"{spare}.*")
