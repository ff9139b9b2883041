"""Queries that score the deep trees by the conditional model, and SQL that gives the same rows from DuckDB's own node table.

The model is counted on the gold trees; the candidates are scored. Weights are bucket / 15, where their estimation starts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import heads, tables, text
from sylva.functions.text import BUCKETS
from sylva.operators import comparison, conditional, thirds, treemodel, trees, words
from sylva.plans import deep, nested
from sylva.plans import treebank as tb
from sylva.plans.oracles import MATCH_SQL, with_treebank
from sylva.sources import files, formats
from sylva.sources.shared import shared_dir
from sylva.sources.tables import table
from sylva.streaming import ordered

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ("sent_id", "k")
#: The queries that take longest; a run over all queries has them last.
LONGEST = ("tree_log_probs", "calc_log_probs", "inside_scores")


def _on(a: str, b: str, x: str, y: str) -> str:
    return f"{b}.sent_id = {a}.sent_id AND {b}.k = {a}.k AND {b}.{y} = {a}.{x}"


def _kid(d: int, left: bool = False) -> str:
    out = f"spot + {d} < 0 OR spot + {d} >= len(kids)" + (f" OR spot + {d} > hx" if left else "")
    return f"CASE WHEN {out} THEN 'STOP' ELSE kids[spot + {d} + 1] END"


#: The functions as SQL on the rows of each kind of event.
_FUNCTIONS = {
    **{f: f"f_{f}" for f in "tuhlmvbic"}, "T": "'1'", "Bl": "f_bl", "L0": _kid(0), **{f"L{d}": _kid(d, True) for d in (1, 2, 3)}, **{f"R{d}": _kid(-d) for d in (1, 2, 3)},
    "Qr": "CASE WHEN list_filter(kids[1:spot], lambda x: x IN ('``', ''''''))[-1] = '``' THEN '0' ELSE '1' END",
    "Ql": "CASE WHEN list_filter(kids[spot + 2:hx + 1], lambda x: x IN ('``', ''''''))[1] = '''''' THEN '0' ELSE '1' END",
}
_PLACES = {"m": "[hx]", "ru": "[hx]", "r": "range(hx + 1, len(kids) + 1)", "rm": "range(hx, len(kids) + 1)", "l": "list_concat([-1], range(0, hx))", "lm": "range(-1, hx + 1)"}


def _context(calc: str) -> str:
    return "[" + ", ".join(_FUNCTIONS[f] for f, _ in conditional.CALCS[calc]) + "]"


def _event_sql(calc: str) -> str:
    if calc in ("h", "u"):
        return f"SELECT sent_id, k, node, '{calc}' AS calc, f_{calc} AS y, {_context(calc)} AS ctx FROM m_own WHERE has AND (head IS NULL OR head <> node) AND (word IS NULL OR f_t IN {deep._in(heads.TAGS)})"
    if calc == "tt":
        return f"SELECT sent_id, k, node, 'tt', f_t, {_context('tt')} FROM (SELECT *, coalesce(lag(f_t) OVER (PARTITION BY sent_id, k ORDER BY start), 'STOP') AS f_bl FROM m_own WHERE word IS NOT NULL AND finish > start)"
    return f"SELECT sent_id, k, node, '{calc}', {_kid(0)}, {_context(calc)} FROM (SELECT *, unnest({_PLACES[calc]}) AS spot FROM m_phrases)"


def _chain_sql(calc: str) -> str:
    """Probabilities of one calculation's events, level after level."""
    spec = conditional.CALCS[calc]
    wide = ", ".join(f"max(CASE WHEN level = {i} THEN tot END) AS t{i}, coalesce(max(CASE WHEN level = {i} THEN g END), 0) AS g{i}" for i in range(1, len(spec) + 1))
    columns = ["CASE WHEN g1 > 0 THEN g1 ELSE 0.0001 END AS p1"]
    for i, (_, start) in enumerate(spec[1:], 2):
        bounds = ", ".join(map(str, BUCKETS))
        columns.append(f"least(0.998, len(list_filter([{bounds}], lambda b: t{i} * p1 > b)) / 15.0::DOUBLE) AS w{i}")
        columns.append(f"CASE WHEN t{i} IS NOT NULL AND p{start} IS NOT NULL THEN w{i} * g{i} + (1 - w{i}) * p{start} END AS p{i}")
    product = " * ".join(["p1", *(f"coalesce(p{i} / p{start}, 1)" for i, (_, start) in enumerate(spec[1:], 2))])
    return f"SELECT calc, ctx, y, CAST(round(log2({product}) * {treemodel.MICRO}) AS BIGINT) AS micro FROM (SELECT *, {', '.join(columns)} FROM (SELECT calc, ctx, y, {wide} FROM m_known WHERE calc = '{calc}' GROUP BY calc, ctx, y))"


def _levels_sql(rows: str, extra: str) -> str:
    parts = []
    for calc in conditional.CALCS:
        for i, path in enumerate(conditional.level_paths(calc), 1):
            parts.append(f"SELECT calc, {i} AS level, [{', '.join(f'ctx[{p + 1}]' for p in path)}] AS path, y{extra} FROM {rows} WHERE calc = '{calc}'")
    return " UNION ALL ".join(parts)


_TO_BE = deep._in(conditional.TO_BE)
_MODEL = f"""
m0 AS MATERIALIZED (SELECT c.sent_id, c.k, c.node, c.parent, c.start, c.finish, c.cat AS f_t, c.word, x.node IS NOT NULL AS has, coalesce(x.cat, 'STOP') AS f_u,
    coalesce(translate(x.word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^^') AS f_h
  FROM c0 c LEFT JOIN lex l ON {_on("c", "l", "node", "node")} LEFT JOIN c0 x ON {_on("l", "x", "lex", "node")}),
m1 AS (SELECT c.*, coalesce(p.f_t, 'S1') AS f_l, coalesce(g.f_t, 'S1') AS f_m, coalesce(p.f_h, '^^') AS f_i, p.node AS up,
    CASE WHEN p.node IS NULL THEN 'STOP' WHEN p.f_u IN ('AUX', 'AUXG') AND p.f_h IN {_TO_BE} THEN 'BE' ELSE p.f_u END AS f_v
  FROM m0 c LEFT JOIN m0 p ON {_on("c", "p", "parent", "node")} LEFT JOIN m0 g ON {_on("p", "g", "parent", "node")}),
m2 AS (SELECT *, coalesce(lag(f_t) OVER w, 'STOP') AS f_b, row_number() OVER w AS nth FROM m1 WINDOW w AS (PARTITION BY sent_id, k, parent ORDER BY node)),
m3 AS (SELECT *, sum(CASE WHEN f_t = f_l THEN 1 ELSE 0 END) OVER w AS alike, bool_or(nth > 1 AND f_t = 'CC') OVER w AS cc, bool_or(nth > 1 AND f_t IN ('CC', ',', ':')) OVER w AS mark FROM m2 WINDOW w AS (PARTITION BY sent_id, k, parent)),
m_own AS MATERIALIZED (SELECT m3.*, h.node AS head, CASE WHEN up IS NULL OR f_t <> f_l OR f_l NOT IN ('NP', 'S', 'VP') THEN f_l WHEN f_l = 'NP' AND alike = 2 AND NOT cc THEN 'NP+2' WHEN alike > 1 AND mark THEN f_l || '+CC' ELSE f_l END AS f_c
  FROM m3 LEFT JOIN head h ON {_on("m3", "h", "parent", "parent")}),
m_kids AS (SELECT sent_id, k, parent, list(cat ORDER BY node) AS kids, list(node ORDER BY node) AS ids FROM c0 WHERE parent IS NOT NULL GROUP BY sent_id, k, parent),
m_phrases AS MATERIALIZED (SELECT * FROM (SELECT o.*, kids, list_position(ids, h.node) - 1 AS hx FROM m_own o JOIN m_kids c ON {_on("o", "c", "node", "parent")} JOIN head h ON {_on("o", "h", "node", "parent")} WHERE word IS NULL)
  WHERE NOT (len(kids) = 1 AND kids[1] = f_t)),
m_events AS MATERIALIZED ({" UNION ALL ".join(map(_event_sql, conditional.CALCS))}),
m_gold AS (SELECT calc, ctx, y, count(*) AS cnt FROM m_events WHERE k = -1 GROUP BY ALL),
m_counts AS MATERIALIZED (SELECT calc, level, path, y, sum(cnt) AS cnt FROM ({_levels_sql("m_gold", ", cnt")}) GROUP BY ALL),
m_tot AS MATERIALIZED (SELECT calc, level, path, sum(cnt) AS tot FROM m_counts GROUP BY ALL),
m_different AS MATERIALIZED (SELECT DISTINCT calc, ctx, y FROM m_events WHERE k >= 0),
m_asked AS ({_levels_sql("m_different", ", ctx")}),
m_known AS MATERIALIZED (SELECT a.calc, a.ctx, a.y, a.level, CAST(t.tot AS DOUBLE) AS tot, CAST(c.cnt AS DOUBLE) / CAST(t.tot AS DOUBLE) AS g
  FROM m_asked a LEFT JOIN m_tot t USING (calc, level, path) LEFT JOIN m_counts c USING (calc, level, path, y)),
m_scores AS MATERIALIZED ({" UNION ALL ".join(map(_chain_sql, conditional.CALCS))}),
m_scored AS (SELECT e.sent_id, e.k, e.node, e.calc, s.micro FROM m_events e JOIN m_scores s USING (calc, ctx, y) WHERE e.k >= 0)"""
_TREE_CALCS = "(" + ", ".join(f"'{c}'" for c in treemodel.TREE_CALCS) + ")"


def query(sql: str, *ctes: str):
    """Register a query under its function's name; sql may use m_scored (the candidates' events with their scores)."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = "WITH RECURSIVE " + ",\n".join([tb.ORACLE.strip(), *nested.nodes_sql("k >= -1"), deep._FIRST, _MODEL, *ctes]) + "\n" + sql
        return f

    return add


def _tables(spark, sf, calcs=treemodel.TREE_CALCS) -> DataFrame:
    """The level tables of calculations, counted on the gold trees."""
    return treemodel.level_tables(treemodel.counted_events(nested.trees(spark, sf), calcs))


def _candidates(spark, sf) -> DataFrame:
    return nested.trees(spark, sf, tb.CANDIDATES)


_SUMS = ", ".join(f"CAST(sum(CASE WHEN calc = '{c}' THEN micro ELSE 0 END) AS BIGINT) AS micro_{c}" for c in treemodel.TREE_CALCS)


@query(f"SELECT sent_id, k, count(*) AS n_events, CAST(sum(micro) AS BIGINT) AS micro, {_SUMS} FROM m_scored WHERE calc IN {_TREE_CALCS} GROUP BY sent_id, k")
def tree_log_probs(spark, sf):
    """log2 probabilities of the candidates in millionths of a bit, by tree."""
    return treemodel.tree_scores(_candidates(spark, sf), _tables(spark, sf), key=KEY)


@query("SELECT calc, k, count(*) AS n, CAST(sum(micro) AS BIGINT) AS micro FROM m_scored GROUP BY calc, k")
def calc_log_probs(spark, sf):
    """H3, I4: events of every calculation with their scores, by calculation and candidate."""
    return treemodel.calc_scores(_candidates(spark, sf), _tables(spark, sf, tuple(conditional.CALCS)))


_UPTO = f"""
closing AS (SELECT * FROM (SELECT sent_id, k, node, mark, lead(node) OVER (PARTITION BY sent_id, k, lev ORDER BY p) AS last FROM opened) WHERE mark = '('),
up AS MATERIALIZED (SELECT n.sent_id, n.k, n.node, n.cat AS label, c.last, coalesce(s.micro, 0) AS own, sum(coalesce(s.micro, 0)) OVER (PARTITION BY n.sent_id, n.k ORDER BY n.node) AS upto
  FROM c0 n JOIN closing c ON {_on("n", "c", "node", "node")} LEFT JOIN (SELECT sent_id, k, node, sum(micro) AS micro FROM m_scored WHERE calc IN {_TREE_CALCS} GROUP BY ALL) s ON {_on("n", "s", "node", "node")} WHERE n.k >= 0)"""


@query(f"SELECT a.k, a.label, count(*) AS n, CAST(sum(b.upto - a.upto + a.own) AS BIGINT) AS micro FROM up a JOIN up b ON {_on('a', 'b', 'last', 'node')} GROUP BY a.k, a.label", _UPTO)
def inside_scores(spark, sf):
    """The score of each node's subtree, by candidate and label."""
    scores = treemodel.inside_scores(_candidates(spark, sf), _tables(spark, sf), key=KEY)
    return scores.groupBy("k", "label").agg(F.count("*").alias("n"), F.sum("micro").alias("micro"))


# --- words: the model of the documents' tokens on the words of the conversations

_FORMS = tb.ORACLE[tb.ORACLE.index("list_transform(list_filter") : tb.ORACLE.index(" AS forms")]


def _cap(form: str, pos: str, first: str) -> str:
    differs = lambda i: f"substring({form}, {i}, 1) <> lower(substring({form}, {i}, 1))"
    return f"CASE WHEN {pos} = 0 OR ({pos} = 1 AND {first} IN ({', '.join(repr(x) for x in words.OPENERS)})) OR length({form}) < 2 OR ({differs(1)} AND {differs(2)}) THEN -1 WHEN {differs(1)} THEN 1 ELSE 0 END"


_OPEN = deep._in(heads.OPEN_TAGS)
_WORDS = f"""
w_seen AS (SELECT *, lower(form) AS word, {_cap("form", "pos", "''")} AS cap, count(*) OVER (PARTITION BY lower(form)) AS seen FROM tokens),
w_tags AS (SELECT tag, count(*) AS n, count(*) FILTER (seen <= 2) / count(*) AS pu, coalesce(count(*) FILTER (pos >= 2 AND cap = 1) / nullif(count(*) FILTER (pos >= 2 AND cap >= 0), 0), 0) AS pc,
  coalesce(count(*) FILTER (seen <= 2 AND contains(form, '-')) / nullif(count(*) FILTER (seen <= 2), 0), 0) AS ph FROM w_seen GROUP BY tag),
w_lexicon AS (SELECT word, tag, count(*) / any_value(n) AS g FROM w_seen JOIN w_tags USING (tag) GROUP BY word, tag),
w_ends AS (SELECT tag, right(word, 2) AS ending, count(*) AS c FROM w_seen WHERE tag IN {_OPEN} AND seen <= 4 AND length(word) >= 3 GROUP BY ALL),
w_endings AS (SELECT tag, ending, c / sum(c) OVER (PARTITION BY tag) AS pe FROM w_ends),
w_forms AS (SELECT {_FORMS} AS forms FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS sentence FROM conversations) WHERE trim(sentence) <> ''),
w_tokens AS (SELECT unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS pos, forms[1] AS first FROM w_forms),
w_kinds AS (SELECT DISTINCT lower(form) AS word, {_cap("form", "pos", "first")} AS cap FROM w_tokens),
w_known AS (SELECT word, cap, tag, g * CASE cap WHEN -1 THEN 1 WHEN 1 THEN pc ELSE 1 - pc END * (1 - pu) AS p FROM w_kinds JOIN w_lexicon USING (word) JOIN w_tags USING (tag)),
w_unknown AS (SELECT word, cap, t.tag, pu * CASE WHEN contains(word, '-') THEN ph ELSE 1 - ph END * CASE cap WHEN -1 THEN 1 WHEN 1 THEN pc ELSE 1 - pc END * 0.0001::DOUBLE
    * CASE WHEN t.tag NOT IN {_OPEN} THEN 0.0001::DOUBLE WHEN length(word) < 3 THEN 0.01::DOUBLE ELSE coalesce(pe, 0.00001::DOUBLE) END * 600 AS p
  FROM (SELECT * FROM w_kinds k WHERE NOT EXISTS (SELECT 1 FROM w_known x WHERE x.word = k.word AND x.cap = k.cap AND x.p > 0))
  CROSS JOIN w_tags t LEFT JOIN w_endings e ON e.tag = t.tag AND e.ending = right(word, 2))"""


def _talk(spark, sf) -> DataFrame:
    """form, pos, first: the tokens of the conversations' lines."""
    lines = table(spark, sf, "conversations").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("sentence")).where(F.trim("sentence") != "")
    forms = lines.select(F.transform(text.split_punctuation(F.col("sentence")), text.escape_brackets).alias("forms"))
    return forms.select(F.posexplode("forms").alias("pos", "form"), F.get("forms", F.lit(0)).alias("first"))


def word_tags(spark, sf):
    """Tags of the conversations' words with log2 P(word | tag) in millionths of a bit, known words and unknown ones."""
    model = words.word_model(tb.tokens(spark, sf))
    found = words.word_tags(words.kinds(_talk(spark, sf), model).select("word", "cap").distinct(), model)
    return found.select("word", F.coalesce("cap", F.lit(-1)).alias("cap"), "tag", "known", F.round(F.log2("p") * treemodel.MICRO).cast("long").alias("micro"))


QUERIES["word_tags"] = word_tags
ORACLES["word_tags"] = with_treebank(f"""SELECT word, cap, tag, known, CAST(round(log2(p) * {treemodel.MICRO}) AS BIGINT) AS micro FROM (
SELECT word, cap, tag, true AS known, p FROM w_known UNION ALL SELECT word, cap, tag, false, p FROM w_unknown) WHERE p > 0""", _WORDS)


# --- two candidates as two systems

_TRIALS, _SEED = 200, 17
_DRAW = "CAST('0x' || substr(md5(concat_ws(':', sent_id, trial, {0})), 1, 8) AS BIGINT)"
_TIMES = " + ".join(f"CASE WHEN d >= {b} THEN 1 ELSE 0 END" for b in comparison.poisson_bounds())
_RATIO = "CASE WHEN {0}g + {0}e > 0 THEN 2 * {0}m / ({0}g + {0}e) ELSE 0 END"
_SIX = [x + c for x in "ab" for c in "gem"]  # gold, test and matched of both
_PAIRS = f"""
e_rows AS (SELECT a.sent_id, a.n_gold AS ag, a.n_test AS ae, a.n_matched AS am, b.n_gold AS bg, b.n_test AS be, b.n_matched AS bm FROM matched a JOIN matched b ON a.sent_id = b.sent_id AND a.k = 0 AND b.k = 1),
e_better AS (SELECT count(*) AS n, count(*) FILTER (x > y) AS better_a, count(*) FILTER (x < y) AS better_b, count(*) FILTER (x = y) AS tied, {", ".join(f"sum({c}) AS {c}" for c in _SIX)}
  FROM (SELECT *, round({_RATIO.format("a")}, 12) AS x, round({_RATIO.format("b")}, 12) AS y FROM e_rows)),
e_boot AS (SELECT trial, {", ".join(f"sum(w * {c}) AS {c}" for c in _SIX)}
  FROM (SELECT *, {_TIMES} AS w FROM (SELECT *, {_DRAW.format(_SEED)} AS d FROM e_rows, (SELECT unnest(range(1, {_TRIALS + 1})) AS trial))) GROUP BY trial),
e_interval AS (SELECT quantile_cont(x, 0.025) AS low_a, quantile_cont(x, 0.975) AS high_a, quantile_cont(y, 0.025) AS low_b, quantile_cont(y, 0.975) AS high_b FROM (SELECT {_RATIO.format("a")} AS x, {_RATIO.format("b")} AS y FROM e_boot)),
e_swap AS (SELECT *, trial > 0 AND {_DRAW.format(_SEED + 1)} % 2 = 1 AS s FROM e_rows, (SELECT unnest(range(0, {_TRIALS + 1})) AS trial)),
e_sums AS (SELECT trial, {", ".join(f"sum(CASE WHEN s THEN {y}{c} ELSE {x}{c} END) AS {x}{c}" for x, y in ("ab", "ba") for c in "gem")} FROM e_swap GROUP BY trial),
e_gaps AS (SELECT trial, abs({_RATIO.format("a")} - {_RATIO.format("b")}) AS gap FROM e_sums),
e_p AS (SELECT (count(*) FILTER (gap >= (SELECT gap FROM e_gaps WHERE trial = 0) - 1e-12) + 1) / (count(*) + 1) AS permutation_p FROM e_gaps WHERE trial > 0),
e_tail AS (SELECT least(1.0::DOUBLE, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))) AS binomial_p FROM (SELECT better_a + better_b AS m, unnest(range(0, least(better_a, better_b) + 1)) AS i FROM e_better))"""


def model_comparison(spark, sf):
    """The first two candidates as two systems: sentences won, binomial test, bootstrap intervals, permutation test."""
    from sylva.plans.catalog import _counted

    counts = _counted(spark, sf).drop("n")
    row = comparison.compare(counts.where("k = 0"), counts.where("k = 1"), _TRIALS, _SEED)
    return row.select("n", "better_a", "better_b", "tied", *[F.round(c, 9).alias(c) for c in row.columns if c[0] in "flhp"], F.round("binomial_p", 9).alias("binomial_p"))


QUERIES["model_comparison"] = model_comparison
ORACLES["model_comparison"] = with_treebank(f"""SELECT n, better_a, better_b, tied, round({_RATIO.format("a")}, 9) AS f_a, round({_RATIO.format("b")}, 9) AS f_b, round(low_a, 9) AS low_a, round(high_a, 9) AS high_a,
round(low_b, 9) AS low_b, round(high_b, 9) AS high_b, round(permutation_p, 9) AS permutation_p, round(binomial_p, 9) AS binomial_p FROM e_better, e_interval, e_p, e_tail""", MATCH_SQL, _PAIRS)


# --- a stream of lists


def ordered_stream(spark, sf):
    """O: the deep candidates as files of parses in mixed order, streamed two files a batch, lists out in the order of a document's sentences."""
    from sylva.plans.extra import _lists

    number = F.dense_rank().over(Window.partitionBy("stream").orderBy("sent_id")) - 1
    rows = _lists(spark, sf).withColumn("stream", F.expr("CAST(sent_id div 1000000 AS STRING)")).withColumn("sent_no", number.cast("long"))
    rows = rows.select("stream", "sent_no", F.lit(len(tb.CANDIDATES)).alias("n"), "k", "logprob", "tree", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.repartition(6, F.xxhash64("stream", "sent_no", "k")).write.parquet(f"{base}/in")
    out = ordered.run_now(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", files=2)
    return out.select("stream", "sent_no", "seq", "whole", "rank", "k", "logprob", F.md5("tree").alias("tree"))


QUERIES["ordered_stream"] = ordered_stream
ORACLES["ordered_stream"] = with_treebank("""SELECT stream, sent_no, sent_no AS seq, true AS whole, CAST(row_number() OVER (PARTITION BY stream, sent_no ORDER BY logprob DESC, k) AS INTEGER) AS rank, k, logprob, md5(tree) AS tree FROM (
SELECT *, dense_rank() OVER (PARTITION BY stream ORDER BY sent_id) - 1 AS sent_no FROM (SELECT CAST(sent_id // 1000000 AS VARCHAR) AS stream, sent_id, k, logprob, tree FROM ntrees JOIN nbest USING (sent_id, k) WHERE k >= 0))""", nested.TREES_SQL)


# --- files read by splits


def _file_query(name: str, what: str, write, read, sql: str, *ctes: str) -> None:
    """A query that writes rows as text files to the shared folder and reads them in splits of 100,000 bytes."""

    def run(spark, sf):
        files.register(spark)
        folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        write(spark, sf).write.text(folder)
        return read(spark.read.format(what).option("split_bytes", 100_000).load(folder))

    run.__name__, run.__doc__ = name, f"{what}: text files written, and read again by byte ranges."
    QUERIES[name], ORACLES[name] = run, with_treebank(sql, *ctes)


_file_query("sgml_files", "sylva_sgml", lambda spark, sf: formats.write_sgml(tb.sentences(spark, sf)), lambda df: formats.read_sgml(df).select("sent_id", F.md5("sentence").alias("sentence")),
            "SELECT sent_id, md5(regexp_replace(sentence, '^\\s+|\\s+$', '', 'g')) AS sentence FROM sentences")
_file_query("tree_files", "sylva_trees", lambda spark, sf: nested.trees(spark, sf).select("tree"), lambda df: df.groupBy(F.md5("text").alias("tree")).agg(F.count("*").alias("n")),
            "SELECT md5(tree) AS tree, count(*) AS n FROM ntrees WHERE k = -1 GROUP BY ALL", nested.TREES_SQL)


def _list_texts(spark, sf) -> DataFrame:
    return formats.write_list_rows(nested.arrays(spark, sf).select("sent_id", tb.by_candidate(tb.SCORE).alias("logprobs"), "trees"))


_file_query("nbest_files", "sylva_nbest", _list_texts, lambda df: formats.read_nbest(df).select(F.col("sent_id").cast("long").alias("sent_id"), "k", "logprob", F.md5("tree").alias("tree")),
            "SELECT sent_id, k, logprob, md5(tree) AS tree FROM ntrees JOIN nbest USING (sent_id, k) WHERE k >= 0", nested.TREES_SQL)


# --- table functions in SQL


def _sql(spark, text_: str, **views: DataFrame) -> DataFrame:
    """Spark SQL with the table functions, over views of these names (made anew each time)."""
    tables.register(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text_)


def lateral_nodes(spark, sf):
    """Nodes of the deep trees by a lateral table function."""
    return _sql(spark, "SELECT n.label, least(n.depth, 40) AS depth, count(*) AS n, sum(n.start) AS starts, count(n.word) AS words FROM sylva_trees t, LATERAL tree_nodes(t.tree) n GROUP BY ALL", sylva_trees=nested.trees(spark, sf))


def best_parses(spark, sf):
    """The best two candidates of each sentence by a table function that declares its partitioning."""
    return _sql(spark, "SELECT sent_id, k, logprob, rank FROM best_parses(TABLE(sylva_lists), 2)", sylva_lists=tb.nbest(spark, sf))


QUERIES |= {"lateral_nodes": lateral_nodes, "best_parses": best_parses}
ORACLES["lateral_nodes"] = "WITH RECURSIVE " + ",\n".join([tb.ORACLE.strip(), *nested.nodes_sql("k = -1")]) + "\nSELECT label, least(depth, 40) AS depth, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, count(word) AS words FROM nn GROUP BY ALL"
ORACLES["best_parses"] = with_treebank("SELECT sent_id, k, logprob, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY logprob DESC, k) AS r FROM nbest) WHERE r <= 2")


# --- third relations

_RULES = [*thirds.THIRDS, ("NP", "PP", 1, "S"), ("NP", "VP", 1, "S"), ("NP", "NP", 1, "S"), ("NN", "NP", 1, "S"), ("NN", "NP", 2, "NN"), ("JJ", "NP", 2, "NN"), ("NP", "S", 2, "PP"), ("PP", "S", 2, "VP"),
          ("NP", "S", 3, "NN"), ("ADVP", "S", 3, "NP"), ("NP", "VP", 3, "NN"), ("SBAR", "SBAR", 4, "SBAR"), ("SBAR", "S", 4, "S"), ("NP", "S", 4, "S"), ("VP", "S", 4, "S")]
_THIRDS = f"""
t_own AS (SELECT c.sent_id, c.k, c.node, c.parent, c.cat AS dep, x.lex, h.node AS p_head, p.cat AS above, p.parent AS up, xp.lex AS p_lex, xo.lex AS o_lex,
    row_number() OVER w AS ix, lag(c.node) OVER w AS bef, lead(c.node) OVER w AS aft
  FROM c0 c JOIN c0 p ON {_on("c", "p", "parent", "node")} LEFT JOIN lex x ON {_on("c", "x", "node", "node")} LEFT JOIN lex xp ON {_on("p", "xp", "node", "node")}
  LEFT JOIN head h ON {_on("c", "h", "parent", "parent")} LEFT JOIN lex xo ON {_on("p", "xo", "parent", "node")} WINDOW w AS (PARTITION BY c.sent_id, c.k, c.parent ORDER BY c.node)),
t_at AS (SELECT *, max(CASE WHEN node = p_head THEN ix END) OVER (PARTITION BY sent_id, k, parent) AS hx FROM t_own),
t_kids AS (SELECT sent_id, k, parent, list(node ORDER BY node) AS ids FROM c0 WHERE parent IS NOT NULL GROUP BY ALL),
t_in AS (SELECT a.*, ids, i.node AS i_head FROM t_at a LEFT JOIN t_kids c ON {_on("a", "c", "p_head", "parent")} LEFT JOIN head i ON {_on("a", "i", "p_head", "parent")}),
t_rel AS (SELECT sent_id, k, node, dep, above, 1 AS rel, CASE WHEN p_lex IS DISTINCT FROM lex AND up IS NOT NULL AND o_lex IS DISTINCT FROM lex THEN up END AS third FROM t_in
  UNION ALL SELECT sent_id, k, node, dep, above, 2, CASE WHEN ix > hx + 1 THEN bef WHEN ix < hx - 1 THEN aft END FROM t_in
  UNION ALL SELECT sent_id, k, node, dep, above, 3, CASE WHEN i_head IS NULL THEN NULL WHEN ix = hx - 1 THEN CASE WHEN ids[1] <> i_head THEN ids[1] ELSE ids[2] END
    WHEN ix = hx + 1 THEN CASE WHEN ids[-1] <> i_head THEN ids[-1] WHEN len(ids) > 1 THEN ids[-2] END END FROM t_in
  UNION ALL SELECT sent_id, k, node, dep, above, 4, CASE WHEN p_lex IS DISTINCT FROM lex THEN parent END FROM t_in),
t_rules(ord, dep, above, rel, term) AS (VALUES {", ".join(str((i, *r)) for i, r in enumerate(_RULES))}),
t_held AS (SELECT r.*, u.ord, u.term, x.lex AS third_lex, row_number() OVER (PARTITION BY r.sent_id, r.k, r.node ORDER BY u.ord) AS nth
  FROM t_rel r JOIN c0 c ON {_on("r", "c", "third", "node")} JOIN t_rules u ON u.dep = r.dep AND u.above = r.above AND u.rel = r.rel AND u.term = c.cat LEFT JOIN lex x ON {_on("r", "x", "third", "node")})"""


def third_relations(spark, sf):
    """Nodes of the gold trees by the first rule that names a third node, with that node's head word."""
    return thirds.third_totals(nested.trees(spark, sf), _RULES)


QUERIES["third_relations"] = third_relations
ORACLES["third_relations"] = "WITH RECURSIVE " + ",\n".join([tb.ORACLE.strip(), *nested.nodes_sql("k = -1"), deep._FIRST, _THIRDS]) + f"""
SELECT t.dep, t.above, t.rel, t.term, coalesce(translate(x.word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^^') AS word, count(*) AS n, CAST(sum(t.third) AS BIGINT) AS thirds
FROM t_held t LEFT JOIN c0 x ON {_on("t", "x", "third_lex", "node")} WHERE nth = 1 GROUP BY ALL"""
