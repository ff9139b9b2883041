"""A treebank made of the documents: sentences, tagged tokens, a gold tree and three candidate trees each.

Real parses need trained tables that don't exist here, so trees are a fixed function of the text: lines are sentences,
tags follow from the word, and a tree groups tokens into chunks. All documents and whole texts are used. Everything is
row-local (no shuffle): spans follow from a sentence's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions.text import escape_brackets, split_punctuation
from sylva.sources.tables import spread, table

CANDIDATES = (0, 1, 2)
GOLD = -1
LABELS = ("NP", "VP", "PP")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, sentence: the lines with a character that isn't a space."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "sentence"))
    return lines.where(F.trim("sentence") != "").select((F.col("doc_id") * 1000000 + F.col("line")).alias("sent_id"), "sentence")


def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, forms (escaped)."""
    return sentences(spark, sf_dir).select("sent_id", F.transform(split_punctuation(F.col("sentence")), escape_brackets).alias("forms"))


TAG = """CASE WHEN form IN ('.', '!', '?') THEN '.' WHEN form IN (',', ';', ':') THEN ',' WHEN form IN ('-LRB-', '-RRB-') THEN form
WHEN lower(form) IN ('the', 'a', 'an', 'le', 'la', 'les', 'der', 'die', 'das', 'el', 'los') THEN 'DT'
WHEN lower(form) IN ('of', 'to', 'in', 'for', 'with', 'de', 'von', 'en', 'par') THEN 'IN'
WHEN lower(form) IN ('and', 'or', 'et', 'und', 'y') THEN 'CC'
WHEN length(form) % 4 = 0 THEN 'NN' WHEN length(form) % 4 = 1 THEN 'VB' WHEN length(form) % 4 = 2 THEN 'JJ' ELSE 'NNS' END"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, pos, form, tag."""
    each = token_arrays(spark, sf_dir).select("sent_id", F.posexplode("forms").alias("pos", "form"))
    return each.withColumn("tag", F.expr(TAG))


#: The label of chunk c of tree k.
LABEL = """CASE (c + CASE WHEN k >= 0 THEN k WHEN (sent_id + c) % 7 = 0 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'NP' WHEN 1 THEN 'VP' ELSE 'PP' END"""
WIDTH = "CASE WHEN k >= 0 THEN k + 2 ELSE 3 END"


def chunks(spark: SparkSession, sf_dir: str, trees=(GOLD, *CANDIDATES)) -> DataFrame:
    """sent_id, n, k, c, start, finish, label: the labelled chunks of each tree (k = -1 is gold)."""
    sized = token_arrays(spark, sf_dir).select("sent_id", F.size("forms").alias("n")).where("n > 0")
    each = sized.select("sent_id", "n", F.explode(F.array(*map(F.lit, trees))).alias("k")).withColumn("w", F.expr(WIDTH))
    each = each.select("sent_id", "n", "k", "w", F.explode(F.expr("sequence(0, (n - 1) div w)")).alias("c"))
    return each.select("sent_id", "n", "k", "c", (F.col("c") * F.col("w")).alias("start"), F.least(F.col("n"), (F.col("c") + 1) * F.col("w")).alias("finish"), F.expr(LABEL).alias("label"))


SCORE = "round(-(n * (k + 1)) / CAST(10 AS DOUBLE) - (sent_id % 7) / CAST(5 AS DOUBLE) + (sent_id % 3) * k, 6)"


def nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, n, k, logprob of each candidate."""
    sized = token_arrays(spark, sf_dir).select("sent_id", F.size("forms").alias("n")).where("n > 0")
    return sized.select("sent_id", "n", F.explode(F.array(*map(F.lit, CANDIDATES))).alias("k")).withColumn("logprob", F.expr(SCORE))


def trees(spark: SparkSession, sf_dir: str, k: int = GOLD) -> DataFrame:
    """sent_id, tree: the bracketed tree k of each sentence, built in place from the token array."""
    return _with_tree(_tagged(spark, sf_dir).withColumn("k", F.lit(k)), "tree").select("sent_id", "tree")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, n, leaves."""
    forms = token_arrays(spark, sf_dir).where(F.size("forms") > 0)
    return forms.select("sent_id", F.size("forms").alias("n"), F.expr(f"transform(forms, form -> concat('(', {TAG}, ' ', form, ')'))").alias("leaves"))


def _with_tree(each: DataFrame, name: str) -> DataFrame:
    """each (sent_id, k, leaves and others) with tree k under a name."""
    columns = each.columns
    inner = F.expr(f"array_join(transform(sequence(0, (size(leaves) - 1) div w), c -> concat('(', {LABEL}, ' ', array_join(slice(leaves, c * w + 1, w), ' '), ')')), ' ')")
    return each.withColumn("w", F.expr(WIDTH)).select(*columns, F.concat(F.lit("(S1 (S "), inner, F.lit("))")).alias(name))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, n, gold, trees: gold's tree and all candidates of a sentence in one row, by k."""
    each = _tagged(spark, sf_dir)
    for name, k in (("gold", GOLD), *((f"tree{k}", k) for k in CANDIDATES)):
        each = _with_tree(each.withColumn("k", F.lit(k)), name).drop("k")
    return each.select("sent_id", "n", "gold", F.array(*(f"tree{k}" for k in CANDIDATES)).alias("trees"))


def by_candidate(score: str):
    """The candidates' scores as an array, by k, from an expression on sent_id, n and k."""
    return F.expr(f"transform(array({', '.join(map(str, CANDIDATES))}), k -> {score})")


#: The same treebank in DuckDB's SQL, as common table expressions.
ORACLE = rf"""
sentences AS (
  SELECT doc_id * 1000000 + line AS sent_id, sentence
  FROM (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
  WHERE trim(sentence) <> ''),
token_arrays AS (
  SELECT sent_id, list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(sentence, '([.,!?;:()])', ' \1 ', 'g')), ' +'), lambda x: x <> ''),
         lambda x: replace(replace(replace(replace(replace(replace(x, '(', '-LRB-'), ')', '-RRB-'), '[', '-LSB-'), ']', '-RSB-'), '{{', '-LCB-'), '}}', '-RCB-')) AS forms
  FROM sentences),
tokens AS (
  SELECT sent_id, pos, form, {TAG} AS tag
  FROM (SELECT sent_id, unnest(forms) AS form, generate_subscripts(forms, 1) - 1 AS pos FROM token_arrays)),
sized AS (SELECT sent_id, len(forms) AS n FROM token_arrays WHERE len(forms) > 0),
chunks AS (
  SELECT sent_id, n, k, c, c * w AS start, least(n, (c + 1) * w) AS finish, {LABEL} AS label
  FROM (SELECT sent_id, n, k, w, unnest(range(0, (n - 1) // w + 1)) AS c
        FROM (SELECT sent_id, n, k, {WIDTH} AS w FROM sized, (VALUES (-1), (0), (1), (2)) AS t(k)))),
nbest AS (SELECT sent_id, n, k, {SCORE} AS logprob FROM sized, (VALUES (0), (1), (2)) AS t(k)),
leaves AS (SELECT t.sent_id, c.k, c.c, c.label, string_agg('(' || tag || ' ' || form || ')', ' ' ORDER BY pos) AS part
  FROM tokens t JOIN chunks c ON t.sent_id = c.sent_id AND pos >= start AND pos < finish WHERE c.k = -1 GROUP BY ALL),
trees AS (SELECT sent_id, '(S1 (S ' || string_agg('(' || label || ' ' || part || ')', ' ' ORDER BY c) || '))' AS tree FROM leaves GROUP BY sent_id)"""
