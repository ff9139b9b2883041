"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sylva.llm import divergence
from sylva.llm.licences import TEMPLATES
from sylva.llm.quality import RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_ctes() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ratio = {
        "n_words": "n_words", "repeat_ratio": "n_repeat_words / n_words", "mean_word_length": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words",
        "stop_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / n_lines", "shout_ratio": "n_shout / n_words",
    }
    tests = []
    for _, measure, low, high in RULES:
        value = f"coalesce({ratio[measure]}, 0)"
        tests += [f"{value} >= {low}"] * (low is not None) + [f"{value} <= {high}"] * (high is not None)
    return rf"""
q_rows AS (SELECT row_number() OVER () AS rid, * FROM documents),
q_words AS (
  SELECT rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM q_rows),
q_tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM q_words)),
q_rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM q_tri) WHERE c > 1),
q_cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM q_rep, (VALUES (0), (1), (2)) AS v(d) GROUP BY rid),
q_counts AS (
  SELECT w.rid, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop,
         len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_shout
  FROM q_words w LEFT JOIN q_cov c USING (rid)),
q_judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, ({' AND '.join(tests)}) AS passed
  FROM q_counts)"""


def _normal(text: str) -> str:
    """Words of a normalised text; ASCII characters but letters, digits and line ends are spaces."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_replace({low}, '[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]', ' ', 'g')"


def _licence_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES))
    words = lambda text: f"list_filter(string_split({text}, ' '), lambda x: x <> '')"
    bigrams = "SELECT {0}, {1} AS n, w[i] || ' ' || w[i + 1] AS g, count(*) AS c FROM (SELECT *, unnest(range(1, len(w))) AS i FROM {2}) GROUP BY {0}, {1}, w[i], w[i + 1]"
    return f"""WITH l_rows AS (SELECT row_number() OVER () AS rid, doc_id, {_normal("coalesce(text, '')")} AS t FROM documents),
l_lines AS (SELECT rid, i, {words('x')} AS w FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM l_rows)),
l_full AS (SELECT rid, i, w, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS p FROM l_lines WHERE len(w) > 0),
l_parts AS (
  SELECT rid, 'l' || i AS part, w FROM l_full
  UNION ALL SELECT rid, 'p' || p, flatten(list(w ORDER BY i)) FROM l_full GROUP BY rid, p
  UNION ALL SELECT rid, 'w', flatten(list(w ORDER BY i)) FROM l_full GROUP BY rid),
l_templates AS (SELECT k, name, {words(_normal("t"))} AS w FROM (VALUES {rows}) AS v(k, name, t)),
l_some AS (SELECT * FROM l_parts WHERE len(w) BETWEEN 2 AND 400),
l_part_grams AS ({bigrams.format("rid, part", "len(w) - 1", "l_some")}),
l_template_grams AS ({bigrams.format("k, name", "len(w) - 1", "l_templates")}),
l_dice AS (SELECT a.rid, b.name, 2 * sum(least(a.c, b.c)) / (a.n + b.n) AS dice FROM l_part_grams a JOIN l_template_grams b USING (g) GROUP BY a.rid, a.part, b.k, b.name, a.n, b.n),
l_best AS (SELECT rid, name, max(dice) AS dice FROM l_dice WHERE dice >= 0.8 - 1e-12 GROUP BY rid, name),
l_first AS (SELECT rid, name, dice, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, name) AS r, string_agg(name, ',' ORDER BY name) OVER (PARTITION BY rid) AS licences FROM l_best)
SELECT d.doc_id, f.name AS licence, round(f.dice, 9) AS dice, coalesce(f.licences, '') AS licences FROM l_rows d LEFT JOIN (SELECT * FROM l_first WHERE r = 1) f USING (rid)"""


ORACLES = {
    "op10_quality_rules": f"""WITH {_quality_ctes()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND passed) AS kept FROM q_judged""",
    # no part of over 400 words can reach the threshold: the longest template has under 80
    "op9_licence_scan": _licence_sql(),
    "op12_source_divergence": divergence.SQL,
}
