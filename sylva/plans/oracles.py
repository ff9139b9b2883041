"""DuckDB SQL for the catalog's queries, over the same treebank."""

from __future__ import annotations

from sylva.functions.text import BUCKETS
from sylva.plans.nested import nodes_sql
from sylva.plans.treebank import ORACLE


def with_treebank(body: str, *ctes: str) -> str:
    """A query over the treebank's common table expressions and more of them."""
    return "WITH RECURSIVE " + ",\n".join([ORACLE.strip(), *ctes]) + "\n" + body


#: Pre-order node table of the gold trees, straight from the chunks.
_NODES = """
chunk_nodes AS (
  SELECT sent_id, n, c, start, finish, label, CAST(2 + c + start AS INT) AS node FROM chunks WHERE k = -1),
nodes AS (
  SELECT sent_id, 0 AS node, CAST(NULL AS INT) AS parent, 0 AS depth, 0 AS start, n AS finish, 'S1' AS label, CAST(NULL AS VARCHAR) AS word FROM sized
  UNION ALL SELECT sent_id, 1, 0, 1, 0, n, 'S', NULL FROM sized
  UNION ALL SELECT sent_id, node, 1, 2, start, finish, label, NULL FROM chunk_nodes
  UNION ALL SELECT t.sent_id, node + 1 + pos - start, node, 3, pos, pos + 1, tag, form FROM chunk_nodes x JOIN tokens t ON t.sent_id = x.sent_id AND pos >= start AND pos < finish)"""

MATCH_SQL = """
gold AS (SELECT g.sent_id, t.k, g.start, g.finish, g.label FROM chunks g, (VALUES (0), (1), (2)) AS t(k) WHERE g.k = -1),
test AS (SELECT sent_id, k, start, finish, label FROM chunks WHERE k >= 0),
bag AS (SELECT sent_id, k, start, finish, label, sum(g) AS g, sum(t) AS t
        FROM (SELECT *, 1 AS g, 0 AS t FROM gold UNION ALL SELECT *, 0, 1 FROM test) GROUP BY ALL),
matched AS (SELECT sent_id, k, CAST(sum(g) AS BIGINT) AS n_gold, CAST(sum(t) AS BIGINT) AS n_test, CAST(sum(least(g, t)) AS BIGINT) AS n_matched FROM bag GROUP BY ALL)"""


def _ratios(name: str) -> str:
    return f"""SELECT *, CASE WHEN n_test > 0 THEN round(n_matched / n_test, 6) ELSE 0 END AS precision,
CASE WHEN n_gold > 0 THEN round(n_matched / n_gold, 6) ELSE 0 END AS recall,
CASE WHEN n_gold + n_test > 0 THEN round(2 * n_matched / (n_gold + n_test), 6) ELSE 0 END AS fscore FROM {name}"""


SCORED_SQL = [MATCH_SQL, f"rated AS ({_ratios('matched')})", "scored AS (SELECT n.sent_id, n.n, n.k, n.logprob, r.n_gold, r.n_test, r.n_matched, r.fscore FROM nbest n JOIN rated r USING (sent_id, k))"]

_TAGGED = """
tagged AS (SELECT x.sent_id, x.n, x.k, x.c, x.start, x.finish, x.label, t.pos, t.tag, t.form
  FROM chunks x JOIN tokens t ON t.sent_id = x.sent_id AND pos >= start AND pos < finish WHERE x.k >= 0)"""

_Q = "CASE WHEN {0} <= 2 THEN {0} WHEN {0} <= 4 THEN 4 ELSE 5 END"
HEAVY_SQL = f"""
heavy_values AS (SELECT sent_id, k, 'Heavy' AS cls, feat, CAST(count(*) AS DOUBLE) AS val
  FROM (SELECT sent_id, k, concat_ws(' ', CAST({_Q.format('(finish - start)')} AS VARCHAR), CAST({_Q.format('(n - finish)')} AS VARCHAR), label) AS feat FROM chunks WHERE k >= 0) GROUP BY ALL)"""
_NGRAM = """
ngram_values AS (SELECT sent_id, k, 'NGram:2' AS cls, feat, CAST(count(*) AS DOUBLE) AS val FROM (
  SELECT sent_id, k, coalesce(lag(label) OVER w, '_') || ' ' || label AS feat FROM chunks WHERE k >= 0 WINDOW w AS (PARTITION BY sent_id, k ORDER BY c)
  UNION ALL SELECT sent_id, k, label || ' _' FROM chunks WHERE k >= 0 AND finish = n) GROUP BY ALL)"""
_RIGHT = """
right_values AS (SELECT sent_id, k, CASE WHEN finish = n THEN '1' ELSE '0' END AS feat, CAST(count(*) AS DOUBLE) AS val FROM chunks WHERE k >= 0 GROUP BY ALL)"""


def _totals(source: str) -> str:
    """source: rows (sent_id, k, cls, feat), one for each occurrence."""
    return f"SELECT cls, feat, count(*) AS parses, CAST(sum(val) AS DOUBLE) AS total FROM (SELECT sent_id, k, cls, feat, count(*) AS val FROM ({source}) WHERE feat IS NOT NULL GROUP BY ALL) GROUP BY ALL"


def _vary(values: str) -> str:
    return f"(SELECT v.sent_id, cls, feat, (count(*) = any_value(s.n) AND min(val) = max(val)) AS constant FROM {values} v JOIN (SELECT sent_id, count(*) AS n FROM nbest GROUP BY ALL) s USING (sent_id) GROUP BY v.sent_id, cls, feat)"


RANKER_SQL = [*SCORED_SQL, """
ranker AS (SELECT sent_id, k, n_gold, n_test, n_matched, fscore, logprob / 10 AS score,
  max(fscore) OVER (PARTITION BY sent_id) AS top FROM scored),
won AS (SELECT *, (CASE WHEN fscore = top THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN fscore = top THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY sent_id) AS p_gold,
  ln(sum(exp(score)) OVER (PARTITION BY sent_id)) AS log_z FROM ranker WHERE top > 0),
margins AS (SELECT best - score AS margin FROM (SELECT *, max(CASE WHEN p_gold > 0 THEN score END) OVER (PARTITION BY sent_id) AS best FROM won) WHERE p_gold = 0)"""]
# exp() of whole-sentence scores would underflow for very long lines: shift by the maximum
RANKER_SQL[-1] = RANKER_SQL[-1].replace("ln(sum(exp(score)) OVER (PARTITION BY sent_id)) AS log_z FROM ranker", "shift + ln(sum(exp(score - shift)) OVER (PARTITION BY sent_id)) AS log_z FROM (SELECT *, max(score) OVER (PARTITION BY sent_id) AS shift FROM ranker)")

_bucket = " + ".join(f"(CASE WHEN n > {b} THEN 1 ELSE 0 END)" for b in BUCKETS)

EVENTS_SQL = """
events AS (SELECT tag AS y, coalesce(lag(tag) OVER w, 'STOP') AS c1, coalesce(lag(tag, 2) OVER w, 'STOP') AS c2 FROM tokens WINDOW w AS (PARTITION BY sent_id ORDER BY pos))"""

_DISCOUNT = """
g3 AS (SELECT c2, c1, y, count(*) AS c FROM events GROUP BY ALL),
g2 AS (SELECT c1, y, count(*) AS c FROM g3 GROUP BY ALL),
g1 AS (SELECT y, count(*) AS c FROM g2 GROUP BY ALL),
every AS (SELECT 3 AS order_n, c FROM g3 UNION ALL SELECT 2, c FROM g2 UNION ALL SELECT 1, c FROM g1),
ns AS (SELECT order_n, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM every GROUP BY ALL)"""

ORACLES = {
    "sgml_sentences": with_treebank("SELECT sent_id, length(sentence) AS n_chars FROM sentences"),
    "tokens_fast": with_treebank("SELECT form, count(*) AS n, min(pos) AS first_pos FROM tokens GROUP BY form"),
    "escape_brackets": with_treebank("SELECT sent_id, length(replace(replace(replace(replace(replace(replace(sentence, '(', '-LRB-'), ')', '-RRB-'), '[', '-LSB-'), ']', '-RSB-'), '{', '-LCB-'), '}', '-RCB-')) AS n_escaped, true AS same FROM sentences"),
    "token_classes": with_treebank("""SELECT CASE WHEN length(form) < 2 THEN 0 WHEN form = upper(form) AND form <> lower(form) THEN 2 WHEN form[1] <> lower(form[1]) THEN 1 ELSE 0 END AS capital,
contains(form, '-') AS hyphen, CASE WHEN length(form) >= 3 THEN right(lower(form), 2) ELSE '' END AS ending, count(*) AS n FROM tokens GROUP BY ALL"""),
    "quantized_lengths": with_treebank(f"SELECT CAST(CASE WHEN n <= 2 THEN n WHEN n <= 4 THEN 4 ELSE 5 END AS INT) AS class, CAST({_bucket} AS INT) AS bucket, count(*) AS sentences FROM sized GROUP BY ALL"),
    "tree_write": with_treebank("SELECT sent_id, tree FROM trees"),
    "tree_nodes": with_treebank("SELECT label, depth, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(finish) AS BIGINT) AS finishes, count(word) AS words, CAST(sum(parent) AS BIGINT) AS parents FROM nodes GROUP BY ALL", _NODES),
    "tree_round_trip": with_treebank("SELECT true AS same, count(*) AS n FROM sized"),
    "tree_tokens_tags": with_treebank("SELECT sent_id, string_agg(form, ' ' ORDER BY pos) AS forms, string_agg(tag, ' ' ORDER BY pos) AS tags FROM tokens GROUP BY sent_id"),
    "subtree_sizes": with_treebank("""SELECT label, count(*) AS n, CAST(sum(size) AS BIGINT) AS subtree_nodes FROM (
SELECT s.sent_id, 'S1' AS label, 2 + s.n + (SELECT count(*) FROM chunks c WHERE c.sent_id = s.sent_id AND c.k = -1) AS size FROM sized s
UNION ALL SELECT s.sent_id, 'S', 1 + s.n + (SELECT count(*) FROM chunks c WHERE c.sent_id = s.sent_id AND c.k = -1) FROM sized s
UNION ALL SELECT sent_id, label, 1 + finish - start FROM chunks WHERE k = -1 UNION ALL SELECT sent_id, tag, 1 FROM tokens) GROUP BY label"""),
    "parseval_sentence": with_treebank(_ratios("matched"), MATCH_SQL),
    "parseval_corpus": with_treebank(_ratios("(SELECT k, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_test) AS BIGINT) AS n_test, CAST(sum(n_matched) AS BIGINT) AS n_matched FROM matched GROUP BY k)"), MATCH_SQL),
    "exact_match": with_treebank("SELECT k, count(*) AS n, count(*) FILTER (n_gold = n_matched AND n_test = n_matched) AS exact FROM matched GROUP BY k", MATCH_SQL),
    "tree_diff": with_treebank("SELECT label, CASE WHEN g > t THEN '-' WHEN g < t THEN '+' ELSE ' ' END AS side, count(*) AS n FROM bag WHERE k = 0 GROUP BY ALL", MATCH_SQL),
    "crossing_spans": with_treebank("""SELECT t.label, count(*) AS n_crossing, count(DISTINCT t.sent_id) AS n_sentences FROM chunks t JOIN chunks g ON g.sent_id = t.sent_id AND g.k = -1 AND t.k = 0
WHERE (g.start < t.start AND t.start < g.finish AND g.finish < t.finish) OR (t.start < g.start AND g.start < t.finish AND t.finish < g.finish) GROUP BY t.label"""),
    "constraint_matches": with_treebank("""SELECT k, count(*) AS n, count(*) FILTER (held = needed) AS satisfied FROM (
SELECT g.sent_id, g.k, count(*) AS needed, count(t.sent_id) AS held FROM gold g LEFT JOIN test t USING (sent_id, k, start, finish, label) WHERE g.finish - g.start = 2 GROUP BY g.sent_id, g.k) GROUP BY k""", MATCH_SQL),
    "unique_trees": with_treebank("""SELECT k, count(*) AS n FROM (SELECT sent_id, shape, min(k) AS k FROM (
SELECT sent_id, k, string_agg(start || ':' || finish || ':' || label, ' ' ORDER BY start) AS shape FROM chunks WHERE k >= 0 GROUP BY ALL) GROUP BY ALL) GROUP BY k"""),
    "nbest_softmax": with_treebank("""SELECT sent_id, k, round(e / sum(e) OVER (PARTITION BY sent_id), 6) AS p, round(logprob - (top + ln(sum(e) OVER (PARTITION BY sent_id))), 6) + 0.0 AS lcp
FROM (SELECT *, exp(logprob - top) AS e FROM (SELECT *, max(logprob) OVER (PARTITION BY sent_id) AS top FROM nbest))"""),
    "nbest_topk": with_treebank("SELECT sent_id, k, CAST(r AS INT) AS rank, logprob FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY logprob DESC, k) - 1 AS r FROM nbest) WHERE r < 2"),
    "sparse_score": with_treebank("SELECT sent_id, k, round(sum(val * ((length(feat) % 7 - 3) / 8.0)), 6) AS score FROM heavy_values GROUP BY ALL", HEAVY_SQL),
    "rerank": with_treebank("""SELECT sent_id, k, round(s, 6) AS reranker_score, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY logprob DESC, k) - 1 AS INT) AS parser_rank,
CAST(row_number() OVER (PARTITION BY sent_id ORDER BY s DESC, logprob DESC, k) - 1 AS INT) AS reranker_rank
FROM nbest JOIN (SELECT sent_id, k, sum(val * ((length(feat) % 7 - 3) / 8.0)) AS s FROM heavy_values GROUP BY ALL) USING (sent_id, k)""", HEAVY_SQL),
    "oracle_f": with_treebank("""SELECT sent_id, max(CASE WHEN a = 1 THEN fscore END) AS first_f, max(fscore) AS best_f, CAST(max(CASE WHEN b = 1 THEN k END) AS INT) AS best_k FROM (
SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY logprob DESC, k) AS a, row_number() OVER (PARTITION BY sent_id ORDER BY fscore DESC, k) AS b FROM scored) GROUP BY sent_id""", *SCORED_SQL),
    "beam_curve": with_treebank("""SELECT CAST(beam AS INT) AS beam, count(*) AS n, round(avg(best), 6) AS mean_f FROM (
SELECT beam, max(fscore) OVER (PARTITION BY sent_id ORDER BY beam) AS best FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY logprob DESC, k) AS beam FROM scored)) GROUP BY beam""", *SCORED_SQL),
    "fuse_spans": with_treebank("""SELECT label, count(*) AS n, round(sum(round(score, 6)), 3) AS score FROM (
SELECT *, row_number() OVER (PARTITION BY sent_id, start, finish ORDER BY round(score, 9) DESC, label) AS b FROM (
SELECT sent_id, start, finish, label, sum(p) AS score FROM chunks JOIN probs USING (sent_id, k) GROUP BY ALL)) WHERE b = 1 AND round(score, 9) >= 0.5 GROUP BY label""",
        "probs AS (SELECT sent_id, k, e / sum(e) OVER (PARTITION BY sent_id) AS p FROM (SELECT *, exp(logprob - max(logprob) OVER (PARTITION BY sent_id)) AS e FROM nbest))"),
    "pos_lexicon": with_treebank("SELECT word, tag, cnt, round(cnt / sum(cnt) OVER (PARTITION BY tag), 9) AS p FROM (SELECT lower(form) AS word, tag, count(*) AS cnt FROM tokens GROUP BY ALL)"),
    "unknown_tag_stats": with_treebank("""SELECT tag, n, CASE WHEN n > 0 THEN round(u / n, 9) ELSE 0 END AS p_unknown, CASE WHEN o > 0 THEN round(cap / o, 9) ELSE 0 END AS p_capital, CASE WHEN u > 0 THEN round(h / u, 9) ELSE 0 END AS p_hyphen FROM (
SELECT tag, count(*) AS n, count(*) FILTER (seen <= 2) AS u, count(*) FILTER (pos >= 2 AND length(form) > 1) AS o, count(*) FILTER (pos >= 2 AND length(form) > 1 AND form <> lower(form)) AS cap, count(*) FILTER (seen <= 2 AND contains(form, '-')) AS h
FROM (SELECT *, count(*) OVER (PARTITION BY lower(form)) AS seen FROM tokens) GROUP BY tag)"""),
    "ending_probs": with_treebank("""SELECT tag, ending, cnt, round(cnt / sum(cnt) OVER (PARTITION BY tag), 9) AS p FROM (
SELECT tag, right(lower(form), 2) AS ending, count(*) AS cnt FROM (SELECT *, count(*) OVER (PARTITION BY lower(form)) AS seen FROM tokens WHERE tag IN ('NN', 'NNS', 'VB', 'JJ') AND length(form) >= 3) WHERE seen <= 4 GROUP BY ALL)"""),
    "context_counts": with_treebank("""SELECT 1 AS level, c1, '' AS c2, y, count(*) AS cnt, CAST(sum(count(*)) OVER (PARTITION BY c1) AS BIGINT) AS tot, round(count(*) / sum(count(*)) OVER (PARTITION BY c1), 9) AS g FROM events GROUP BY c1, y
UNION ALL SELECT 2, c1, c2, y, count(*), CAST(sum(count(*)) OVER (PARTITION BY c1, c2) AS BIGINT), round(count(*) / sum(count(*)) OVER (PARTITION BY c1, c2), 9) FROM events GROUP BY c1, c2, y""", EVENTS_SQL),
    "kn_discounts": with_treebank("""SELECT order_n, n1, n2, n3, n4, round(y, 6) AS y, round(1 - 2 * y * n2 / nullif(n1, 0), 6) AS d1, round(2 - 3 * y * n3 / nullif(n2, 0), 6) AS d2, round(3 - 4 * y * n4 / nullif(n3, 0), 6) AS d3
FROM (SELECT *, n1 / nullif(n1 + 2 * n2, 0) AS y FROM ns)""", EVENTS_SQL, _DISCOUNT),
    "feat_word": with_treebank(_totals("SELECT sent_id, k, 'Word:1' AS cls, form || ' ' || label AS feat FROM tagged"), _TAGGED),
    "feat_rule": with_treebank(_totals("SELECT sent_id, k, 'Rule:0:0' AS cls, string_agg(tag, ' ' ORDER BY pos) || ' _ ' || label AS feat FROM tagged GROUP BY sent_id, k, c, label"), _TAGGED),
    "feat_edges": with_treebank(_totals("SELECT sent_id, k, 'Edges:0:1:0:1' AS cls, concat_ws(' ', CAST(least(finish - start, 5) AS VARCHAR), label, min_by(tag, pos), max_by(tag, pos)) AS feat FROM tagged GROUP BY sent_id, k, c, start, finish, label"), _TAGGED),
    "feat_ngram": with_treebank("SELECT cls, feat, count(*) AS parses, sum(val) AS total FROM ngram_values GROUP BY ALL", _NGRAM),
    "feat_heavy": with_treebank("SELECT cls, feat, count(*) AS parses, sum(val) AS total FROM heavy_values GROUP BY ALL", HEAVY_SQL),
    "feat_rightbranch": with_treebank("SELECT 'RightBranch' AS cls, feat, count(*) AS parses, sum(val) AS total FROM right_values GROUP BY ALL", _RIGHT),
    "feat_colenpar": with_treebank(_totals("""SELECT sent_id, k, 'CoLenPar' AS cls, CASE WHEN label = before THEN CAST(greatest(-5, least(5, size - size_before)) AS VARCHAR) || ' ' || CAST(CAST(finish = n AS INT) AS VARCHAR) END AS feat FROM (
SELECT *, finish - start AS size, lag(label) OVER w AS before, lag(finish - start) OVER w AS size_before FROM chunks WHERE k = -1 WINDOW w AS (PARTITION BY sent_id, k ORDER BY c))""")),
    "pseudo_constant": with_treebank(f"SELECT feat, count(*) AS n, count(*) FILTER (constant) AS n_constant FROM {_vary('heavy_values')} GROUP BY feat", HEAVY_SQL),
    "mincount_dictionary": with_treebank(f"""SELECT row_number() OVER (ORDER BY cls, feat) - 1 AS fid, cls, feat, sentences FROM (
SELECT cls, feat, count(*) AS sentences FROM (SELECT * FROM {_vary('heavy_values')} UNION ALL SELECT * FROM {_vary('ngram_values')}) WHERE NOT constant GROUP BY ALL HAVING count(*) >= 5)""", HEAVY_SQL, _NGRAM),
    "baseline_shift": with_treebank("""SELECT feat, base, count(*) AS n FROM (
SELECT sent_id, feat, v AS base, row_number() OVER (PARTITION BY sent_id, feat ORDER BY g DESC, v) AS r FROM (
SELECT sent_id, feat, v, sum(g) AS g FROM (SELECT sent_id, feat, val AS v, 2 AS g FROM full_values UNION ALL SELECT sent_id, feat, val - 1, 1 FROM full_values) GROUP BY ALL)) WHERE r = 1 GROUP BY ALL""", _RIGHT,
        "full_values AS (SELECT f.sent_id, f.feat, coalesce(v.val, 0) AS val FROM (SELECT DISTINCT sent_id, feat FROM right_values) f JOIN nbest n ON n.sent_id = f.sent_id LEFT JOIN right_values v ON v.sent_id = f.sent_id AND v.feat = f.feat AND v.k = n.k)"),
    "winners_losers": with_treebank("SELECT sent_id, k, round(p_gold, 6) AS p_gold FROM won", *RANKER_SQL),
    "logloss": with_treebank("""SELECT (SELECT round(sum(-p_gold * (score - log_z)), 3) FROM won) AS log_loss,
(SELECT round(sum(l), 3) FROM (SELECT -ln(sum(exp(score - log_z))) AS l FROM won WHERE p_gold > 0 GROUP BY sent_id)) AS em_loss""", *RANKER_SQL),
    "logloss_grad": with_treebank("SELECT feat, round(sum((exp(score - log_z) - p_gold) * val), 3) + 0.0 AS grad FROM heavy_values JOIN won USING (sent_id, k) GROUP BY feat", HEAVY_SQL, *RANKER_SQL),
    "pairwise_loss": with_treebank("SELECT round(sum(ln(1 + exp(-margin))), 3) AS pairwise, round(sum(exp(-margin)), 3) AS exponential, round(ln(sum(exp(-margin))), 6) AS log_exponential FROM margins", *RANKER_SQL),
    "expected_f": with_treebank("""SELECT round(2 * sum(p * n_matched) / sum(p * (n_test + n_gold)), 6) AS f FROM (
SELECT *, e / sum(e) OVER (PARTITION BY sent_id) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY sent_id)) AS e FROM ranker))""", *RANKER_SQL),
    "independent_tags": with_treebank("SELECT word, tag, cnt FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, tag DESC) AS r FROM (SELECT lower(form) AS word, tag, count(*) AS cnt FROM tokens GROUP BY ALL)) WHERE r = 1"),
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "class_ablation": with_treebank("""SELECT cls, n_features, round(2 * sum(n_matched) / sum(n_gold + n_test), 6) AS fscore FROM (
SELECT *, row_number() OVER (PARTITION BY sent_id, cls ORDER BY score DESC, logprob DESC, k) AS r FROM (
SELECT s.*, x.cls, x.n_features, round(coalesce((SELECT sum(part) FROM parts p WHERE p.sent_id = s.sent_id AND p.k = s.k AND p.cls <> x.cls), 0), 9) AS score
FROM scored s, (SELECT cls, count(DISTINCT feat) AS n_features FROM both_values GROUP BY cls UNION ALL SELECT '', count(*) FROM (SELECT DISTINCT cls, feat FROM both_values)) x)) WHERE r = 1 GROUP BY ALL""", *SCORED_SQL, HEAVY_SQL, _RIGHT,
        "both_values AS (SELECT sent_id, k, cls, feat, val FROM heavy_values UNION ALL SELECT sent_id, k, 'RightBranch', feat, val FROM right_values)",
        "parts AS (SELECT sent_id, k, cls, sum(val * ((length(feat) % 7 - 3) / 8.0)) AS part FROM both_values GROUP BY ALL)"),
    "beam_thresholds": with_treebank("""SELECT CAST(s AS INT) AS step, (SELECT count(*) FROM gaps WHERE gap <= s) AS parses FROM range(0, 21) AS r(s)""",
        "gaps AS (SELECT ceil(round((max(logprob) OVER (PARTITION BY sent_id) - logprob) / 0.25, 6)) AS gap FROM nbest)"),
    "score_histogram": with_treebank("SELECT CAST(least(floor(fscore * 20), 20) + 1 AS BIGINT) AS bin, count(*) AS n FROM scored GROUP BY ALL", *SCORED_SQL),
    "distinguishing_features": with_treebank("""SELECT feat, count(*) AS n FROM (SELECT sent_id, feat FROM (
SELECT f.sent_id, f.feat, list_sort(list_distinct(list(coalesce(v.val, 0)) FILTER (w.p_gold > 0))) AS a, list_sort(list_distinct(list(coalesce(v.val, 0)) FILTER (w.p_gold = 0))) AS b
FROM (SELECT DISTINCT sent_id, feat FROM heavy_values) f JOIN won w ON w.sent_id = f.sent_id LEFT JOIN heavy_values v ON v.sent_id = f.sent_id AND v.k = w.k AND v.feat = f.feat GROUP BY f.sent_id, f.feat) WHERE b IS NOT NULL AND a <> b) GROUP BY feat""", HEAVY_SQL, *RANKER_SQL),
    "child_bigrams": with_treebank("""SELECT parent, a, b, count(*) AS cnt FROM (
SELECT above AS parent, coalesce(lag(label) OVER w, '^') AS a, label AS b FROM kids WINDOW w AS (PARTITION BY sent_id, up ORDER BY node)
UNION ALL SELECT above, max_by(label, node), '$' FROM kids GROUP BY sent_id, up, above) GROUP BY ALL""", _NODES,
        "kids AS (SELECT c.sent_id, c.parent AS up, c.node, c.label, p.label AS above FROM nodes c JOIN nodes p ON p.sent_id = c.sent_id AND p.node = c.parent)"),
    "lambda_em_pass": with_treebank("""SELECT bucket, CAST(sum(n) AS BIGINT) AS n, round(sum(n * lam1 * gh / (lam1 * gh + (1 - lam1) * gl)) / sum(n), 6) AS lam
FROM pairs JOIN (SELECT bucket, sum(n * 0.5 * gh / (0.5 * gh + 0.5 * gl)) / sum(n) AS lam1 FROM pairs GROUP BY bucket) USING (bucket) GROUP BY bucket""", EVENTS_SQL,
        "e1 AS (SELECT c1, y, round(count(*) / sum(count(*)) OVER (PARTITION BY c1), 9) AS gl FROM events GROUP BY c1, y)",
        "e2 AS (SELECT c1, c2, y, count(*) AS n, sum(count(*)) OVER (PARTITION BY c1, c2) AS tot, round(count(*) / sum(count(*)) OVER (PARTITION BY c1, c2), 9) AS gh FROM events GROUP BY c1, c2, y)",
        "pairs AS (SELECT CAST(" + _bucket.replace("n >", "tot / 10 >") + " AS INT) AS bucket, n, CAST(gh AS DOUBLE) AS gh, CAST(gl AS DOUBLE) AS gl FROM e2 JOIN e1 USING (c1, y))"),
}


# --- fusion

#: A second score of each candidate, in the place of a reranker's.
SECOND_SCORE = "round((n % 5) * (k - 1) * CAST(0.3 AS DOUBLE) + CASE WHEN k = 1 THEN (sent_id % 4) - CAST(1.5 AS DOUBLE) ELSE 0 END, 6)"


def _softmax(score: str) -> str:
    return f"(SELECT sent_id, k, e / sum(e) OVER (PARTITION BY sent_id) AS p FROM (SELECT sent_id, k, exp({score} - max({score}) OVER (PARTITION BY sent_id)) AS e FROM nbest))"


#: Fused trees from piece(sent_id, k, node, start, finish, label, word) and probs(sent_id, set, k, p). Spans that reach one half
#: don't cross, so the tree is all of them: brackets open before a word, the widest first, and close after it.
FUSED_SQL = """
unary AS (SELECT sent_id, k, start, finish, string_agg(label, '+' ORDER BY node) AS chain, CAST(NULL AS VARCHAR) AS word FROM piece WHERE word IS NULL AND finish > start GROUP BY ALL
  UNION ALL SELECT sent_id, k, start, finish, label, word FROM piece WHERE word IS NOT NULL AND finish > start),
weighted AS (SELECT sent_id, set, start, finish, chain, word, sum(p) AS score FROM unary JOIN probs USING (sent_id, k) GROUP BY ALL),
kept AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, set, start, finish, word IS NULL ORDER BY round(score, 9) DESC, chain) AS b FROM weighted)
  WHERE b = 1 AND (word IS NOT NULL OR round(score, 9) >= 0.5)),
opens AS (SELECT sent_id, set, start AS pos, string_agg('(' || replace(chain, '+', ' (') || ' ', '' ORDER BY finish DESC) AS o FROM kept WHERE word IS NULL GROUP BY ALL),
closes AS (SELECT sent_id, set, finish - 1 AS pos, sum(len(chain) - len(replace(chain, '+', '')) + 1) AS c FROM kept WHERE word IS NULL GROUP BY ALL),
built AS (SELECT w.sent_id, w.set, max(finish) AS n, string_agg(coalesce(o, '') || '(' || chain || ' ' || word || ')' || repeat(')', CAST(coalesce(c, 0) AS INT)), ' ' ORDER BY start) AS tree
  FROM kept w LEFT JOIN opens o ON o.sent_id = w.sent_id AND o.set = w.set AND o.pos = w.start LEFT JOIN closes c ON c.sent_id = w.sent_id AND c.set = w.set AND c.pos = w.start
  WHERE word IS NOT NULL GROUP BY ALL),
fused AS (SELECT b.sent_id, b.set, t.chain AS root, CASE WHEN t.chain IS NOT NULL THEN b.tree END AS tree
  FROM built b LEFT JOIN kept t ON t.sent_id = b.sent_id AND t.set = b.set AND t.start = 0 AND t.finish = b.n AND t.word IS NULL)"""

ORACLES["fuse_trees"] = with_treebank(
    "SELECT '(S1 ' || f.tree || ')' = g.tree AS is_gold, f.tree IS NULL AS none, count(*) AS n FROM fused f JOIN trees g USING (sent_id) GROUP BY ALL",
    """piece AS (SELECT sent_id, k, 0 AS node, 0 AS start, n AS finish, 'S' AS label, CAST(NULL AS VARCHAR) AS word FROM nbest
  UNION ALL SELECT sent_id, k, 1, start, finish, label, NULL FROM chunks WHERE k >= 0
  UNION ALL SELECT sent_id, k, 2, pos, pos + 1, tag, form FROM tokens, (VALUES (0), (1), (2)) AS g(k))""",
    f"probs AS (SELECT *, '' AS set FROM {_softmax('logprob')})", FUSED_SQL)

ORACLES["fuse_score_sets"] = with_treebank(
    "SELECT sent_id, set, md5(CASE WHEN fine THEN f ELSE t END) AS tree, fine AS fused FROM (SELECT f.sent_id, set, f.tree AS f, t.tree AS t, coalesce(starts_with(root || '+', 'S1+'), false) AS fine FROM fused f JOIN ntrees t ON t.sent_id = f.sent_id AND t.k = 0)",
    *nodes_sql("k >= 0"), "piece AS (SELECT * FROM nn)",
    f"second AS (SELECT sent_id, n, k, {SECOND_SCORE} AS score FROM nbest)",
    f"probs AS (SELECT sent_id, 'parser' AS set, k, p FROM {_softmax('logprob')} UNION ALL SELECT sent_id, 'second', k, p FROM {_softmax('score * 1.2::DOUBLE').replace('FROM nbest', 'FROM second')}"
    f" UNION ALL SELECT sent_id, 'mixed', k, (a.p + 3 * b.p) / 4 FROM {_softmax('logprob')} a JOIN {_softmax('score * 1.2::DOUBLE').replace('FROM nbest', 'FROM second')} b USING (sent_id, k))",
    FUSED_SQL)
