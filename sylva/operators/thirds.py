"""Third relations: for a node under its parent, a third node that says more, found by a table of rules.

A rule (dep, parent, rel, term) holds for a node labelled dep under a parent labelled `parent`, if the node at relation rel is labelled term:
  1  for head words and tags: the grandparent, unless parent or grandparent have the node's own head word; else the parent
  2  the sibling next to it on the side of the head, unless that is the head
  3  next to the head: the outermost child of the head on that side (the next one if that is the head's own head)
  4  the parent, unless it has the node's own head word
The first rule in the table's order that holds names the third node. Relations are found where the trees are read, many at a time; the
rules, a table of a few hundred rows that doesn't grow with the data, are broadcast and joined on all four.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions.forest import Forest
from sylva.operators import treemodel
from sylva.operators.conditional import NO_WORD
from sylva.operators.forestfeatures import Grove
from sylva.sources.ptb import different, each_forest, forest_totals
from sylva.sources.shared import written

Rule = tuple[str, str, int, str]

# Rules whose third node gives its head word.
THIRDS: list[Rule] = [("NP", "PP", 1, "NP"), ("NP", "PP", 1, "VP"), ("NP", "VP", 2, "PRT"), ("PP", "VP", 2, "PRT"), ("PP", "VP", 2, "PP"), ("ADVP", "VP", 2, "PRT"), ("PP", "ADJP", 2, "PRT")]
# For a node and its parent the siblings (relation 2) by which the parent's head word is taken instead.
SIBLINGS: dict[tuple[str, str], str] = {
    ("DT", "NP"): "CC NNPS DT NNS VBN CD JJS JJ NNP NN JJR ADJP", ("JJ", "NP"): "PRP$ DT VBN NNS NN CD QP NNP JJ ADJP VBG", ("NN", "NP"): "RB VBN VB VBD CD VBG NN JJ NNS NNP",
    ("NNP", "NP"): "NNPS NNP PRN FW VBN VBG NNS CD CC DT ADJP JJ NN RB", ("NNPS", "NP"): "NNP NN CC NNPS JJ", ("NNS", "NP"): "NN CC NNS NNP",
    ("ADVP", "QP"): "DT", ("CC", "QP"): "DT # CD", ("CD", "QP"): "NNS CC CD IN TO", ("DT", "QP"): "RBR JJR CC VBN JJ CD", ("IN", "QP"): "JJS TO IN $ CD # PDT DT",
    ("JJ", "QP"): "IN RB CD TO", ("JJR", "QP"): "IN CC", ("JJS", "QP"): "IN DT", ("NN", "QP"): "CC TO", ("NNS", "QP"): "IN RB TO", ("PDT", "QP"): "DT",
    ("RB", "QP"): "RP IN JJ RB JJR TO CC DT # CD $", ("RBR", "QP"): "IN", ("RP", "QP"): "TO", ("SYM", "QP"): "CD", ("TO", "QP"): "# CD", ("VBN", "QP"): "$ CD",
}
SPECIAL: list[Rule] = [(dep, parent, 2, term) for (dep, parent), terms in SIBLINGS.items() for term in terms.split()]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """ord, dep, above, rel, term. A rule that stands twice counts once, at its first place."""
    rows = [(i, *r) for i, r in enumerate(dict.fromkeys(rules))]
    if bad := [r for r in rows if r[3] not in (1, 2, 3, 4)]:
        raise ValueError(f"no relation {bad[0][3]}")
    return spark.createDataFrame(rows, "ord int, dep string, above string, rel int, term string")


def relations(trees: DataFrame, heads_first: bool = True, key="sent_id", tree: str = "tree") -> DataFrame:
    """key, node, dep, above, above_word, rel, third: a row for each relation of a node that has a third node.

    heads_first: relation 1 as for head words and tags.
    """

    def run(texts):
        f, names, values, c, found = _thirds(texts, heads_first)
        rel, i = np.nonzero(found >= 0)
        node, third, up = c[i], found[rel, i], f.parent[c[i]]
        texts_ = pa.array(names, pa.string())
        text = lambda f_, at: texts_.take(pa.array(values[f_][at]))
        return f.row[f.tree[node]], [third - f.base[third], node - f.base[node], text("t", node), text("t", up), text("h", up), rel + 1, text("t", third), text("h", third)]

    return each_forest(trees, run, "third int, node int, dep string, above string, above_word string, rel int, term string, third_word string", key, tree)


def _thirds(texts: pa.Array, heads_first: bool):
    """The trees, texts, the functions of nodes as places among the texts, nodes under a parent, and by relation (a row each) their third nodes, -1 for none."""
    f = Forest.read(texts, simple=True)
    names, values, own, lex = treemodel._symbols(f)
    g = Grove(f)
    c = np.flatnonzero(f.parent >= 0)
    up = f.parent[c]
    over, head, rank = f.parent[up], own[up], g.rank[c]
    at, inner = g.rank[head] if len(c) else rank, np.append(own, -1)[head]
    other = lex[up] != lex[c]
    found = np.full((4, len(c)), -1, np.int64)
    found[0] = np.where(other & (over >= 0) & (np.append(lex, -1)[over] != lex[c]), over, -1) if heads_first else up
    found[1] = np.where(head < 0, -1, np.where(rank > at + 1, g.kid(up, rank - 1), np.where(rank < at - 1, g.kid(up, rank + 1), -1)))
    last = g.count[head] if len(c) else rank
    left, right = g.kid(head, np.zeros_like(rank)), g.kid(head, last - 1)
    left, right = np.where(left != inner, left, g.kid(head, np.ones_like(rank))), np.where(right != inner, right, g.kid(head, last - 2))
    found[2] = np.where((head < 0) | (inner < 0), -1, np.where(rank == at - 1, left, np.where(rank == at + 1, right, -1)))
    found[3] = np.where(other, up, -1)
    return f, names, values, c, found


def third_totals(trees: DataFrame, rules: list[Rule], tree: str = "tree") -> DataFrame:
    """dep, above, rel, term, word, n, thirds: nodes by the first rule that holds and the third node's head word, and the sum of the
    third nodes' numbers; found and counted where the trees are read."""
    first: dict[Rule, int] = {}
    for r in rules:
        first.setdefault(r, len(first))

    def draw(texts):
        f, names, values, c, found = _thirds(texts, True)
        rel, i = np.nonzero(found >= 0)
        third = found[rel, i]
        columns = [values["t"][c[i]], values["t"][f.parent[c[i]]], rel, values["t"][third]]
        some, place, _ = different([x.astype(np.int64) for x in columns])
        none = len(first)
        number = np.array([first.get((names[d], names[a], int(r) + 1, names[t]), none) for d, a, r, t in zip(*(x[some].tolist() for x in columns), strict=True)] or [none])
        rule = np.full(found.shape, none)
        rule[rel, i] = number[place]
        best = rule.argmin(axis=0)
        kept = np.flatnonzero(rule.min(axis=0) < none)
        third, node, texts_ = found[best[kept], kept], c[kept], pa.array(names, pa.string())
        groups = [(values["t"][node], texts_), (values["t"][f.parent[node]], texts_), (best[kept], pa.array([1, 2, 3, 4], pa.int32())), (values["t"][third], texts_), (values["h"][third], texts_)]
        return [(x.astype(np.int64), v) for x, v in groups], [third - f.base[third]]

    rule_table(trees.sparkSession, rules)  # refuses what isn't a rule
    return forest_totals(trees, draw, "dep string, above string, rel int, term string, word string", "thirds long", tree)


def thirds(found: DataFrame, rules: DataFrame, key="sent_id") -> DataFrame:
    """key, node, dep, above, ord, rel, third, term, third_word, above_word: each node's first rule that holds; others have no row."""
    keys = [key] if isinstance(key, str) else list(key)
    held = found.join(F.broadcast(rules), ["dep", "above", "rel", "term"])
    fields = ["ord", "rel", "third", "term", "third_word", "above_word", "dep", "above"]
    return held.groupBy(*keys, "node").agg(F.min(F.struct(*fields)).alias("m")).select(*keys, "node", *[F.col(f"m.{f}").alias(f) for f in fields])


def third_words(trees: DataFrame, language_model: bool = False, rules: list[Rule] | None = None, special: list[Rule] | None = None, key="sent_id", tree: str = "tree") -> DataFrame:
    """key, node, word of every node but the root: the third node's head word, ^^ without one.

    language_model: where a rule of `special` holds, it is the parent's head word.
    """
    keys = [key] if isinstance(key, str) else list(key)
    found = written(relations(trees, True, key, tree), "relations")
    spark = trees.sparkSession
    out = found.select(*keys, "node").distinct().join(thirds(found, rule_table(spark, THIRDS if rules is None else rules), key).select(*keys, "node", F.col("third_word").alias("word")), [*keys, "node"], "left")
    if language_model:
        own = thirds(found, rule_table(spark, SPECIAL if special is None else special), key).select(*keys, "node", F.col("above_word").alias("_own"))
        out = out.join(own, [*keys, "node"], "left").withColumn("word", F.coalesce("_own", "word")).drop("_own")
    return out.withColumn("word", F.coalesce("word", F.lit(NO_WORD)))
