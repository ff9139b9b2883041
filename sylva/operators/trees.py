"""Operators on node tables and on labelled spans of trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.forest import Forest
from sylva.functions.rowtree import MOVED_OVER, SCORED_PUNCTUATION
from sylva.sources.ptb import different, each_forest, forest_totals


def tokens_and_tags(nodes: DataFrame, key: str = "sent_id") -> DataFrame:
    """key, forms, tags: the leaves from left to right."""
    leaves = nodes.where("word IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "word", "label"))).alias("leaves"))
    return leaves.select(key, F.array_join(F.transform("leaves", lambda x: x["word"]), " ").alias("forms"), F.array_join(F.transform("leaves", lambda x: x["label"]), " ").alias("tags"))


def last_descendants(nodes: DataFrame, key: str = "sent_id") -> DataFrame:
    """nodes with last_desc, the greatest node of each subtree: one less than the next node that is no deeper.

    On the way from the end, the next node of at most this depth is the least `node` among the levels up to it; as a
    subtree ends where its words end, the last node that starts before its finish says the same in one window.
    """
    spans = Window.partitionBy(key).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = nodes.groupBy(key, "start").agg(F.max("node").alias("_last")).withColumn("_last", F.max("_last").over(spans))
    ends = ends.select(key, (F.col("start") + 1).alias("finish"), "_last")
    return nodes.join(ends, [key, "finish"], "left").withColumn("last_desc", F.col("_last").cast("int")).drop("_last")


def row_last_descendants(trees: DataFrame, key="sent_id", tree: str = "tree") -> DataFrame:
    """key, node, label, last_desc, as last_descendants() has it, where the tree's row is: nothing moves."""

    def run(texts):
        f = Forest.read(texts)
        at = np.arange(len(f)) - f.base
        return f.row[f.tree], [at, f.label, f.last - f.base]

    return each_forest(trees, run, "node int, label string, last_desc int", key, tree)


def crossing(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Spans that overlap without one holding the other."""
    return ((a_start < b_start) & (b_start < a_end) & (a_end < b_end)) | ((b_start < a_start) & (a_start < b_end) & (b_end < a_end))


def crossing_pairs(test: DataFrame, gold: DataFrame, key: str = "sent_id") -> DataFrame:
    """test's columns and gold_start, gold_finish of each pair of spans that cross.

    A crossing gold span begins or ends strictly inside the test span, so the join is on (key, place inside): its rows
    grow with the widths of the spans, not with the pairs of a sentence.
    """
    places = test.where("finish - start > 1").withColumn("_at", F.explode(F.expr("sequence(start + 1, finish - 1)")))
    g = gold.select(key, F.col("start").alias("gold_start"), F.col("finish").alias("gold_finish"))
    begins = places.join(g.withColumn("_at", F.col("gold_start")), [key, "_at"]).where("gold_finish > finish")
    ends = places.join(g.withColumn("_at", F.col("gold_finish")), [key, "_at"]).where("gold_start < start")
    return begins.unionByName(ends).drop("_at")


def matched_spans(gold: DataFrame, test: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n_gold, n_test, n_matched: multiset intersection of labelled spans (start, finish, label) for each key."""
    bag = [*keys, "start", "finish", "label"]
    counts = gold.select(*bag, F.lit(1).alias("g"), F.lit(0).alias("t")).unionAll(test.select(*bag, F.lit(0), F.lit(1))).groupBy(*bag).agg(F.sum("g").alias("g"), F.sum("t").alias("t"))
    return counts.groupBy(*keys).agg(F.sum("g").alias("n_gold"), F.sum("t").alias("n_test"), F.sum(F.least("g", "t")).alias("n_matched"))


def common_spans(gold: Column, test: Column) -> list[Column]:
    """n_gold, n_test, n_matched of two arrays of one row, of spans as texts; a tree has each of its spans once."""
    sizes = (F.size(gold), F.size(test), F.size(F.array_intersect(gold, test)))
    return [c.cast("long").alias(n) for c, n in zip(sizes, ("n_gold", "n_test", "n_matched"), strict=True)]


def ratios(counts: DataFrame, digits: int = 6) -> DataFrame:
    """precision, recall, fscore (0 where a divisor is 0)."""
    over = lambda a, b: F.when(b > 0, F.round(a / b, digits)).otherwise(F.lit(0.0))
    g, t, m = F.col("n_gold"), F.col("n_test"), F.col("n_matched")
    return counts.withColumns({"precision": over(m, t), "recall": over(m, g), "fscore": over(2 * m, g + t)})


def span_diff(gold: DataFrame, test: DataFrame, key: str = "sent_id") -> DataFrame:
    """key, start, finish, label, side: '-' spans of gold alone, '+' of test alone, ' ' common ones."""
    both = gold.select(key, "start", "finish", "label", F.lit(1).alias("g"), F.lit(0).alias("t")).unionAll(test.select(key, "start", "finish", "label", F.lit(0), F.lit(1)))
    sides = both.groupBy(key, "start", "finish", "label").agg(F.max("g").alias("g"), F.max("t").alias("t"))
    return sides.select(key, "start", "finish", "label", F.when(F.col("g") > F.col("t"), "-").when(F.col("g") < F.col("t"), "+").otherwise(" ").alias("side"))


def row_heads(trees: DataFrame, rule: str = "first", key="sent_id", tree: str = "tree") -> DataFrame:
    """key, node, label, start, finish, head, lex, lex_start, lex_label, lex_word of each phrase, by a rule of sylva.functions.heads.

    head is the head child, lex the preterminal at the end of the chain of heads, however long; both null where there's none.
    """

    def run(texts):
        f = Forest.read(texts, normal=rule != "first", simple=True)
        own = f.heads(rule)
        x, k = f.lexical(own), np.flatnonzero(~f.leaf)
        lex, head = x[k], own[k]
        no = lex < 0
        return f.row[f.tree[k]], [k - f.base[k], f.labels_at(k), f.start[k], f.finish[k], pa.array(head - f.base[k], mask=head < 0), pa.array(lex - f.base[k], mask=no), pa.array(f.start[lex], mask=no), f.labels_at(lex), f.word.take(pa.array(lex, mask=no))]

    return each_forest(trees, run, "node int, label string, start int, finish int, head int, lex int, lex_start int, lex_label string, lex_word string", key, tree)


def dependencies(trees: DataFrame, rule: str = "first", key="sent_id", tree: str = "tree") -> DataFrame:
    """key, i, gov, dep, gov_word, dep_word: word places; a child whose head word isn't its parent's hangs on that. i counts from inner phrases out."""

    def run(texts):
        f, c, gov, dep = _dependent(texts, rule)
        if not len(c):
            return c, [c, c, c, f.word.take(pa.array(c)), f.word.take(pa.array(c))]
        order = np.lexsort((c, -f.parent[c], f.tree[c]))
        c, gov, dep = c[order], gov[order], dep[order]
        new = np.flatnonzero(np.append(True, f.tree[c][1:] != f.tree[c][:-1]))
        i = np.arange(len(c)) - np.repeat(new, np.diff(np.append(new, len(c))))
        return f.row[f.tree[c]], [i, f.start[gov], f.start[dep], f.word.take(pa.array(gov)), f.word.take(pa.array(dep))]

    return each_forest(trees, run, "i int, gov int, dep int, gov_word string, dep_word string", key, tree)


def _dependent(texts: pa.Array, rule: str) -> tuple[Forest, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes whose head word isn't their parent's, with the preterminals of the parent's and their own."""
    f = Forest.read(texts, normal=rule != "first", simple=True)
    lexical = f.lexical(f.heads(rule))
    c = np.flatnonzero(f.parent >= 0)
    gov, dep = lexical[f.parent[c]], lexical[c]
    kept = (gov >= 0) & (dep >= 0) & (gov != dep)
    return f, c[kept], gov[kept], dep[kept]


def dependency_distances(trees: DataFrame, rule: str = "first", tree: str = "tree") -> DataFrame:
    """distance, n: how often a dependent stands so many words after its governor; counted where the trees are read."""

    def draw(texts):
        f, _, gov, dep = _dependent(texts, rule)
        distance, place = np.unique(f.start[dep] - f.start[gov], return_inverse=True)
        return [(place, pa.array(distance, pa.int32()))], []

    return forest_totals(trees, draw, "distance int", tree=tree)


def head_totals(trees: DataFrame, rule: str, tree: str = "tree") -> DataFrame:
    """label, head, lex, n: phrases by label, their head child's label and their head word's tag, _ where there's none."""

    def draw(texts):
        f = Forest.read(texts, normal=rule != "first", simple=True)
        own = f.heads(rule)
        k = np.flatnonzero(~f.leaf)
        code, names = np.append(f.code, len(f.names)).astype(np.int64), pa.array([*f.names, "_"], pa.string())
        return [(code[x], names) for x in (k, own[k], f.lexical(own)[k])], []

    return forest_totals(trees, draw, "label string, head string, lex string", tree=tree)


def conll(trees: DataFrame, rule: str = "first", key="sent_id", tree: str = "tree") -> DataFrame:
    """key, id, form, tag, head: a row for each word, numbered from 1; head 0 is the root's word."""

    def run(texts):
        f = Forest.read(texts, normal=rule != "first", simple=True)
        lexical, over = f.lexical(f.heads(rule)), np.full(len(f) + 1, -1)
        up = np.where(f.parent >= 0, lexical[f.parent], -1)
        below = np.flatnonzero((lexical >= 0) & (up >= 0) & (lexical != up))
        over[lexical[below]] = up[below]
        k = np.flatnonzero(f.is_leaf)
        return f.row[f.tree[k]], [f.start[k] + 1, f.word.take(pa.array(k)), f.labels_at(k), np.where(over[k] >= 0, f.start[over[k]] + 1, 0)]

    return each_forest(trees, run, "id int, form string, tag string, head int", key, tree)


def _word_ends(f: Forest, labels) -> tuple[np.ndarray, np.ndarray]:
    """By node where its tree's words begin in a list of all words with a place before each tree's first; that list's marks of words with these labels."""
    leaves = np.flatnonzero(f.is_leaf)
    words = np.bincount(f.tree[leaves], minlength=len(f.row))
    at = np.cumsum(words + 1) - words - 1
    marks = np.zeros(int((words + 1).sum()), bool)
    marks[at[f.tree[leaves]] + f.finish[leaves]] = f.is_code(labels)[leaves]
    return at, marks


def _rebased(f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """By node its start and finish counted without punctuation."""
    at, marks = _word_ends(f, SCORED_PUNCTUATION)
    skipped, at = np.cumsum(marks), at[f.tree]
    return tuple(p - (skipped[at + p] - skipped[at]) for p in (f.start, f.finish))


def _moved(f: Forest, pair: np.ndarray, gold: Forest, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By node its start and finish moved over the punctuation of its pair's gold tree; own: the pairs' gold trees."""
    at, marks = _word_ends(gold, MOVED_OVER)
    to = np.maximum.accumulate(np.where(marks, 0, np.arange(len(marks))))
    sizes = np.diff(np.append(at, len(marks)))
    trees = own[pair] if len(own) else np.zeros(len(f), int)
    base, size = (at[trees], sizes[trees]) if len(at) else (trees, trees)
    move = lambda p: np.where(p < size, to[np.minimum(base + p, max(len(to) - 1, 0))] - base, p) if len(to) else p
    return move(f.start), move(f.finish)


def parseval(pairs: DataFrame, way: str = "rebased", key="sent_id", gold: str = "gold", test: str = "tree") -> DataFrame:
    """key, n_gold, n_test, n_matched, precision, recall, fscore of pairs of trees in one row.

    rebased: words are counted without punctuation and empties, the root and spans of no width left out; a gold tree
    without spans has recall 1. moved: ends of spans are moved over gold's punctuation; every phrase but S1 counts,
    and ratios without a divisor are 0. In both PRT is ADVP, and equal spans count as often as they occur on both sides.
    """
    if way not in ("rebased", "moved"):
        raise ValueError(f"unknown way {way}")

    def run(golds, tests):
        g, t = Forest.read(golds), Forest.read(tests)
        both, i, j = np.intersect1d(g.row, t.row, assume_unique=True, return_indices=True)
        names = {x: n for n, x in enumerate(dict.fromkeys([*g.names, *t.names]))}
        names["PRT"] = names.setdefault("ADVP", len(names))
        code = lambda f: np.array([names[x] for x in f.names] or [0], np.int64)[f.code]
        bags = []
        for f, own in ((g, i), (t, j)):
            place = np.full(len(f.row), -1)
            place[own] = np.arange(len(both))
            pair = place[f.tree]
            a, b = (_rebased if way == "rebased" else lambda f: _moved(f, pair, g, i))(f)
            counted = ~f.leaf & (pair >= 0) & ((f.parent >= 0) & (b > a) if way == "rebased" else ~f.is_code(["", "S1"]))
            bags.append(np.stack([pair, a, b, code(f)])[:, counted])
        sides = np.repeat([0, 1], [x.shape[1] for x in bags])
        every = np.concatenate(bags, axis=1)
        order = np.lexsort(every[::-1])
        every, sides = every[:, order], sides[order]
        new = np.flatnonzero(np.append(True, (every[:, 1:] != every[:, :-1]).any(axis=0))) if every.shape[1] else np.zeros(0, int)
        tests_, all_ = (np.add.reduceat(x, new) if len(new) else np.zeros(0, int) for x in (sides, np.ones_like(sides)))
        count = lambda x: np.bincount(every[0, new], weights=x, minlength=len(both)).astype(np.int64)
        return both, [count(all_ - tests_), count(tests_), count(np.minimum(all_ - tests_, tests_))]

    counts = each_forest(pairs, run, "n_gold long, n_test long, n_matched long", key, (gold, test))
    out = ratios(counts)
    return out.withColumn("recall", F.when(F.col("n_gold") == 0, 1.0).otherwise(F.col("recall"))) if way == "rebased" else out


def marked_diff(pairs: DataFrame, key="sent_id", gold: str = "gold", test: str = "tree") -> DataFrame:
    """key, tree: the test tree, with !label! on phrases whose labelled span isn't gold's (as often as gold has it)."""

    def run(golds, tests):
        g, t = Forest.read(golds), Forest.read(tests)
        both, i, j = np.intersect1d(g.row, t.row, assume_unique=True, return_indices=True)
        names = {x: n for n, x in enumerate(dict.fromkeys([*g.names, *t.names]))}
        bags, nodes = [], []
        for f, own in ((g, i), (t, j)):
            place, code = np.full(len(f.row), -1), np.array([names[x] for x in f.names] or [0], np.int64)
            place[own] = np.arange(len(both))
            pair = place[f.tree]
            k = np.flatnonzero(~f.leaf & (pair >= 0))
            bags.append([pair[k], f.start[k], f.finish[k], code[f.code[k]]])
            nodes.append(k)
        gold = len(nodes[0])
        which = different([np.concatenate(x).astype(np.int64) for x in zip(*bags, strict=True)])[1]
        has, own = np.bincount(which[:gold], minlength=int(which.max()) + 1 if len(which) else 0), which[gold:]
        order = np.argsort(own, kind="stable")
        new = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])) if len(own) else order
        nth = np.empty(len(own), np.int64)
        nth[order] = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
        code = t.code.astype(np.int64)
        code[nodes[1][nth >= has[own]]] += len(t.names)
        labels = pa.array([*t.names, *(f"!{x}!" for x in t.names)], pa.string()).take(pa.array(code))
        return both, [t.write(labels).take(pa.array(j))]

    return each_forest(pairs, run, "tree string", key, (gold, test))


def row_subtrees(trees: DataFrame, key="sent_id", tree: str = "tree") -> DataFrame:
    """key, node, label, children as subtrees() has them, where the tree's row is: nothing moves."""

    def run(texts):
        f = Forest.read(texts)
        order, begin = f.kids
        k = np.flatnonzero(np.diff(begin))
        children = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(f.local(np.arange(len(f)))[order], pa.int32()))
        return f.row[f.tree[k]], [k - f.base[k], f.labels_at(k), children.take(pa.array(k))]

    return each_forest(trees, run, "node int, label string, children array<int>", key, tree)


def subtrees(nodes: DataFrame, key="sent_id") -> DataFrame:
    """key, node, children: the nodes right below each phrase, in order; children[i] and slices of it are a tree's items."""
    keys = [key] if isinstance(key, str) else list(key)
    return nodes.where("parent IS NOT NULL").groupBy(*keys, F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("children"))


def set_values(nodes: DataFrame, label: Column | None = None, word: Column | None = None) -> DataFrame:
    """nodes with new labels or words. A word for a phrase, and no word for a preterminal, is an error, as is an empty label."""
    out = nodes
    if label is not None:
        out = out.withColumn("label", F.when(F.coalesce(label, F.lit("")) == "", F.raise_error(F.lit("a label can't be empty"))).otherwise(label))
    if word is not None:
        phrase = F.col("_was").isNull()
        checked = F.when(phrase & word.isNotNull(), F.raise_error(F.lit("a phrase has no word"))).when(~phrase & (F.coalesce(word, F.lit("")) == ""), F.raise_error(F.lit("a preterminal needs a word"))).otherwise(word)
        out = out.withColumn("_was", F.col("word")).withColumn("word", checked.cast("string")).drop("_was")
    return out
