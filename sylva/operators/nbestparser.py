"""Several parses of a sentence, parses under constraints, and probabilities of sentences and spans, on the chart grammar.

nbest() fills the chart with best scores and then draws derivations in order, each item's next one only when another
asks for it. posteriors() sums over all derivations instead of taking the best, from inside and from outside. Both
keep the whole chart of one sentence, 8 bytes for each pair of parent and child that the grammar has and each span.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.functions.rowtree import RowTree
from sylva.operators.parser import MAX_LENGTH, Grammar, flat_tree

Tags = list[list[tuple[str, float]]]


@dataclass(frozen=True)
class Options:
    """What a parse may be told: the number of parses, the longest sentence, how many phrases may stand over one span in a row,
    and for the words' tags the language, whether capitals are ignored, and what open-class tags of a known word get that it wasn't seen with."""

    nbest: int = 50
    max_length: int = MAX_LENGTH
    unary: int = 6
    language: str = "En"
    case_insensitive: bool = False
    smooth_pos: float = 0.0

    def __post_init__(self) -> None:
        if self.language not in ("En", "Ch", "Ar"):
            raise ValueError(f"unknown language {self.language}")
        if self.nbest < 1 or self.unary < 1 or not 1 <= self.max_length <= MAX_LENGTH:
            raise ValueError("options out of range")


def disrupts(a: int, b: int, start: int, end: int) -> bool:
    """Whether the span (start, end) can't stand in a tree with a constituent (a, b)."""
    return a < start < b < end or start < a < end < b


def allowed_spans(g: Grammar, n: int, constraints: list[tuple[int, int, list[str]]]) -> np.ndarray | None:
    """allowed[phrase, first, width]: constrained spans take their terms, spans that cross one none, others all."""
    if not constraints:
        return None
    out = np.ones((g.n_phrases, n, n + 1), bool)
    at = {x: k for k, x in enumerate(g.labels)}
    for a, b, terms in constraints:
        if not 0 <= a < b <= n:
            raise ValueError(f"no span ({a}, {b}) in a sentence of {n} words")
        keep = [at[t] for t in terms if at.get(t, g.n_phrases) < g.n_phrases]
        only = np.zeros(g.n_phrases, bool)
        only[keep] = True
        out[:, a, b - a] &= only
        for s in range(n):
            for e in range(s + 1, n + 1):
                if disrupts(a, b, s, e):
                    out[:, s, e - s] = False
    return out


def holds(tree: RowTree, constraints: list[tuple[int, int, list[str]]]) -> bool:
    """Whether for each constraint the tree has a phrase, or a word's tag, over the span with one of its terms."""
    spans = {(tree.start[k], tree.finish[k], tree.label[k]) for k in range(len(tree))}
    return all(any((a, b, t) in spans for t in terms) for a, b, terms in constraints)


class Chart:
    """Best log2 scores: done[phrase, first, width], part[pair, first, width] (children so far, the pair's child last), leaf[tag, word]."""

    def __init__(self, g: Grammar, tags: Tags, unary: int, allowed: np.ndarray | None = None) -> None:
        self.g, self.n, self.unary = g, len(tags), unary
        self.parent, self.child, self.start, self.stop, self.own, self.steps = g.pairs
        n, p = self.n, g.n_phrases
        at = {x: k for k, x in enumerate(g.labels)}
        self.leaf = np.full((len(g.labels), n), -np.inf)
        for i, each in enumerate(tags):
            for tag, score in each:
                if at.get(tag, -1) >= p:
                    self.leaf[at[tag], i] = score
        self.allowed = allowed
        self.done = np.full((p, n, n + 1), -np.inf)
        self.part = np.full((len(self.parent), n, n + 1), -np.inf)
        for width in range(1, n + 1):
            m = n - width + 1
            multi = np.full((len(self.parent), m), -np.inf)  # two children or more
            if width > 1:
                for rows, inner in zip(self.own, self.steps, strict=True):
                    if not len(rows):
                        continue
                    before = (self.part[rows][:, None, :m, 1:width] + inner[:, :, None, None]).max(axis=0)  # (child, first, width before)
                    for x, r in enumerate(rows):
                        c = self.child[r]
                        for k in range(1, width):
                            last = self.value(c, k, width - k, m)
                            np.maximum(multi[r], before[x, :, k - 1] + last, out=multi[r])
            cell = np.full((p, m), -np.inf)
            for _ in range(unary + 1):
                alone = np.where(self.child[:, None] >= p, self.leaf[self.child, :m] if width == 1 else -np.inf, np.where(self.child[:, None] < p, cell[np.minimum(self.child, p - 1)], -np.inf))
                both = np.maximum(multi, self.start[:, None] + alone)
                new = np.full((p, m), -np.inf)
                np.maximum.at(new, self.parent, both + self.stop[:, None])
                if allowed is not None:
                    new[~allowed[:, :m, width]] = -np.inf
                if np.array_equal(new, cell):
                    break
                cell = new
            self.done[:, :m, width] = cell
            self.part[:, :m, width] = both

    def value(self, label: int, first: int, width: int, m: int) -> np.ndarray:
        """Best scores of a label over the spans that begin at first, first + 1, ... (m of them)."""
        if label >= self.g.n_phrases:
            return self.leaf[label, first : first + m] if width == 1 else np.full(m, -np.inf)
        return self.done[label, first : first + m, width]


class _Lazy:
    """Derivations of chart items in order. An item is ('p', label, first, width, height) or ('r', pair, first, width, height)."""

    def __init__(self, chart: Chart, most: int) -> None:
        self.c, self.most = chart, most
        self.found: dict = {}
        self.queue: dict = {}
        self.seen: dict = {}

    def _edges(self, item) -> list[tuple[float, tuple]]:
        """The best ways to build an item: (score beside the tails', tails)."""
        c, (kind, x, i, w, h) = self.c, item
        g = c.g
        if kind == "p":
            if h < 0 or (c.allowed is not None and not c.allowed[x, i, w]):
                return []
            rows = c.own[x]
            return [(float(c.stop[r]), (("r", int(r), i, w, h),)) for r in rows if np.isfinite(c.part[r, i, w] + c.stop[r])]
        child, out = int(c.child[x]), []
        if child >= g.n_phrases:
            if w == 1 and np.isfinite(c.start[x] + c.leaf[child, i]):
                out.append((float(c.start[x] + c.leaf[child, i]), ()))
        elif h > 0 and np.isfinite(c.start[x] + c.done[child, i, w]):
            out.append((float(c.start[x]), (("p", child, i, w, h - 1),)))
        if w > 1:
            rows = c.own[int(c.parent[x])]
            step = c.steps[int(c.parent[x])][:, int(np.flatnonzero(rows == x)[0])]
            widths = np.arange(1, w) if child < g.n_phrases else np.array([w - 1])
            last = c.done[child, i + widths, w - widths] if child < g.n_phrases else c.leaf[child, i + widths]
            scores = c.part[rows][:, i, widths] + step[:, None] + last[None]
            flat = scores.ravel()
            order = np.argsort(-flat, kind="stable")[: self.most]
            for o in order[np.isfinite(flat[order])].tolist():
                r, k = divmod(o, len(widths))
                m = int(widths[k])
                tails = [("r", int(rows[r]), i, m, c.unary)]
                score = float(step[r])
                if child < g.n_phrases:
                    tails.append(("p", child, i + m, w - m, c.unary))
                else:
                    score += float(c.leaf[child, i + m])
                out.append((score, tuple(tails)))
        return out

    def _push(self, item, edge, ranks) -> None:
        if (edge, ranks) in self.seen[item]:
            return
        self.seen[item].add((edge, ranks))
        score, tails = self.edges[item][edge]
        for t, r in zip(tails, ranks, strict=True):
            d = self.get(t, r)
            if d is None:
                return
            score += d[0]
        heapq.heappush(self.queue[item], (-score, edge, ranks))

    edges: dict

    def get(self, item, rank: int):
        """(score, edge, ranks) of an item's derivation of that rank, or None."""
        if item not in self.found:
            if not hasattr(self, "edges"):
                self.edges = {}
            self.found[item], self.queue[item], self.seen[item], self.edges[item] = [], [], set(), self._edges(item)
            for e, (_, tails) in enumerate(self.edges[item]):
                self._push(item, e, (0,) * len(tails))
        done, queue = self.found[item], self.queue[item]
        while len(done) <= rank:
            if done:
                _, edge, ranks = done[-1]
                for k in range(len(ranks)):
                    self._push(item, edge, (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :]))
            if not queue:
                return None
            score, edge, ranks = heapq.heappop(queue)
            done.append((-score, edge, ranks))
        return done[rank]

    def children(self, item, rank: int) -> list[tuple]:
        """The children of a phrase's derivation from left to right: (item, rank) of phrases, (tag, word) of leaves."""
        c = self.c
        _, edge, (r,) = self.get(item, rank)
        (part,) = self.edges[item][edge][1]
        out = []
        while True:
            _, edge, ranks = self.get(part, r)
            tails, child = self.edges[part][edge][1], int(c.child[part[1]])
            first, width = part[2], part[3]
            alone = not tails or tails[0][0] == "p"
            if child >= c.g.n_phrases:
                out.append((child, first + width - 1))
            else:
                out.append((tails[-1], ranks[-1]))
            if alone:
                return out[::-1]
            part, r = tails[0], ranks[0]


def nbest(g: Grammar, forms: list[str], tags: Tags, options: Options = Options(), constraints: list[tuple[int, int, list[str]]] = ()) -> list[tuple[float, str]]:  # noqa: B008
    """(log2 probability, tree) of the best different parses, best first; none if there's no parse.

    Parses that only differ in nothing but their order of derivation are one; with constraints only trees that hold them all
    come out. If none does, spans of one word are let go once.
    """
    if not forms or len(forms) > options.max_length:
        return []
    constraints = list(constraints)
    single = [x for x in constraints if x[1] - x[0] > 1]
    for chosen in [constraints] if len(single) == len(constraints) else [constraints, single]:
        phrases = [(a, b, [t for t in terms if t in g.labels[: g.n_phrases]]) for a, b, terms in chosen]
        chart = Chart(g, tags, options.unary, allowed_spans(g, len(forms), [x for x in phrases if x[2]]))
        lazy, root = _Lazy(chart, options.nbest), g.labels.index(g.root)
        top = ("p", root, 0, len(forms), options.unary)
        out: dict[str, float] = {}
        rank = 0
        while len(out) < options.nbest and (d := lazy.get(top, rank)) is not None:
            tree = f"(S1 {_text(lazy, top, rank, forms)})"
            if tree not in out and (not chosen or holds(RowTree.read(tree), chosen)):
                out[tree] = d[0]
            rank += 1
        if out:
            return [(score, tree) for tree, score in out.items()]
    return []


def _text(lazy: _Lazy, item, rank: int, forms: list[str]) -> str:
    out, todo, labels = [], [(item, rank)], lazy.c.g.labels
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x[0], int):
            out.append(f"({labels[x[0]]} {forms[x[1]]})")
        else:
            out.append(f"({labels[x[0][1]]}")
            todo.append(")")
            for child in reversed(lazy.children(*x)):
                todo += [child, " "]
    return "".join(out)


def posteriors(g: Grammar, tags: Tags, scale: float = 64.0) -> tuple[float, np.ndarray]:
    """(log2 of the summed probability of all derivations, P(a phrase over a span) by phrase, first, width). (-inf, zeros) if there's none.

    Words' probabilities are scaled by a constant; chains of unary rules of any length are summed by the inverse of
    1 - U. inside * outside over the total is the posterior.
    """
    n, p = len(tags), g.n_phrases
    parent, child, start, stop, own, steps = g.pairs
    begin, end = np.exp2(start), np.exp2(stop)
    inner = [np.exp2(s) for s in steps]
    at = {x: k for k, x in enumerate(g.labels)}
    leaf = np.zeros((len(g.labels), n))
    for i, each in enumerate(tags):
        for tag, score in each:
            if at.get(tag, -1) >= p:
                leaf[at[tag], i] = scale * 2.0**score
    unary = np.zeros((p, p))
    low = child < p
    np.add.at(unary, (parent[low], child[low]), begin[low] * end[low])
    closure = np.linalg.inv(np.eye(p) - unary)
    done, part = np.zeros((p, n, n + 1)), np.zeros((len(parent), n, n + 1))
    x = lambda c, i, w: done[c, i, w] if c < p else (leaf[c, i] if w == 1 else 0.0)
    for w in range(1, n + 1):
        for i in range(n - w + 1):
            multi = np.zeros(len(parent))
            for k in range(1, w):
                last = np.where(low, done[np.minimum(child, p - 1), i + k, w - k], leaf[child, i + k] if w - k == 1 else 0.0)
                for rows, step in zip(own, inner, strict=True):
                    multi[rows] += (part[rows, i, k] @ step) * last[rows]
            base = multi + np.where(~low, begin * leaf[child, i], 0.0) if w == 1 else multi
            d = np.zeros(p)
            np.add.at(d, parent, base * end)
            done[:, i, w] = closure @ d
            part[:, i, w] = base + np.where(low, begin * done[np.minimum(child, p - 1), i, w], 0.0)
    root = at[g.root]
    total = done[root, 0, n]
    if not total > 0 or not math.isfinite(total):
        return -math.inf, np.zeros_like(done)
    out_done, out_part = np.zeros_like(done), np.zeros_like(part)
    out_done[root, 0, n] = 1.0
    for w in range(n, 0, -1):
        for i in range(n - w + 1):
            # what reaches a phrase from wider spans goes down its unary chains; out_part may hold uses as a left part
            via = np.zeros(p)
            np.add.at(via, child[low], (out_part[:, i, w] * begin)[low])
            out_done[:, i, w] = closure.T @ (out_done[:, i, w] + via)
            use = out_part[:, i, w] + out_done[parent, i, w] * end
            for k in range(1, w):
                last = np.where(low, done[np.minimum(child, p - 1), i + k, w - k], leaf[child, i + k] if w - k == 1 else 0.0)
                for rows, step in zip(own, inner, strict=True):
                    before = part[rows, i, k] @ step
                    out_part[rows, i, k] += step @ (use[rows] * last[rows])
                    phrases = rows[low[rows]]
                    np.add.at(out_done[:, i + k, w - k], child[phrases], (use[rows] * before)[low[rows]])
    return math.log2(total) - n * math.log2(scale), done * out_done / total


def likely(post: np.ndarray, least: float = 0.0008) -> np.ndarray:
    """The phrases whose posterior is over `least`: what is left of the chart after pruning."""
    return post > least


# --- tables


def _lattice_rows(batch):
    for r in batch.to_pylist():
        yield r, [[(x["tag"], x["p"]) for x in t] for t in r["tags"]]


def parse_nbest(sentences: DataFrame, g: Grammar, options: Options = Options()) -> DataFrame:  # noqa: B008
    """sent_id, k, logprob, tree of the best parses of a lattice (sent_id, forms, tags).

    An optional column constraints (array of struct start, end, terms) holds each sentence's constraints. A sentence without a parse has no rows.
    """
    kind = sentences.schema["sent_id"].dataType.simpleString()
    columns = ["sent_id", "forms", "tags", *(["constraints"] if "constraints" in sentences.columns else [])]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                part, at, found = batch.slice(a, 16), [], []
                for i, (r, tags) in enumerate(_lattice_rows(part)):
                    limits = [(c["start"], c["end"], list(c["terms"])) for c in r.get("constraints") or ()]
                    for k, (score, tree) in enumerate(nbest(g, r["forms"], tags, options, limits)):
                        at.append(i)
                        found.append((k, score, tree))
                cells = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([part.column("sent_id").take(pa.array(at, pa.int64())), pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.float64()), pa.array(cells[2], pa.string())], ["sent_id", "k", "logprob", "tree"])

    return sentences.select(*columns).mapInArrow(run, f"sent_id {kind}, k int, logprob double, tree string")


def simple_parse(sentences: DataFrame, g: Grammar, options: Options = Options()) -> DataFrame:  # noqa: B008
    """sent_id, tree: the best parse, or the flat tree of each word's likeliest tag."""
    best = parse_nbest(sentences, g, Options(**{**options.__dict__, "nbest": 1})).select("sent_id", "tree")
    return sentences.select("sent_id", "forms", "tags").join(best, "sent_id", "left").mapInArrow(_with_flat(g.root), f"sent_id {sentences.schema['sent_id'].dataType.simpleString()}, tree string")


def _with_flat(root: str):
    def run(batches):
        for batch in batches:
            trees = [r["tree"] or flat_tree(root, r["forms"], tags) for r, tags in _lattice_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), pa.array(trees, pa.string())], ["sent_id", "tree"])

    return run


def retried(first: DataFrame, second: DataFrame) -> DataFrame:
    """Parses (sent_id, ...) of the first list, and of the second those of sentences that the first has none of."""
    return first.unionByName(second.join(first.select("sent_id").distinct(), "sent_id", "left_anti"))


def with_possible_tags(lattice: DataFrame, possible: Column, known: list[str] | None = None) -> DataFrame:
    """The lattice with the tags that a map (place to array of tags) allows, of probabilities one half, a quarter and so on.

    Tags outside `known` are an error that names them in order.
    """
    if known is not None:
        wrong = F.array_sort(F.array_distinct(F.filter(F.flatten(F.map_values(possible)), lambda t: ~t.isin(*known))))
        lattice = lattice.withColumn("sent_id", F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("invalid tags: "), F.array_join(wrong, ", "))).cast(lattice.schema["sent_id"].dataType)).otherwise(F.col("sent_id")))
    own = F.transform("tags", lambda x, i: F.when(F.size(F.try_element_at(possible, i)) > 0, F.transform(F.try_element_at(possible, i), lambda t, j: F.struct(t.alias("tag"), (-(j + 1)).cast("double").alias("p")))).otherwise(x))
    return lattice.withColumn("tags", own)


def tree_scores(parses: DataFrame, lattice: DataFrame, g: Grammar) -> DataFrame:
    """sent_id, k, score: the log2 probability of given trees (sent_id, k, tree) under the grammar and the lattice; null where a step isn't known."""
    at = {x: k for k, x in enumerate(g.labels)}
    size = len(g.labels)

    def one(text, tags) -> float | None:
        tree = RowTree.read(text)
        if tree is None:
            return None
        total = 0.0
        for k in range(1, len(tree)):  # the root is free
            if tree.word[k] is not None:
                i = tree.start[k]
                total += dict(tags[i]).get(tree.label[k], -math.inf) if i < len(tags) else -math.inf
            else:
                path = [size, *(at.get(tree.label[c], -1) for c in tree.kids[k]), size]
                if -1 in path or at.get(tree.label[k], size) >= g.n_phrases:
                    return None
                total += sum(float(g.steps[at[tree.label[k]], a, b]) for a, b in zip(path, path[1:], strict=False))
        return total if math.isfinite(total) else None

    def run(batches):
        for batch in batches:
            scores = [one(r["tree"], tags) for r, tags in _lattice_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), batch.column("k"), pa.array(scores, pa.float64())], ["sent_id", "k", "score"])

    kinds = ", ".join(f"{c} {parses.schema[c].dataType.simpleString()}" for c in ("sent_id", "k"))
    return parses.select("sent_id", "k", "tree").join(lattice.select("sent_id", "tags"), "sent_id").mapInArrow(run, f"{kinds}, score double")


def sentence_probabilities(lattice: DataFrame, g: Grammar) -> DataFrame:
    """sent_id, grammar: log2 of the summed probability of all parses; null if there's none, or a sum leaves the range of doubles."""
    kind = lattice.schema["sent_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sums = [posteriors(g, tags)[0] if tags else -math.inf for _, tags in _lattice_rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("sent_id"), pa.array([x if math.isfinite(x) else None for x in sums], pa.float64())], ["sent_id", "grammar"])

    return lattice.select("sent_id", "forms", "tags").mapInArrow(run, f"sent_id {kind}, grammar double")


def mixed_scores(grammar: Column, trigram: Column, share: float = 0.667) -> Column:
    """log2 of share * 2^grammar + (1 - share) * 2^trigram, computed without leaving the range of doubles; the other one where one is null."""
    a, b = grammar + F.log2(F.lit(share)), trigram + F.log2(F.lit(1 - share))
    top = F.greatest(a, b)
    both = top + F.log2(F.pow(F.lit(2.0), a - top) + F.pow(F.lit(2.0), b - top))
    return F.coalesce(both, a, b)
