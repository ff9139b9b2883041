"""The chart parser against all derivations of small sentences."""

import itertools
import math

import numpy as np

from sylva.operators import parser
from sylva.sources import ptb


def grammar():
    labels = ["NP", "S", "VP", "D", "N", "V"]
    g = parser.Grammar(labels, 3, np.full((3, 7, 7), -np.inf))
    at = {x: k for k, x in enumerate(labels)} | {"^": 6, "$": 6}
    for p, a, b, v in [("S", "^", "NP", 0.9), ("S", "^", "VP", 0.1), ("S", "NP", "VP", 0.8), ("S", "NP", "$", 0.2), ("S", "VP", "$", 1), ("NP", "^", "D", 0.6), ("NP", "^", "N", 0.4), ("NP", "D", "N", 1), ("NP", "N", "N", 0.3), ("NP", "N", "$", 0.7), ("VP", "^", "V", 1), ("VP", "V", "NP", 0.5), ("VP", "V", "$", 0.5), ("VP", "NP", "$", 1)]:
        g.steps[at[p], at[a], at[b]] = math.log2(v)
    return g


def best(g, label, forms, tags):
    """The best derivation by trying all ways to cut a span into children."""
    n, size = len(forms), len(g.labels)
    k = g.labels.index(label)
    if k >= g.n_phrases:
        return dict(tags[0]).get(label, -math.inf) if n == 1 else -math.inf
    out = -math.inf
    for m in range(1, n + 1):
        for cuts in itertools.combinations(range(1, n), m - 1):
            edges = [0, *cuts, n]
            for kids in itertools.product(range(size), repeat=m):
                if m == 1 and kids[0] == k:
                    continue
                path = [size, *kids, size]
                value = sum(g.steps[k, a, b] for a, b in itertools.pairwise(path))
                if value > -math.inf:
                    value += sum(best(g, g.labels[c], forms[x:y], tags[x:y]) for c, x, y in zip(kids, edges, edges[1:], strict=False))
                    out = max(out, value)
    return out


def test_against_all_derivations():
    g = grammar()
    words = {"d": [("D", -1.0)], "n": [("N", -2.0), ("V", -4.0)], "v": [("V", -1.5), ("N", -3.0)]}
    for forms in itertools.chain(*(itertools.product("dnv", repeat=r) for r in (1, 2, 3, 4))):
        tags = [words[w] for w in forms]
        value, tree = parser.parse(g, list(forms), tags)
        want = best(g, "S", list(forms), tags)
        assert value == want or abs(value - want) < 1e-9
        assert tree.startswith("(S1 (S (") and [t.split(")")[0] for t in tree.split(" ")[2:] if not t.startswith("(")] == list(forms)


def test_train_and_parse(spark):
    trees = spark.createDataFrame([(1, "(S1 (S (NP (D the) (N cat)) (VP (V sat))))"), (2, "(S1 (S (NP (N dogs)) (VP (V saw) (NP (D the) (N cat)))))")], "sent_id long, tree string")
    nodes = ptb.read_nodes(trees)
    tokens = nodes.where("word IS NOT NULL").selectExpr("sent_id", "start AS pos", "word AS form", "label AS tag")
    g = parser.train_grammar(nodes)
    train = tokens.unionAll(tokens).unionAll(tokens)  # words seen twice at most count as unknown
    parsed = {r.sent_id: r for r in parser.parse_df(parser.lattice(tokens, train), g).collect()}
    assert {k: r.tree for k, r in parsed.items()} == {r.sent_id: r.tree for r in trees.collect()} and all(r.logprob < 0 for r in parsed.values())
    short = parser.parse_df(parser.lattice(tokens, train), g, max_length=3).where("sent_id = 2").first()
    assert short.logprob is None and short.tree == "(S1 (S (N dogs) (V saw) (D the) (N cat)))"


def value_of(g, tree, tags):
    """The score of a tree, node by node."""
    at, words, stack = {x: k for k, x in enumerate(g.labels)}, iter(tags), [[]]
    total = 0.0
    for piece in tree.removeprefix("(S1 ").removesuffix(")").replace(")", " )").split():
        if piece.startswith("("):
            stack[-1].append(piece[1:])
            stack.append([piece[1:]])
        elif piece == ")":
            label, *kids = stack.pop()
            if kids:
                path = [len(g.labels), *(at[k] for k in kids), len(g.labels)]
                total += sum(g.steps[at[label], a, b] for a, b in itertools.pairwise(path))
            else:
                total += dict(next(words))[label]
    return total


def test_long_sentences(spark):
    g, words = grammar(), {"d": [("D", -1.0)], "n": [("N", -2.0), ("V", -4.0)], "v": [("V", -1.5), ("N", -3.0)]}
    rows = [(n, list(forms), [words[w] for w in forms]) for n in (41, 120, 399, 400) for forms in ["dn" + "n" * (n - 4) + "vn"]]
    df = spark.createDataFrame(rows, "sent_id long, forms array<string>, tags array<array<struct<tag:string,p:double>>>")
    got = {r.sent_id: r for r in parser.parse_df(df, g).collect()}
    for n, _, tags in rows[:3]:
        assert got[n].logprob is not None and abs(value_of(g, got[n].tree, tags) - got[n].logprob) < 1e-6
    assert got[400].logprob is None


def test_deep_unaries():
    g = parser.Grammar(["A", "B", "C", "S", "T"], 4, np.full((4, 6, 6), -np.inf))
    for p, b in [(3, 0), (0, 1), (1, 2), (2, 4)]:
        g.steps[p, 5, b] = g.steps[p, b, 5] = -0.5
    assert parser.parse(g, ["x"], [[("T", -1.0)]]) == (-5.0, "(S1 (S (A (B (C (T x))))))")
