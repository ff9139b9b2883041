"""n-best parses, constraints and sums over parses against all derivations of small sentences."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.functions.rowtree import RowTree
from sylva.operators import nbestparser as nb
from sylva.operators import parser
from tests.test_parser import grammar

WORDS = {"d": [("D", -1.0)], "n": [("N", -2.0), ("V", -4.0)], "v": [("V", -1.5), ("N", -3.0)]}


def derivations(g, label, i, j, tags, forms, unary):
    """(score, text) of every derivation of a label over a span with at most `unary` phrases in a row."""
    size, k = len(g.labels), label
    if k >= g.n_phrases:
        return [(dict(tags[i])[g.labels[k]], f"({g.labels[k]} {forms[i]})")] if j - i == 1 and g.labels[k] in dict(tags[i]) else []
    out = []
    for m in range(1, j - i + 1):
        for cuts in itertools.combinations(range(i + 1, j), m - 1):
            edges = [i, *cuts, j]
            for kids in itertools.product(range(size), repeat=m):
                value = sum(g.steps[k, a, b] for a, b in itertools.pairwise([size, *kids, size]))
                if value == -math.inf or (m == 1 and kids[0] < g.n_phrases and unary == 0):
                    continue
                parts = [derivations(g, c, x, y, tags, forms, unary - 1 if m == 1 else 3) for c, x, y in zip(kids, edges, edges[1:], strict=False)]
                for combo in itertools.product(*parts):
                    out.append((value + sum(s for s, _ in combo), f"({g.labels[k]} " + " ".join(t for _, t in combo) + ")"))
    return out


def test_nbest_is_all_derivations_in_order():
    g = grammar()
    for forms in itertools.chain(*(itertools.product("dnv", repeat=r) for r in (1, 2, 3, 4, 5))):
        tags = [WORDS[w] for w in forms]
        want = sorted((round(s, 6) for s, _ in derivations(g, g.labels.index("S"), 0, len(forms), tags, forms, 3)), reverse=True)
        got = nb.nbest(g, list(forms), tags, nb.Options(nbest=30, unary=3))
        assert [round(s, 6) for s, _ in got] == want[:30] and len({t for _, t in got}) == len(got)
        best = parser.parse(g, list(forms), tags)[0]
        assert (not got and best == -math.inf) or abs(got[0][0] - best) < 1e-9


def test_sums_and_posteriors():
    g = grammar()
    forms = "dnvn"
    tags = [WORDS[w] for w in forms]
    every = derivations(g, g.labels.index("S"), 0, 4, tags, forms, 3)
    total, post = nb.posteriors(g, tags)
    assert abs(total - math.log2(sum(2**s for s, _ in every))) < 1e-9
    for label in range(g.n_phrases):
        for i, w in itertools.product(range(4), range(1, 5)):
            if i + w <= 4:
                share = sum(2**s for s, t in every for x in [RowTree.read(f"(S1 {t})")] if any((x.start[k], x.finish[k], x.label[k]) == (i, i + w, g.labels[label]) for k in range(1, len(x)))) / 2**total
                assert abs(post[label, i, w] - share) < 1e-9
    assert nb.posteriors(g, [[("X", -1.0)]])[0] == -math.inf
    assert nb.likely(post).sum() == (post > 0.0008).sum()


def test_constraints():
    g, forms = grammar(), list("nnvn")
    tags = [WORDS[w] for w in forms]
    free = nb.nbest(g, forms, tags)
    held = nb.nbest(g, forms, tags, constraints=[(0, 3, ["NP"])])
    assert held and all(nb.holds(RowTree.read(t), [(0, 3, ["NP"])]) for _, t in held) and len(held) < len(free)
    assert {t for _, t in held} == {t for _, t in free if nb.holds(RowTree.read(t), [(0, 3, ["NP"])])}
    assert nb.nbest(g, forms, tags, constraints=[(0, 2, ["VP"])]) == []
    assert nb.nbest(g, forms, tags, constraints=[(0, 1, ["VP"])])  # of one word: let go
    with pytest.raises(ValueError):
        nb.nbest(g, forms, tags, constraints=[(2, 9, ["NP"])])
    with pytest.raises(ValueError):
        nb.Options(language="Xx")


def test_tables(spark):
    g = grammar()
    rows = [(1, list("dnv"), [WORDS[w] for w in "dnv"]), (2, ["q"], [[("Q", -1.0)]]), (3, list("nv"), [WORDS[w] for w in "nv"])]
    lattice = spark.createDataFrame(rows, "sent_id long, forms array<string>, tags array<array<struct<tag:string,p:double>>>")
    parses = nb.parse_nbest(lattice, g)
    got = {(r.sent_id, r.k): r for r in parses.collect()}
    assert {s for s, _ in got} == {1, 3}
    scores = {(r.sent_id, r.k): r.score for r in nb.tree_scores(parses, lattice, g).collect()}
    assert all(abs(scores[x] - r.logprob) < 1e-9 for x, r in got.items())
    best = {r.sent_id: r.tree for r in nb.simple_parse(lattice, g).collect()}
    assert best[1] == got[1, 0].tree and best[2] == "(S1 (S (Q q)))"
    sums = {r.sent_id: r.grammar for r in nb.sentence_probabilities(lattice, g).collect()}
    assert sums[2] is None and sums[1] >= got[1, 0].logprob
    only = nb.with_possible_tags(lattice, F.expr("map(0, array('N', 'D'))"), ["D", "N", "V"]).where("sent_id = 1").first()
    assert [(x.tag, x.p) for x in only.tags[0]] == [("N", -1.0), ("D", -2.0)] and len(only.tags[1]) == 2
    with pytest.raises(Exception, match="invalid tags: A, Z"):
        nb.with_possible_tags(lattice, F.expr("map(0, array('Z', 'A', 'N'))"), ["D", "N", "V"]).collect()
    limited = lattice.where("sent_id = 1").withColumn("constraints", F.expr("array(named_struct('start', 0, 'end', 2, 'terms', array('NP')))"))
    assert all("(NP (D d) (N n))" in r.tree for r in nb.parse_nbest(limited, g).collect())
    both = nb.retried(parses.where("sent_id = 1"), parses)
    assert both.count() == parses.count()
    mixed = spark.createDataFrame([(-10.0, -12.0), (None, -3.0)], "a double, b double").select(nb.mixed_scores(F.col("a"), F.col("b")).alias("m")).collect()
    assert abs(mixed[0].m - math.log2(0.667 * 2**-10 + 0.333 * 2**-12)) < 1e-9 and mixed[1].m is not None
    assert np.isfinite(mixed[1].m)
