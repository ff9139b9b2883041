"""The source divergence audit against its definition, term by term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sylva.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string, p int"


def brute(rows, min_docs, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        found = terms(t)
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        everywhere = sum((c for (g, _), c in groups.items() if g == lang), Counter())

        def share(counts, t, kept=kept):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept))

        pairs = [(-sum(abs(share(own, t) - share(c, t)) for t in kept), s.encode(), s) for (g, s), c in groups.items() if g == lang and s != source]
        best = [(share(everywhere, t) - share(own, t), t.encode(), t) for t in kept if own[t] and share(own, t) > share(everywhere, t)]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
            out |= {(lang, source, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)}
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéßЖ" for b in ("ta", "Ri", "on", "ë", "漢", "x")]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "S2", "é", None])
        skew = words[: rng.choice([5, 20, 42])]
        rows.append((" ".join(rng.choice(skew) + rng.choice(["", ",", "9", "\x7f", "\x80", " "]) for _ in range(rng.randrange(60))), lang, source))
    rows += [(None, "en", "s9"), ("", "xx", "s0"), ("", "xx", "s1"), (rows[0][0], *rows[0][1:]), (None, None, None), ("word " * 300_000, "en", "s1"), ("y" * 1_200_000 + " Z", "en", "s1")]
    return rows


@pytest.mark.parametrize(("seed", "min_docs", "top"), [(0, 3, 4), (1, 1, 50), (2, 12, 7)])
def test_divergence_equals_its_definition(spark, seed, min_docs, top):
    rows = made(seed, 160)
    df = spark.createDataFrame([(None, t, lang, s, "x", "y", k) for k, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(5)
    got = [tuple(r) for r in divergence.divergence(df, min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, min_docs, top)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_counts_survive_a_flush(spark):
    df = spark.createDataFrame([(k, f"a b{k % 7} A", "en", "s") for k in range(2000)], "doc_id long, text string, lang string, source string").coalesce(1)
    counted = divergence.count_terms(df, most=3).groupBy("term").sum("n", "d").collect()
    assert {r[0]: (r[1], r[2]) for r in counted}["a"] == (4000, 2000) and len(counted) == 2 and {r[0] for r in counted} == {"a", "b"}


def test_search_opens_few_buckets(spark):
    rng = random.Random(5)
    counts = {f"t{k}": 2 + int(3000 / (k + 1)) for k in range(3000)}
    rows = [("en", s, t, int(n * rng.uniform(0.5, 1.5)) + 1) for t, n in counts.items() for s in ("a", "b", "c")]
    terms = spark.createDataFrame([(lang, s, t, n, n * 100, counts[t] * 100, 5, n.bit_length()) for lang, s, t, n in rows], "lang string, source string, term string, n long, p long, q long, z long, bucket int")
    seen = {(r.source, r.item): r.value for r in divergence.evaluated_terms(terms, 10).collect()}
    assert len(seen) < 0.2 * len(rows)
    for s in "abc":
        exact = sorted(((n - counts[t]) * 100 for _, x, t, n in rows if x == s), reverse=True)[:10]
        assert sorted((v for (x, _), v in seen.items() if x == s), reverse=True)[:10] == exact
