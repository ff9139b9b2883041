"""Context-tree weighting against a plain version, node by node."""

import collections
import math
import zlib

import numpy as np
import pytest

from sylva.llm import ctw, lmscore

DEPTH = 3


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def steps(raw):
    raw = b"\xff" * DEPTH + raw + b"\xff"
    for i in range(DEPTH, len(raw)):
        for k in range(8):
            node = 1 << k | raw[i] >> (8 - k)
            yield [(raw[i - d : i], node) for d in range(DEPTH + 1)], raw[i] >> (7 - k) & 1


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def plain(rows):
    low = lambda t: (t or "").encode().lower()
    counts = [collections.defaultdict(lambda: [0, 0]) for _ in range(DEPTH + 1)]
    for i, t in rows:
        if not held_out(i):
            for path, bit in steps(low(t)):
                for d, p in enumerate(path):
                    counts[d][p][bit] += 1
    weighted, below = [{} for _ in range(DEPTH + 1)], collections.defaultdict(float)
    for d in range(DEPTH, -1, -1):
        above = collections.defaultdict(float)
        for (c, q), (a, b) in counts[d].items():
            pe = log_kt(a, b)
            w = pe if d == DEPTH else np.logaddexp(pe, below[c, q]) - math.log(2)
            weighted[d][c, q] = w
            above[c[1:], q] += w
        below = above

    def bit_log(path, bit):
        p = None
        for d in range(DEPTH, -1, -1):
            a, b = counts[d].get(path[d], (0, 0))
            kt = ((b if bit else a) + 0.5) / (a + b + 1)
            s = math.exp(log_kt(a, b) - weighted[d].get(path[d], 0.0) - math.log(2))
            p = kt if d == DEPTH else s * kt + (1 - s) * p
        return math.log10(p)

    words = collections.Counter(w for i, t in rows if not held_out(i) for w in [*low(t).split(), b"\n"])
    n, v = sum(words.values()), len(words)
    for i, t in rows:
        tokens = [*low(t).split(), b"\n"]
        yield i, held_out(i), len(tokens), sum(words[w] > 0 for w in tokens), n, sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), sum(bit_log(*x) for x in steps(low(t)))


ROWS = [(k, f"The cat {k % 7} sat on the mat, the Dog {k * 37 % 11} ran.") for k in range(40)] + [(None, "null id"), (90, None), (91, ""), (92, "ÀB é\x00 x"), (93, "the cat 3 sat"), (93, "the cat 3 sat")]


def compare(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-3)


@pytest.mark.parametrize(("block", "shards"), [(1 << 24, 5), (300, 7)])
def test_scores(spark, block, shards):
    df = spark.createDataFrame([(i, t, 0.0) for i, t in ROWS], "doc_id long, text string, score double").repartition(3)
    compare([tuple(r)[:7] for r in lmscore.score(df, DEPTH, block, shards).collect()], list(plain(ROWS)))


def test_empty_and_all_held_out(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert lmscore.score(df.limit(0), DEPTH).count() == 0
    out = [(i, t) for i, t in ROWS if held_out(i)]
    compare([tuple(r)[:7] for r in lmscore.score(spark.createDataFrame(out, "doc_id long, text string"), DEPTH).collect()], list(plain(out)))


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.0, 1000.5, 1e7])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)


def test_better_than_words_on_held_out(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test tables")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = lmscore.op1_ctw_score(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert r[0] > r[1]


def test_long_texts_and_heavy_contexts(spark):
    """Texts of many pieces, and pairs of bytes that are split by a third; also a text without spaces."""
    rows = [(k, "ab" * 150 + str(k) + "ba " * (k % 3)) for k in range(12)] + [(20, "x" * 900), (21, "the cat")]
    whole, lmscore_chunks = list(plain(rows)), lmscore._chunks
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total, pairs = lmscore._pairs(df)
    assert sum(len(t) + 1 for _, t in rows) <= total and pairs[ord("b") << 8 | ord("a")] >= 1800
    assert (pairs > total / 10).sum() >= 3  # so shards=5 splits some
    compare([tuple(r)[:7] for r in lmscore.score(df, DEPTH, 1 << 20, 5).collect()], whole)
    raws = [t.encode() for _, t in rows]
    train = np.array([not held_out(i) for i, _ in rows])
    small = lambda r, kind, size=64: lmscore_chunks(r, kind, size)
    one = lmscore.block_requests(raws, train, "g", DEPTH)
    try:
        lmscore._chunks = small
        two = lmscore.block_requests(raws, train, "g", DEPTH)
    finally:
        lmscore._chunks = lmscore_chunks
    assert (one[0] == two[0]).all() and (one[1] == two[1]).all()
