"""Jaccard join, suffix dedup and the pipeline against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from sylva.llm import jaccard, quality, suffixes
from sylva.llm.components import components


def near_copies(n=120, words=60, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(999)}" for _ in range(words)]
    out = []
    for _ in range(n):
        b = list(base)
        for _ in range(rng.randrange(3)):
            b[rng.randrange(words)] = f"z{rng.randrange(99999)}"
        out.append(" ".join(b))
    return out


def sets_of(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_classes(rows):
    sets = [sets_of(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or common and common >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            yield rows[i][0], min(ids) if ids else None, len(members), links[i]


ROWS = [(100 + k, t) for k, t in enumerate(near_copies())] + [(500 + k, t) for k, t in enumerate(near_copies(20, 200, 9))] + [
    (1, None), (2, ""), (3, " "), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b"), (4, "a b"), (7, ""), (None, "only null")
]


@pytest.mark.parametrize("block", [1024, 30])
def test_op6(spark, monkeypatch, block):
    plain = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda *a: plain(*a, block=block))
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, key int").repartition(4)
    assert sorted(map(tuple, jaccard.op6_jaccard_join(df).collect()), key=str) == sorted(brute_classes(ROWS), key=str)


def test_one_of_each(spark):
    df = spark.createDataFrame([(i, t, i, "x") for i, t in ROWS], "doc_id long, text string, _key long, _class string").repartition(4)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c, *_ in brute_classes(ROWS) if c is not None})
    assert jaccard.one_of_each(df.limit(0)).count() == 0 == jaccard.op6_jaccard_join(df.limit(0)).count()


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def brute_repeats(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    for r in raws:
        covered = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                covered[i + 1 : i + 1 + least] = True
        kept = bytes(b for b, c in zip(r, covered[1:-1], strict=True) if not c)
        yield len(r), int(covered.sum()), int((np.diff(covered.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()


def passages():
    rng = random.Random(3)
    w = lambda n: "".join(rng.choice("abcd efgh") for _ in range(n))
    common = [w(150) for _ in range(3)]
    rows = [(k, w(rng.randrange(120)) + rng.choice(common)[rng.randrange(60) :] + w(rng.randrange(120))) for k in range(90)]
    return [*rows, (200, "Und " * 100), (201, "x" * 300), (202, None), (203, ""), (204, "é" * 90), (204, "é" * 90), (205, w(63)), (206, "ab" * 60 + w(20) + "ab" * 60), (None, w(40))]


@pytest.mark.parametrize(("bucket_rows", "most"), [(10_000, 4096), (40, 4096), (40, 3)])
def test_op7(spark, monkeypatch, bucket_rows, most):
    plain = suffixes.sorted_matches
    monkeypatch.setattr(suffixes, "sorted_matches", lambda rows, least: plain(rows, least, bucket_rows, most))
    rows = passages()
    df = spark.createDataFrame([(i, t, 2) for i, t in rows], "doc_id long, text string, key int").repartition(4)
    want = [(i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 64), strict=True)]
    got = suffixes.op7_suffix_dedup(df, 64).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)  # here no character loses a part
    assert suffixes.op7_suffix_dedup(df.limit(0), 64).count() == 0


def test_op7_passages_of_over_50_words(spark):
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows, want = [(100 + k, prose(120)) for k in range(10)], {}
    for k in range(20):  # a passage in two documents, of 400 bytes or just under
        size = 400 - k % 2
        passage = prose(60)[:size]
        for i, (a, b) in enumerate(("12", "34")):
            before, after = prose(30) + a, b + prose(30)
            rows.append((2 * k + i, before + passage + after))
            want[2 * k + i] = (size, 1, before + after) if size == 400 else (0, 0, before + passage + after)
        assert len(passage) == size and len(passage.split()) > 50
    want |= {i: (0, 0, t) for i, t in rows[:10]}
    got = suffixes.op7_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, r.text) for r in got} == want
    assert {r.doc_id: r.n_bytes for r in got} == {i: len(t) for i, t in rows}  # the input's, whatever goes


def test_multikey_quicksort():
    rng = random.Random(6)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 60))) for _ in range(2000)]
    words = suffixes.words_matrix(strings, 60)
    order = suffixes.multikey_quicksort(words)
    padded = [s.ljust(64, b"\0") for s in strings]
    assert [padded[i] for i in order] == sorted(padded)


def test_remove_repeats_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x" * 300, 7, "k"), (2, "x" * 300, 8, "k"), (3, "clean", 9, None)], "doc_id long, text string, _key long, _kept string")
    got = suffixes.remove_repeats(df, 200)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "", 7, "k"), (2, "", 8, "k"), (3, "clean", 9, None)]
    joined = jaccard.jaccard_join(df.withColumnRenamed("_kept", "_class"), keep=("doc_id", "_key"))
    assert {(r.doc_id, r._key, r._links) for r in joined.collect()} == {(1, 7, 1), (2, 8, 1), (3, 9, 0)}


def test_remove_repeats_keeps_whole_characters(spark):
    passage = "é" * 150
    rows = [(1, "aaa" + passage, 0), (2, passage + "bbb", 0), (3, "clean text", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffixes.remove_repeats(df, 200).collect()}
    assert got == {1: ("aaa", 3), 2: ("bbb", 3), 3: ("clean text", 10)}


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    from sylva.llm.common import cut

    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "in", *(f"w{rng.randrange(5000)}" for _ in range(4))]) for _ in range(n))
    shared = prose(60)
    clean = [prose(150) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(clean)] + [(100, clean[0]), (101, clean[1] + " end"), (102, "junk ### " * 80), (103, None), (104, prose(120) + " " + shared + " " + prose(120)), (105, prose(130) + " " + shared + " " + prose(90))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs.columns
        docs = cut(stage(spark, docs, ""), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before
    assert set(kept["quality_rules"]) == {*range(30), 100, 101, 104, 105}
    assert set(kept["near_duplicates"]) == {*range(30), 104, 105}
    texts = kept["repeated_passages"]
    assert all(texts[k].text == clean[k] for k in range(30)) and shared not in texts[104].text + texts[105].text and len(texts[104].text) > 400
    assert set(kept["packed_bins"]) == set(texts)


def brute_good(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    times = collections.Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = {i + d for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for d in range(3)}
    if len(words) < 50:
        return False
    share = lambda n: n / len(words)
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    shout = sum(len(w) > 1 and w == w.upper() and w != w.lower() for w in words)
    return (
        share(len(repeated)) <= 0.5 and 2 <= share(sum(map(len, words))) <= 15 and share(sum(c in "#*$%&|<>" for c in text)) <= 0.25
        and share(stop) >= 0.01 and (len(lines) - len(set(lines))) / len(lines) <= 0.4 and share(shout) <= 0.4
    )


def brute_pieces(rows):
    """(doc_id, piece, start, n_tokens) of what the pipeline keeps: all its stages in plain Python."""
    rows = [r for r in rows if brute_good(r[1])]
    least = {c for _, c, *_ in brute_classes(rows)}
    rows = [r for r in rows if r[0] in least]
    raws = [t.encode() for _, t in rows]
    seen = collections.Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for (doc_id, _), raw in zip(rows, raws, strict=True):
        gone = {i + k for i in range(len(raw) - 199) if seen[raw[i : i + 200]] > 1 for k in range(200)}
        left = bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
        n = len(re.findall("[^\x20\x09-\x0d]+", left)) + 1
        for piece in range(-(-n // 8192)):
            yield doc_id, piece, piece * 8192, min(8192, n - piece * 8192)


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(["the", "of", "é", "Und", *(f"w{rng.randrange(3000)}" for _ in range(5))]) for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    rows = []
    for _ in range(70):
        kind = rng.randrange(8)
        if kind == 0 and rows:  # an exact copy
            text = rng.choice(rows)
        elif kind == 1 and rows:  # a near copy
            words = (rng.choice(rows) or "x").split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = "zz"
            text = " ".join(words)
        elif kind == 2:
            text = rng.choice([None, "", "short text", "SHOUT " + prose(20).upper() + prose(30).upper(), "a b c " * 40, "# " * 50 + prose(60), "\n".join([prose(9)] * 9)])
        elif kind == 3:
            text = prose(rng.randrange(40, 60))
        else:
            text = prose(rng.randrange(60, 200)) + " " + rng.choice(shared) + rng.choice([" ", "\n"]) + prose(rng.randrange(60, 200))
        rows.append(text)
    rows = [*enumerate(rows), (500, prose(9000)), (501, prose(60) + " " + prose(20000))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    want = sorted(brute_pieces(rows))
    assert 40 < len(want) and sorted((r.doc_id, r.piece, r.start, r.n_tokens) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for parts in bins.values():
        ends = [0, *itertools.accumulate(r.n_tokens for r in sorted(parts, key=lambda r: r.bin_offset))]
        assert [r.bin_offset for r in sorted(parts, key=lambda r: r.bin_offset)] == ends[:-1]
        assert {(r.bin_tokens, r.bin_size) for r in parts} == {(ends[-1], min(s for s in (1024, 2048, 4096, 8192) if s >= ends[-1]))}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as pipeline

    rows = [(None, None), (None, ""), (1, "junk"), (1, "junk")]
    for k, some in enumerate((rows, [])):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long")
        docs.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        assert pipeline.run(spark, str(tmp_path / str(k))).count() == 0
