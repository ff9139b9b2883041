"""Edit fingerprints against a walk of one text at a time."""

import datetime
import hashlib
import random

import numpy as np
import pytest

from sylva.llm import editprint as e


def walk(text):
    c, i, j, out = e.classes(text), 0, 0, {}
    while i < len(c) and j < 3 * len(c):
        go, bit, sampled, places = e._tables(j // 128)
        at = np.flatnonzero(sampled == j % 128)
        if len(at):
            out[int(places[at[0]])] = int(bit[j % 128][c[i]])
        i, j = i + int(go[j % 128][c[i]]), j + 1
    bits = np.zeros((1, (1 + e._octave(max(0, j - 1) // 128)) * 128), np.uint8)
    for k, v in out.items():
        bits[0, k] = v
    return e.to_strings(bits, np.array([j]))[0]


def make(n, rng):
    return "".join(rng.choice("abcdefgh é漢") for _ in range(n))


def test_walks():
    rng = random.Random(1)
    texts = [make(rng.choice([0, 1, 2, 5, 50, 300, 1500]), rng) for _ in range(40)]
    assert e.to_strings(*e.fingerprints([e.classes(t) for t in texts])) == [walk(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(2)
    text = make(3000, rng)
    prints = lambda t: e._row(walk(t))
    like = lambda a, b: float(e.likeness(*prints(a), *prints(b))[0])
    one = text[:1500] + "X" + text[1500:]
    assert like(text, text) == 1.0 and like(text, one) > 0.85
    assert 0.6 < like(text, text[:2250] + make(750, rng)) < 0.95 and like(text, make(3000, rng)) < 0.35
    assert like("", "") == 1.0 and like("", text) == 0.0


def test_op5(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(500), make(rng.choice([0, 3, 40, 200]), rng)) for _ in range(120)] + [(None, "null"), (-5, None), (3, ""), (3, "again")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars int").repartition(3)
    got = e.op5_edit_fingerprints(df, part_bytes=2000, batch_chars=700).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        a, b, c = walk(t), walk(edited), walk(following)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(float(e.likeness(*e._row(a), *e._row(b))[0]), 9), round(float(e.likeness(*e._row(a), *e._row(c))[0]), 9)))
    assert sorted(((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str) == sorted(want, key=str)
    assert e.op5_edit_fingerprints(df.limit(0)).count() == 0
    pairs = e.similar_pairs(e.fingerprint_df(df)).collect()
    assert all(r.likeness >= 0.8 and r.a != r.b for r in pairs)


def prints_of(spark, texts):
    return e.fingerprint_df(spark.createDataFrame([(t,) for t in texts], "text string"))


def brute_pairs(prints):
    rows = [e._row(p) for p in sorted(set(prints))]
    width = max(b.shape[1] for b, _ in rows)
    bits, ends = np.concatenate([np.pad(b, ((0, 0), (0, width - b.shape[1]))) for b, _ in rows]), np.concatenate([n for _, n in rows])
    names = sorted(set(prints))
    for i, b in enumerate(names):
        value = e.likeness(np.repeat(bits[i : i + 1], len(bits), 0), np.repeat(ends[i], len(ends)), bits, ends)
        yield from ((names[j], b) for j in np.flatnonzero(value >= 0.8) if names[j] > b)


def test_pairs_of_texts_with_other_beginnings(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        t = make(12000, rng)
        texts += [t, make(600, rng) + t[600:]]
    prints = [r.fingerprint for r in prints_of(spark, texts).collect()]
    want = set(brute_pairs(prints))
    got = {(r.a, r.b) for r in e.similar_pairs(spark.createDataFrame([(p,) for p in prints], "fingerprint string")).collect()}
    print("recall", len(got & want), len(want))
    assert len(want) >= 15 and got <= want and len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("block", [1024, 3])
def test_all_pairs_of_groups(spark, block):
    rng = random.Random(8)
    texts = ["", "a", "ab", *(make(n, rng) for n in (5, 9, 14, 18, 40))]
    for n in (6, 15, 40, 300, 2500):  # all begin alike, so that a bucket holds several groups
        head = make(n // 2, rng)
        for _ in range(3):
            t = head + make(n - n // 2, rng)
            for _ in range(6):
                at = rng.randrange(n)
                texts.append(t[:at] + rng.choice("abcdefgh") + t[at + 1 :])
    prints = [r.fingerprint for r in prints_of(spark, texts).collect()]
    want = set(brute_pairs(prints))
    got = [(r.a, r.b) for r in e.similar_pairs(spark.createDataFrame([(p,) for p in prints], "fingerprint string"), block=block).collect()]
    print("recall", len(set(got) & want), len(want))
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("id_type", ["string", "long", "int", "date"])
def test_parts_of_other_ids(spark, id_type):
    """Ids of any type; most rows have one id or none, so only their texts deal them to parts."""
    rng = random.Random(12)
    make_id = {"string": lambda k: f"doc {k:03d}", "date": lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k)}.get(id_type, lambda k: k)
    texts = [make(60, rng) for _ in range(300)]
    rows = [(None if k % 3 == 0 else make_id(7 if k % 3 == 1 else k), t) for k, t in enumerate(texts)] + [(make_id(1), "same"), (make_id(1), "same"), (None, None)]
    df = spark.createDataFrame(rows, f"doc_id {id_type}, text string").repartition(5)
    got = e.op5_edit_fingerprints(df, part_bytes=700).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else make_id(0), r[1].encode()))
    want = []
    for k, (i, t) in enumerate(order):
        m = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - m] + order[(k + 1) % len(order)][1][:m]).encode()).hexdigest()))
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)


def test_one_row_follows_itself(spark):
    got = e.op5_edit_fingerprints(spark.createDataFrame([(4, "abcdefgh", 1)], "doc_id long, text string, part int")).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in got] == [(4, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]


def test_long_text_among_parts(spark):
    rng = random.Random(13)
    rows = [(k, make(40, rng)) for k in range(30)] + [(15, make(60000, rng))]
    got = {r.n_chars: r for r in e.op5_edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=300, batch_chars=100).collect()}
    following = min((t for i, t in rows if i == 15 and t > rows[-1][1]), default=rows[16][1])  # of one id in the order of texts
    edited = rows[-1][1][:45000] + following
    assert set(got) == {40, 60000} and got[60000].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[60000].edited_fingerprint == walk(edited)
