"""Sum-of-squares packing against a plain version, and its rows against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from sylva.llm import sumsquares  # noqa: E402

WORDS = P.path("word_bpe_49k.json")


def plain(lengths, size):
    """Sequences (lists of document numbers) of documents that fit in a window each, by trying every window."""
    done, windows = [], []
    for k, n in enumerate(lengths):
        best = None
        for w in [None, *windows]:
            fill = sum(lengths[i] for i in w) if w is not None else 0
            if fill + n > size:
                continue
            after = [sum(lengths[i] for i in x) for x in windows if x is not w] + [fill + n]
            squares = sum(c * c for level, c in Counter(after).items() if level < size)
            if best is None or (squares, -fill) < best[:2]:
                best = squares, -fill, w
        # of the windows of a level the one that reached it last
        w = best[2]
        if w is None:
            windows.append([k])
        else:
            fill = -best[1]
            w = [x for x in windows if sum(lengths[i] for i in x) == fill][-1]
            windows = [x for x in windows if x is not w] + [[*w, k]]
        if sum(lengths[i] for i in windows[-1]) == size:
            done.append(windows.pop())
    return done, windows


@pytest.mark.parametrize("seed", range(6))
def test_packer_equals_trying_every_window(seed):
    rng = random.Random(seed)
    size = rng.choice([8, 16, 23])
    lengths = [rng.randint(1, size if seed % 2 else size // 2) for _ in range(150)]
    packer, got = sumsquares.Packer(size), []
    for k, n in enumerate(lengths):
        got += [[x[0][0] for x in w] for w in packer.add((k, n), np.arange(n))]
    done, still = plain(lengths, size)
    assert got == done
    assert sorted(sorted(x[0][0] for x in w) for level in packer.open for w in level) == sorted(sorted(w) for w in still)
    assert packer.counts.tolist() == [len(x) for x in packer.open] and packer.n_open == len(still)


@pytest.mark.parametrize("most_open", [3, 4096])
def test_every_id_is_in_one_place_and_nothing_is_padded(most_open):
    rng = random.Random(most_open)
    size = 64
    lengths = [rng.choice([33, 34, 40, 1, 200]) for _ in range(500)]
    packer, windows = sumsquares.Packer(size, most_open), []
    for k, n in enumerate(lengths):
        windows += packer.add((k, n), np.arange(n))
        assert packer.n_open <= most_open
    windows += packer.close(last=True)
    seen = defaultdict(list)
    for w in windows:
        n = sum(len(x[2]) for x in w)
        assert 0 < n <= size and (n == size or n & n - 1 == 0)
        for (k, _), start, ids in w:
            assert len(ids) and ids.tolist() == list(range(start, start + len(ids)))
            seen[k] += ids.tolist()
    assert all(sorted(seen[k]) == list(range(n)) for k, n in enumerate(lengths))
    assert sum(sum(len(x[2]) for x in w) < size for w in windows) <= 6  # powers of two under 64
    assert list(packer.close(last=True)) == []


def test_op13_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    words = "the cat and a dog with houses, trees. Über naïve 12 it's".split()
    long_text = " ".join(rng.choice(words) for _ in range(9000))
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 400)))) for k in range(200)]
    rows += [(200, None), (201, ""), (202, long_text), (203, "x" * 20_000), (7, rows[7][1]), (None, "a null id"), (None, None)]
    df = spark.createDataFrame([(i, t, i, "x", 1) for i, t in rows], "doc_id long, text string, start long, ids string, sequence_id int").repartition(3)
    got = sumsquares.op13_sum_of_squares(df, WORDS).collect()

    def ids(text):
        return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")

    whole = defaultdict(list)
    for r in got:
        whole[r.doc_id].append(r)
    expected = defaultdict(list)
    for i, t in rows:
        expected[i].append(ids(t))
    assert whole.keys() == expected.keys()
    for i, texts in expected.items():
        want = Counter()
        for r in whole[i]:
            fits = [x for x in texts if len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32]
            assert fits
            want[r.doc_tokens] += r.length
        assert sum(want.values()) == sum(len(x) for x in texts)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        ends = [0]
        for r in s:
            assert r.offset == ends[-1] and r.length > 0
            ends.append(r.offset + r.length)
        assert s[0].sequence_tokens == ends[-1] and (ends[-1] == 2048 or ends[-1] < 2048 and ends[-1] & ends[-1] - 1 == 0)
    assert sumsquares.op13_sum_of_squares(df.limit(0), WORDS).collect() == []
    named = sumsquares.op13_sum_of_squares(df.selectExpr("concat('d', doc_id) AS doc_id", "text"), WORDS)
    assert {r.doc_id for r in named.collect()} == {None if i is None else f"d{i}" for i, _ in rows}
