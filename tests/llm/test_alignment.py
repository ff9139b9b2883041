"""Alignment of two tokenizers against the libraries on whole texts and a plain version of groups and links."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

P = pytest.importorskip("public_tokenizers")

from sylva.llm import alignment  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
CHARS = list("ab 'sdtmrelv\n\t\r   éßΣς漢字🙂́<|>\x1c\x7f\x85\xa0 　12٣.,;!▁\x00½ﬁ") + [chr(c) for c in range(33, 0x250, 7)]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = {}
    for k, b in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)]):
        letters[chr(b)] = b
    for k, b in enumerate(b for b in range(256) if b not in letters.values()):
        letters[chr(256 + k)] = b
    return a, sentencepiece.SentencePieceProcessor(model_file=B), letters


def plain(libraries, text):
    """Groups of (A ids, B ids) of a whole text, by sets of ends; none where the bytes differ."""
    a, b, letters = libraries
    if not text:
        return []
    raw, x, y = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    ends = [{e: k + 1 for k, e in enumerate(accumulate(map(len, t)))} for t in (bytes_a, bytes_b)]
    both, out, p, q = sorted(ends[0].keys() & ends[1].keys()), [], 0, 0
    for e in both:
        out.append((x[p : ends[0][e]], y[q : ends[1][e]]))
        p, q = ends[0][e], ends[1][e]
    return out


def odd_texts(n):
    rng = random.Random(11)
    made = ["".join(rng.choice(CHARS if rng.random() < 0.4 else "abcdé.,' ") for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*made, " ", "  a", "a  ", "a \n b", "a\n b", "a  b   c", " a", "a ", "x" * 3000, "don't 'S re-do", "<|endoftext|> <s> </s> <unk> <0x41>", "\x1f\x01" * 300, " ".join(["x" * 500 + "é"] * 2), "naïve Ünï über Straße"]


def said(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_align_equals_whole_texts(libraries):
    own = alignment.aligner(A, B)
    texts = odd_texts(1200)
    own.warm(texts)
    for t in texts:
        groups = plain(libraries, t)
        n_a, n_b, n_groups, text, pairs, times = own.align(t)
        links = Counter(x << 32 | y for g in groups for x in g[0] for y in g[1])
        assert (n_a, n_b, n_groups, text) == (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), said(groups)), repr(t)
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == links


def test_a_group_of_many_links(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "_MANY", 3)
    own = alignment.Aligner(A, B)
    for t in odd_texts(200):
        links = Counter(x << 32 | y for g in plain(libraries, t) for x in g[0] for y in g[1])
        *_, text, pairs, times = own.align(t)
        assert text == said(plain(libraries, t)) and dict(zip(pairs.tolist(), times.tolist(), strict=True)) == links


@pytest.mark.parametrize("most_pairs", [0, 10**6])
def test_op11_rows(spark, libraries, most_pairs):
    rng = random.Random(4)
    words = "the cat and a dog with houses, trees. Über naïve 12 it's thonenou hawntion\n漢字 <|endoftext|>".split(" ")
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, "a▁b"), (203, "the cat " * 20_000), (7, rows[7][1]), (None, "a null id"), (None, None), (2**60 + 1, "x")]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n_a long, pair string").repartition(3)
    groups = [plain(libraries, t) for _, t in rows]
    links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for gs in groups]
    n_docs = Counter(p for own in links for p in own)
    most = [Counter(), Counter()]
    for p, n in n_docs.items():
        for k in (0, 1):
            most[k][p[k]] = max(most[k][p[k]], n)
    want = Counter(
        (i, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(own.values()), sum(n for p, n in own.items() if n_docs[p] == most[0][p[0]]), sum(n * n_docs[p] for p, n in own.items()),
         hashlib.sha256(said(gs).encode()).hexdigest() if gs else "", sum(n for p, n in own.items() if n_docs[p] == most[1][p[1]]))
        for (i, _), gs, own in zip(rows, groups, links, strict=True)
    )
    got = alignment.alignment(df, A, B, most_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert alignment.alignment(df.limit(0), A, B).collect() == []
    texts = alignment.align_df(df.where("doc_id < 5"), A, B, groups=True).select("doc_id", "groups").collect()
    assert {r.doc_id: r.groups for r in texts} == {i: said(gs) for (i, _), gs in zip(rows[:5], groups[:5], strict=True)}
