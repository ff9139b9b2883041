"""Byte-level BPE and token files against the libraries themselves."""

import array
import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from sylva.llm import bytebpe, tokenfile  # noqa: E402
from sylva.llm.recent import Memo, Recent  # noqa: E402

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
CHARS = list("ab 'sdtmrelv\n\t\r   éßΣς漢字🙂́<|>\x1c\x7f\x85 　12٣.,;!") + [chr(c) for c in range(33, 0x250, 7)]


def odd_texts(n=1500):
    rng = random.Random(7)
    made = ["".join(rng.choice(CHARS if rng.random() < 0.5 else "abcdé.,' ") for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*made, "", " ", "  a", "a  ", "a \n b", "a\n b", "x" * 3000, "don't 'S", "<|endoftext|>", "ΑΣ Σ"]


def test_byte_bpe_equals_tiktoken():
    import tiktoken

    codec = bytebpe.codec(RANKS, P.PATTERN)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    texts = odd_texts()
    codec.warm(texts)
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == whole.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_model_is_a_sentencepiece_model():
    import sentencepiece

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b" a": 258}
    model = sentencepiece.SentencePieceProcessor(model_proto=bytebpe.model_proto(ranks))
    assert model.vocab_size() == 260 and model.encode("abc") == [257] and model.id_to_piece(258) == "Ġa"
    with pytest.raises(ValueError):
        bytebpe.model_proto({b"a": 1})


def test_op3_rows(spark):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (None, "é 漢")]
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n_tokens long, ids string")
    got = {(r.doc_id, r.decoded_sha256): r for r in bytebpe.op3_byte_bpe(df, RANKS, P.PATTERN).collect()}
    assert len(got) == 4
    for i, t in rows:
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        ids = bytebpe.codec(RANKS, P.PATTERN).encode(t or "").tolist()
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    coded = bytebpe.encode_df(df, RANKS, P.PATTERN)
    back = bytebpe.decode_df(coded, RANKS, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bytebpe.op3_byte_bpe(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_words_equal_the_library():
    w = tokenfile.words_of(WORDS)
    texts = odd_texts()
    for t, raw in zip(texts, w.encode_all(texts), strict=True):
        assert np.frombuffer(raw, w.kind).tolist() == w.library.encode(t, add_special_tokens=False).ids


def test_added_tokens_equal_a_fresh_library():
    from tokenizers import Tokenizer

    library, w = Tokenizer.from_file(WORDS), tokenfile.WordTokens(WORDS)
    ends = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|endof text|>"]
    texts = [f"{a}{e}{b}" for e in ends for a in ("", "hello ", "x", "é  ", "Don't\n") for b in ("", " world", "y.", "\u0338 z", f" {ends[0]}{e}")] + odd_texts()
    for t, raw in zip(texts, w.encode_all(texts), strict=True):
        assert np.frombuffer(raw, w.kind).tolist() == library.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(w.encode("hello <|endoftext|> world"), w.kind).tolist() == [3306, 49407, 1002]


@pytest.mark.parametrize("part_bytes", [1 << 20, 200])
def test_op4_files(spark, part_bytes):
    rng = random.Random(3)
    rows = [(rng.randrange(60), " ".join(rng.choice(["cat", "Dog", "Σας", "a\x1cb", "x."]) for _ in range(rng.randrange(9)))) for _ in range(80)] + [(None, "null id"), (5, None), (-9, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    from sylva.llm.common import new_dir

    folder = new_dir(spark, "tokens")
    manifest = tokenfile.write_tokens(df, folder, WORDS, 2, part_bytes)
    got = [tuple(r) for r in tokenfile.read_tokens(spark, folder, manifest).collect()]
    ids = [(i, tokenfile.words_of(WORDS).library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, array.array("H", x[1]).tobytes()))
    start, want = 0, []
    for i, x in ids:
        want.append((i, start, len(x), zlib.crc32(array.array("I", x).tobytes())))
        start += len(x)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokenfile.op4_token_files(df.limit(0), WORDS).count() == 0


def test_memos_are_bounded():
    made = []
    memo = Recent(lambda keys: made.extend(keys) or [k * 2 for k in keys], 10)
    single = Memo(lambda key: made.append(key) or key * 2, 10)
    for k in range(100):
        key = str(k % 30)
        assert memo[key] == single[key] == key * 2
    memo.fill({str(k) for k in range(25)})
    assert memo["3"] == "33" and len(memo.old) <= 25 and len(single) <= 10 and len(single.old) <= 10
    for m in (memo, single):  # a long key is made anew each time
        assert m["x" * 300] == "x" * 600 and "x" * 300 not in m


def test_very_long_text_without_spaces():
    words, text = tokenfile.words_of(WORDS), "abc" * 400_000 + "é" * 100
    before = len(words.words)
    assert len(words.encode(text)) > 0 and len(words.words) == before
