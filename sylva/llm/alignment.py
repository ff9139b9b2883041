"""Alignment of two tokenizers over the same bytes: groups, links, and how usual each link is in the corpus.

A is a byte-level BPE (tokenizers library), B a sentencepiece BPE with byte fallback; both encode a space and the text. Byte
offsets where a token of A and one of B both end cut the tokens into groups, found by two pointers over the cumulative
ends. Every A and B token of a group are linked.

A space between a character other than a space and one that isn't white space begins a new pre-token of A and a new
piece of B (no piece has U+2581 after another character, which is checked), so texts are cut there and each different
chunk is aligned once for a task; a chunk whose bytes differ, or with a group of very many links, sends its text
through the libraries whole.

mapInPandas gives a row for each document with its different pairs and how often each occurs. Spark counts the documents of each
pair, takes each A id's and each B id's highest count, and joins both back to the documents' pairs: by broadcast if there are at most
`most_pairs` pairs (checked by a count), else by a shuffle, where AQE splits pairs that many documents have.

Rows whose text is null or empty, or whose bytes either tokenizer doesn't give back, have no tokens: zeros. Repeated rows
count as documents each; doc_id may be null and of any type that can be cast to a string and back. An empty table gives an empty
result. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.bytebpe import byte_letters
from sylva.llm.common import cut, drop_cut
from sylva.llm.recent import Recent

#: The pre-tokens of byte-level BPE, a fixed value of the format.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every version of the libraries' tables has in the same classes.
_PLAIN = re.compile("[\n -~¡-ɏ]*").fullmatch
_SPACES = re.compile(r" \s").search
#: Links of one group beyond which pairs are counted by different ids.
_MANY = 4096
_NONE = (0, 0, "", b"")


def groups_of(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups as (first A token, end, first B token, end) of two lists of cumulative ends with the same last one."""
    out, i, j, a, b = [], 0, 0, 0, 0
    while i < len(ends_a):
        x, y = ends_a[i], ends_b[j]
        i += x <= y
        j += y <= x
        if x == y:
            out.append((a, i, b, j))
            a, b = i, j
    return out


def _ends(lengths: list[int], ids: list[int]) -> list[int]:
    out, at = [], 0
    for i in ids:
        at += lengths[i]
        out.append(at)
    return out


class Aligner:
    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: k for k, c in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in vocabulary.items():
            self.bytes_a[k] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that go over a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = [[len(x) for x in table] for table in (self.bytes_a, self.bytes_b)]
        self.length_a, self.length_b = np.array(self.lengths_a, np.int64), np.array(self.lengths_b, np.int64)
        # ids as decimals with a mark: inside a group, after A's ids, after a group, after a chunk
        self.said = np.array([[f"{k}{mark}" for mark in ",|;\n"] for k in range(max(len(self.lengths_a), len(self.lengths_b)))], object)
        # merges in the order of their tokens' ids: the library's own ids, by ranks
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranked = [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged)))
        self.quick = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary if ranked else None
        self.chunks = Recent(self._align_chunks, 300_000)

    def _ids_a(self, text: str) -> list[int]:
        text = " " + text
        if self.quick and len(text) < 500 and _PLAIN(text):
            return self.quick(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode("utf-8", "replace")
        return b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])

    def _align_chunks(self, chunks: list[str]) -> list[tuple]:
        """(A tokens, B tokens, groups as text, pairs as 64-bit integers) of each chunk; _NONE where the whole text must be seen.

        The pointers go over all chunks' ends at once: their bytes are one run, in which every chunk's end is an end of both.
        """
        a, b = [self._ids_a(c) for c in chunks], self.b.encode(chunks, num_threads=1)
        same = [self._same(c, x, y) for c, x, y in zip(chunks, a, b, strict=True)]
        if not all(same):
            return self._align_some(chunks, same)
        if not chunks:
            return []
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        ids_a, ids_b = np.array([i for x in a for i in x], np.int64), np.array([i for x in b for i in x], np.int64)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        # groups end where ends meet; at[g] is a group's first token
        last_a, last_b = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True)), np.flatnonzero(np.isin(ends_b, ends_a, assume_unique=True))
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        chunk_end = np.searchsorted(last_a, np.cumsum(n_a) - 1)  # the last group of each chunk
        most = np.maximum.reduceat(size_a * size_b, np.concatenate(([0], chunk_end[:-1] + 1)))
        if most.max() > _MANY:
            return self._align_some(chunks, (most <= _MANY).tolist())
        links = self._links(ids_a, ids_b, size_a, size_b)
        link_end = np.cumsum(size_a * size_b)[chunk_end]
        raw, said, at, out = links.tobytes(), self._say(ids_a, ids_b, last_a, last_b, size_a, size_b, chunk_end), 0, []
        for x, y, text, end in zip(n_a.tolist(), n_b.tolist(), said, (link_end * 8).tolist(), strict=True):
            out.append((x, y, text, raw[at:end]))
            at = end
        return out

    def _align_some(self, chunks: list[str], fit: list[bool]) -> list[tuple]:
        found = iter(self._align_chunks([c for c, ok in zip(chunks, fit, strict=True) if ok]))
        return [next(found) if ok else _NONE for ok in fit]

    @staticmethod
    def _links(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Each group's pairs, A token by A token."""
        times = np.repeat(size_b, size_a)  # of each A token
        first_b = np.repeat(np.cumsum(size_b) - size_b, size_a)
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(ids_a, times) << 32 | ids_b[np.repeat(first_b, times) + place]

    def _say(self, ids_a, ids_b, last_a, last_b, size_a, size_b, chunk_end) -> list[str]:
        """Each chunk's groups as text: ids with the mark that follows them, put in order and joined once."""
        words_a, words_b = self.said[ids_a, 0], self.said[ids_b, 0]
        words_a[last_a] = self.said[ids_a[last_a], 1]
        words_b[last_b] = self.said[ids_b[last_b], 2]
        words_b[last_b[chunk_end]] = self.said[ids_b[last_b[chunk_end]], 3]
        out = np.empty(len(ids_a) + len(ids_b), object)
        before_b, before_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        out[np.arange(len(ids_a)) + np.repeat(before_b, size_a)] = words_a
        out[np.arange(len(ids_b)) + np.repeat(before_a, size_b)] = words_b
        return "".join(out.tolist()).split("\n")[:-1]

    def cut(self, text: str) -> list[str]:
        """The text's chunks; the space before each but the first isn't in it."""
        if _SPACES(text) or text[0] == " " or text[-1] == " ":
            return re.split(r"(?<=[^ ]) (?=\S)", text)
        return text.split(" ")

    def warm(self, texts: list[str]) -> None:
        self.chunks.fill(set().union(*(self.cut(t) for t in texts if t)))

    def align(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """A tokens, B tokens, groups, the groups as text, different pairs (A id times 2^32 plus B id) and how often each occurs."""
        if text:
            n_a, n_b, said, links = zip(*map(self.chunks.__getitem__, self.cut(text)), strict=True)
            if all(n_a):
                pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
                groups = ";".join(said)
                return sum(n_a), sum(n_b), groups.count(";") + 1, groups, pairs, times
        return self._align_whole(text)

    def _align_whole(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        a, b = (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        if not a or not self._same(text, a, b):
            return 0, 0, 0, "", none, none
        said, pairs, times, few = [], [], [], []
        for i, k, j, m in groups_of(_ends(self.lengths_a, a), _ends(self.lengths_b, b)):
            said.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            if (k - i) * (m - j) > _MANY:
                (x, n), (y, o) = np.unique(np.array(a[i:k], np.int64), return_counts=True), np.unique(np.array(b[j:m], np.int64), return_counts=True)
                pairs.append((x[:, None] << 32 | y).ravel())
                times.append((n[:, None] * o).ravel())
            else:
                few += [x << 32 | y for x in a[i:k] for y in b[j:m]]
        pairs.append(np.array(few, np.int64))
        times.append(np.ones(len(few), np.int64))
        different, at = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(different), np.int64)
        np.add.at(total, at, np.concatenate(times))
        return len(a), len(b), len(said), ";".join(said), different, total


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker."""
    return Aligner(a_path, b_path)


def align_df(docs: DataFrame, a_path: str, b_path: str, slice_chars: int = 2 << 20, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each row, and with `groups` the groups as text."""

    def run(frames):
        own = aligner(a_path, b_path)
        for frame in frames:
            ids, texts = frame["doc_id"].tolist(), [t or "" for t in frame["text"].tolist()]
            sizes = np.cumsum([len(t) for t in texts])
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + slice_chars, side="right")))
                own.warm(texts[a:b])
                found = [own.align(t) for t in texts[a:b]]
                out = {
                    "doc_id": ids[a:b], "n_a": [x[0] for x in found], "n_b": [x[1] for x in found], "n_groups": [x[2] for x in found], "n_links": [int(x[5].sum()) for x in found],
                    "groups_sha256": [hashlib.sha256(x[3].encode()).hexdigest() if x[0] else "" for x in found], "pairs": [x[4] for x in found], "times": [x[5] for x in found],
                }
                yield pd.DataFrame(out | ({"groups": [x[3] for x in found]} if groups else {}))
                a = b

    kind = docs.schema["doc_id"].dataType
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * groups
    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, b, n_docs, and whether that count is the highest of the A id (best_a) and of the B id (best_b)."""
    counts = cut(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")), "counts")
    sides = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n_docs")
    for side in ("a", "b"):
        most = sides.groupBy(side).agg(F.max("n_docs").alias("most"))  # a row for each id of a vocabulary
        sides = sides.join(most, side).withColumn(f"best_{side}", F.col("n_docs") == F.col("most")).drop("most")
    out = cut(sides.select("pair", "a", "b", "n_docs", "best_a", "best_b"), "pairs")
    drop_cut(counts)
    return out


def alignment(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = 1_500_000) -> DataFrame:
    """Of each row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_best_b."""
    aligned = cut(align_df(docs, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    pairs = pair_counts(aligned)
    looked_up = pairs.select("pair", "n_docs", "best_a", "best_b")
    if pairs.count() <= most_pairs:
        looked_up = F.broadcast(looked_up)
    links = aligned.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    sums = links.join(looked_up, "pair").groupBy("_row").agg(
        F.expr("sum(IF(best_a, times, 0L))").alias("n_best"), F.expr("sum(times * n_docs)").alias("count_sum"), F.expr("sum(IF(best_b, times, 0L))").alias("n_best_b")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = aligned.select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "_row", "left")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_b"))


def op11_token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return alignment(docs, a_path, b_path)
