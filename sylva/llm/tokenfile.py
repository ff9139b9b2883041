"""Token ids as flat binary files with 64-bit document offsets, to be memory-mapped.

A data set is a folder with, for each part in ascending order of doc_id,
  part-K.bin   ids, little-endian unsigned 16-bit integers (32-bit where the vocabulary needs it), nothing else;
  part-K.idx   n + 1 little-endian unsigned 64-bit offsets in ids: document i of the part is ids[idx[i]:idx[i + 1]];
  part-K.doc   n little-endian signed 64-bit doc_ids (rows without doc_id come first, in part 0; their number is
               in the manifest);
and manifest.json: kind of integers, and for each part its documents and ids. The place of a part in the ids of the
whole set is the prefix sum of the parts before it.

Rows with equal doc_id are written in the order of their ids; null and empty texts are documents with the end id
alone. Parts of an empty table don't exist. A part is written to a name of its attempt and then moved, so a lost
or repeated task leaves whole files only. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.bytebpe import byte_letters, texts
from sylva.llm.common import new_dir, partitions_for
from sylva.llm.recent import Memo

#: White space to Python's split() that is not white space to the tokenizer's pattern.
_ODD = "\x1c\x1d\x1e\x1f"
#: Characters that NFC makes ASCII, so that an added token can come of them.
_TO_ASCII = "\u037e\u1fef\u212a"
#: Characters whose composed and lower-case forms don't depend on their neighbours or on the library's Unicode version.
_PLAIN = re.compile("[!-\u012f\u0131-\u024f]+").fullmatch


class WordTokens:
    """Ids of the tokenizers library. Its pieces never cross white space, so each different word is encoded once.

    A word of plain characters is lowered and cut here by the tokenizer's own pattern, and the library's model gets
    each different piece; any other word goes through the library's whole chain, and so do whole texts that may hold
    one of the vocabulary's added tokens.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            chain = json.load(f)
        added = chain.get("added_tokens", [])
        self.added = [x["content"] for x in added if not x["normalized"]]
        self.added_normal = [x["content"].lower() for x in added if x["normalized"]]
        steps = [x["type"] for part in ("normalizer", "pre_tokenizer") for x in chain[part].get("normalizers", chain[part].get("pretokenizers", []))]
        if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            raise ValueError(f"a chain that this class doesn't know: {steps}")
        self.cut = regex.compile(chain["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = dict(enumerate(byte_letters()))
        self.model, self.code = self.library.model.tokenize, self.kind.char
        self.pieces = Memo(self._piece, 150_000)
        self.words = Memo(self._word, 600_000)

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself among the letters for bytes
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word: letters are one piece, and so is a mark after them; what isn't plain takes the library's whole chain."""
        if not (word.isascii() or _PLAIN(word)):
            return self._whole(word)
        low = word.lower()
        if low.isalpha():
            return self._piece(low)  # remembered as a word
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join(map(self.pieces.__getitem__, self.cut(low)))

    def _whole(self, text: str) -> bytes:
        return array(self.kind.char, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _has_added(self, text: str) -> bool:
        """Whether the library may find an added token, in the text or in what its normaliser makes of it."""
        if any(x in text for x in self.added):
            return True
        if not self.added_normal:
            return False
        low = text.lower()
        return any(x in low for x in self.added_normal) or any(c in text for c in _TO_ASCII)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        odd = {k for k, t in enumerate(texts) if any(c in t for c in _ODD) or self._has_added(t)}
        words = [[] if k in odd else (t.lower() if t.isascii() else t).split() for k, t in enumerate(texts)]
        get = self.words.__getitem__  # a word that isn't there makes itself
        return [self._whole(texts[k]) if k in odd else b"".join(map(get, x)) for k, x in enumerate(words)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def words_of(path: str) -> WordTokens:
    return WordTokens(path)


def filesystem(path: str):
    """pyarrow's file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _put(fs, path: str, data: bytes) -> None:
    with fs.open_output_stream(path) as f:
        f.write(data)


class _Part:
    """Writes one part as its documents come; no more than a buffer of ids is in memory."""

    def __init__(self, fs, folder: str, k: int) -> None:
        self.fs, self.k, self.final = fs, k, f"{folder}/part-{k:05d}"
        self.name = f"{folder}/_attempt-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(f"{self.name}.bin", buffer_size=1 << 20)
        self.ends, self.docs, self.nulls = [0], [], 0

    def add(self, doc_id, raw: bytes, width: int) -> None:
        self.out.write(raw)
        self.ends.append(self.ends[-1] + len(raw) // width)
        self.nulls += doc_id is None
        self.docs.append(0 if doc_id is None else doc_id)

    def close(self) -> tuple[int, int, int, int]:
        self.out.close()
        _put(self.fs, f"{self.name}.idx", np.array(self.ends, "<u8").tobytes())
        _put(self.fs, f"{self.name}.doc", np.array(self.docs, "<i8").tobytes())
        for end in ("bin", "idx", "doc"):
            self.fs.move(f"{self.name}.{end}", f"{self.final}.{end}")
        return self.k, len(self.docs), self.nulls, self.ends[-1]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, part_bytes: int = 32 << 20) -> dict:
    """Encode docs (doc_id, text), write the files to folder, return the manifest.

    Parts are cut at quantiles of doc_id, of about part_bytes of text each. Only the encoded ids are shuffled. The
    driver gets one row for each part.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions_for(spark, total, part_bytes)
    cuts = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def encode(batches):
        own = words_of(tokenizer_path)
        end = np.array([end_id], own.kind).tobytes()
        for batch in batches:
            for part, ts in texts(batch):
                ids = part.column("doc_id").to_pylist()
                pid = np.searchsorted(cuts, [-(1 << 63) if x is None else x for x in ids], side="right")
                raw = [x + end for x in own.encode_all(ts)]
                yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), part.column("doc_id"), pa.array(raw, pa.binary())], ["pid", "doc_id", "ids"])

    fs, place = filesystem(folder)
    fs.create_dir(place, recursive=True)

    def write(batches):
        own, there = filesystem(folder)
        width, now = words_of(tokenizer_path).kind.itemsize, None
        done = lambda x: pa.RecordBatch.from_pydict({"pid": [x[0]], "n_docs": [x[1]], "n_nulls": [x[2]], "n_tokens": [x[3]]}, schema=pa.schema([("pid", pa.int32()), ("n_docs", pa.int64()), ("n_nulls", pa.int64()), ("n_tokens", pa.int64())]))
        for batch in batches:
            for k, doc_id, raw in zip(batch.column("pid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if now is None or now.k != k:
                    if now:
                        yield done(now.close())
                    now = _Part(own, there, k)
                now.add(doc_id, raw.as_py(), width)
        if now:
            yield done(now.close())

    encoded = docs.mapInArrow(encode, "pid int, doc_id long, ids binary")
    parts = encoded.repartition(n, "pid").sortWithinPartitions("pid", F.asc_nulls_first("doc_id"), "ids").mapInArrow(write, "pid int, n_docs long, n_nulls long, n_tokens long").collect()
    manifest = {"kind": words_of(tokenizer_path).kind.str, "parts": sorted([r.pid, r.n_docs, r.n_nulls, r.n_tokens] for r in parts)}
    _put(fs, f"{place}/manifest.json", json.dumps(manifest).encode())
    return manifest


def bases(manifest: dict) -> list[tuple[int, int, int, int]]:
    """(part, its documents without doc_id, documents and ids before it): exclusive prefix sums over the parts."""
    out, docs, ids = [], 0, 0
    for k, n_docs, n_nulls, n_ids in manifest["parts"]:
        out.append((k, n_nulls, docs, ids))
        docs, ids = docs + n_docs, ids + n_ids
    return out


class TokenPart:
    """A part of a data set, memory-mapped where the file system is a local one."""

    def __init__(self, folder: str, k: int, kind: str) -> None:
        from pyarrow import fs

        own, place = filesystem(folder)
        name = f"{place}/part-{k:05d}"
        if isinstance(own, fs.LocalFileSystem):
            load = lambda end, t: np.memmap(f"{name}.{end}", t, "r") if own.get_file_info(f"{name}.{end}").size else np.zeros(0, t)
        else:
            load = lambda end, t: np.frombuffer(own.open_input_file(f"{name}.{end}").read_buffer(), t)
        self.ends, self.docs, self.ids = load("idx", "<u8"), load("doc", "<i8"), load("bin", kind)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[int(self.ends[i]) : int(self.ends[i + 1])]


def read_tokens(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the files."""
    kind = manifest["kind"]

    def run(batches):
        for batch in batches:
            for k, nulls, base in zip(*(batch.column(c).to_pylist() for c in ("k", "nulls", "base")), strict=True):
                part = TokenPart(folder, k, kind)
                for a in range(0, len(part), 4096):
                    rows = range(a, min(a + 4096, len(part)))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([None if i < nulls else int(part.docs[i]) for i in rows], pa.int64()),
                        "start": pa.array([base + int(part.ends[i]) for i in rows], pa.int64()),
                        "n_tokens": pa.array([len(part[i]) for i in rows], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(part[i].astype("<u4").tobytes()) for i in rows], pa.int64()),
                    })

    rows = [(k, nulls, base) for k, nulls, _, base in bases(manifest)]
    parts = spark.createDataFrame(rows, "k int, nulls long, base long").repartition(max(1, len(rows)))
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs to the shared folder and read the files back."""
    folder = new_dir(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, tokenizer_path, end_id))
