"""Byte-level BPE on the sentencepiece library, its model built from a rank file.

The model is serialised here, field by field: each token's bytes mapped to printable characters make a piece whose
score is the negative rank, so that the library's best-score merge is the lowest-rank merge. Normalisation is the
identity. A text is cut into pre-tokens by the pattern, each pre-token is encoded for itself (a pre-token that is
a token as a whole is that token), and decoding maps ids back to bytes.

Null and empty texts give no ids. Repeated rows and ties need no rule, as each row is encoded for itself. An empty
table gives an empty result, and only doc_id and the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.recent import Recent


def byte_letters() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, a float is 32 bits, an int is a varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    unknown = "<unk>"
    pieces = ["".join(letters[b] for b in token) for token, _ in by_rank]
    while unknown in set(pieces):
        unknown += " "
    rows = [_field(1, _field(1, piece.encode()) + _field(2, -float(k)) + _field(3, 1)) for k, piece in enumerate(pieces)]
    rows.append(_field(1, _field(1, unknown.encode()) + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(rows)) + _field(40, len(pieces)) + b"".join(_field(k, none) for k in (41, 42, 43)) + _field(45, unknown.encode())
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(rows) + _field(2, trainer) + _field(3, normal)


class ByteBPE:
    """encode() and decode() of one vocabulary; ids are ranks."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.letters = dict(enumerate(byte_letters()))
        self.cut = regex.compile(pattern).findall
        self.kind = np.dtype("<u2" if len(ranks) <= 1 << 16 else "<u4")
        tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        #: (ids as bytes, ids as decimals) of a text's part up to the next single space, without and with a space before it
        self.first = Recent(lambda parts: self._parts(parts, ""), 20_000)
        self.later = Recent(lambda parts: self._parts(parts, " "), 700_000)

    def _encode_cut(self, cuts: list[list[str]]) -> list[list[int]]:
        """Ids of texts that are cut into pre-tokens; each different pre-token goes to the library once."""
        ids = {p: p.encode("utf-8", "replace") for c in cuts for p in c}
        rest = []
        for p, raw in ids.items():
            whole = self.ranks.get(raw)
            if whole is None:
                rest.append(p)
            else:
                ids[p] = (whole,)
        mapped = [ids[p].decode("latin-1").translate(self.letters) for p in rest]
        ids.update(zip(rest, self.model.encode(mapped, num_threads=1), strict=True))
        return [[i for p in c for i in ids[p]] for c in cuts]

    def _parts(self, parts: list[str], before: str) -> list[tuple[bytes, str]]:
        # white space beside the space between parts: the pattern must see both sides, so there's no entry
        return [self._both(x) for x in self._encode_cut([[] if not p or p[0].isspace() or p[-1].isspace() else self.cut(before + p) for p in parts])]

    def _both(self, ids: list[int]) -> tuple[bytes, str]:
        return array(self.kind.char, ids).tobytes(), " ".join(map(str, ids))

    def warm(self, texts: list[str]) -> None:
        """Encode the unknown parts of many texts in few calls."""
        self.later.fill(set().union(*(t.split(" ")[1:] for t in texts)))

    def encode_raw(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned integers of self.kind, and as decimals joined by a space."""
        if not text:
            return b"", ""
        # a single space between other characters always begins a pre-token, so parts can be encoded each for itself
        parts = text.split(" ")
        found = [self.first[parts[0]], *map(self.later.__getitem__, parts[1:])]
        raw = [x[0] for x in found]
        if all(raw):
            return b"".join(raw), " ".join([x[1] for x in found])
        return self._both(self._encode_cut([self.cut(text)])[0])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_raw(text)[0], self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes in a row, gathered from one table."""
        if not len(ids):
            return b""
        ids = np.asarray(ids).astype(np.int64)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.blob[at].tobytes()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(ranks_path, pattern)


def texts(batch: pa.RecordBatch, name: str = "text", size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about size bytes (a row at least) and their texts, so that few texts are in Python at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        part = batch.slice(a, b - a)
        yield part, [t or "" for t in part.column(name).to_pylist()]
        a = b


def encode_df(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of ids (array<int>)."""
    spare = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in spare), f"`{out}` array<int>"])

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for part, ts in texts(batch, text):
                own.warm(ts)
                ids = pa.array([own.encode(t).astype(np.int32) for t in ts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in spare), ids], [*(f.name for f in spare), out])

    return df.mapInArrow(run, schema)


def decode_df(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded bytes; null ids give null."""
    spare = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in spare), f"`{out}` binary"])

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            raw = pa.array([None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in spare), raw], [*(f.name for f in spare), out])

    return df.mapInArrow(run, schema)


def op3_byte_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs."""

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for part, ts in texts(batch):
                own.warm(ts)
                counts, ids_sha, out_sha = [], [], []
                for t in ts:
                    raw, decimals = own.encode_raw(t)
                    ids = np.frombuffer(raw, own.kind)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(decimals.encode()).hexdigest())
                    out_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
