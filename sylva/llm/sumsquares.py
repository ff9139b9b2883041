"""Sum-of-squares online packing of token ids into windows of one size.

Documents come in the order of their input split. The level array has, for each number of tokens from 1 to size - 1, how
many open windows hold so many. A document goes where the sum of the squares of these counts comes out least: into a
window of some level, or a new one; among equals into the fullest. A window that is full leaves. A document longer than a
window is cut into full windows and a rest, which is placed like any other.

At most `most_open` windows are open, so memory has a bound. If lengths that don't fit together (all over half a window,
say) open more, and at the end of a split, the open windows are closed: the fullest are filled up with pieces cut from
the emptiest, until one is left. At the end of the split that one is cut into windows whose lengths are powers
of two, as sequences of such lengths aren't padded. So no token of padding is left.

Splits are packed each for itself, with nothing shuffled and no state outside a task: a task that is lost is repeated from
its split and gives the same rows. sequence_id is the split's number times 2^40 and a number in it.

A null text is empty, and an empty text is the end id alone; repeated rows are packed each; a null doc_id stays null;
doc_id may be of any type. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.bytebpe import texts
from sylva.llm.tokenfile import words_of

#: A piece: its document (doc_id, tokens), where it begins there, and its ids.
Piece = tuple[tuple, int, np.ndarray]


def split_at(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces' first n ids and the rest; the piece over the place is cut."""
    held = 0
    for k, (doc, start, ids) in enumerate(pieces):
        if held + len(ids) > n:
            at = n - held
            return [*pieces[:k], *([(doc, start, ids[:at])] if at else [])], [(doc, start + at, ids[at:]), *pieces[k + 1 :]]
        held += len(ids)
    return pieces, []


def powers(n: int) -> list[int]:
    """The powers of two that n is the sum of, falling."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Open windows by level; full ones are returned as lists of pieces."""

    def __init__(self, size: int, most_open: int = 4096) -> None:
        self.size, self.most_open, self.n_open = size, most_open, 0
        self.counts = np.zeros(size + 1, np.int64)  # the level array; 0 and size stay 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def level(self, n: int) -> int:
        """The level of the window that n ids go to; 0: a new one."""
        counts, room = self.counts, self.size - n
        levels = np.flatnonzero(counts[: room + 1])
        if not len(levels):
            return 0
        # half the change of the sum of squares, less 1/2 for the level left and for the level reached (none: 0 and size)
        change = counts[levels + n] - counts[levels] + 1.0
        change[levels == room] -= 0.5
        k = len(levels) - 1 - int(np.argmin(change[::-1]))
        new = counts[n] + 0.5 if room else 0.0
        return int(levels[k]) if change[k] <= new else 0

    def _put(self, n: int, pieces: list[Piece]) -> None:
        self.counts[n] += 1
        self.open[n].append(pieces)
        self.n_open += 1

    def add(self, doc: tuple, ids: np.ndarray) -> Iterator[list[Piece]]:
        full = len(ids) // self.size * self.size
        for a in range(0, full, self.size):
            yield [(doc, a, ids[a : a + self.size])]
        n = len(ids) - full
        if not n:
            return
        at, pieces = self.level(n), []
        if at:
            pieces = self.open[at].pop()
            self.counts[at] -= 1
            self.n_open -= 1
        pieces.append((doc, full, ids[full:]))
        if at + n == self.size:
            yield pieces
        else:
            self._put(at + n, pieces)
            if self.n_open > self.most_open:
                yield from self.close()

    def close(self, last: bool = False) -> Iterator[list[Piece]]:
        """Fill open windows up with pieces of the emptiest ones until one is left; the last one goes as powers of two."""
        rest = [(n, w) for n in range(self.size, 0, -1) for w in self.open[n]]
        self.counts[:], self.open, self.n_open = 0, [[] for _ in range(self.size + 1)], 0
        first, end = 0, len(rest) - 1
        while first < end:
            n, window = rest[first]
            have, donor = rest[end]
            taken, left = split_at(donor, self.size - n)
            window = window + taken
            n += have if not left else self.size - n
            end -= not left
            if left:
                rest[end] = (have - sum(len(x[2]) for x in taken), left)
            if n == self.size:
                yield window
                first += 1
            else:
                rest[first] = (n, window)
        if first == end:
            n, window = rest[first]
            if not last:
                self._put(n, window)
                return
            for k in powers(n):
                part, window = split_at(window, k)
                yield part


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, most_open: int = 4096) -> DataFrame:
    """Each piece of each row: doc_id, start, length, ids (little-endian unsigned 32-bit integers), doc_tokens, sequence_id,
    offset and sequence_tokens (the sequence's length without padding)."""

    def run(batches):
        from pyspark import TaskContext

        own, packer = words_of(tokenizer_path), Packer(size, most_open)
        end, base, id_type, number = np.array([end_id], own.kind).tobytes(), TaskContext.get().partitionId() << 40, None, 0
        rows: tuple[list, ...] = ([], [], [], [], [], [], [], [])
        held = 0

        def add(window: list[Piece]) -> None:
            nonlocal number, held
            offset, total = 0, sum(len(x[2]) for x in window)
            for (doc_id, tokens), start, ids in window:
                for column, value in zip(rows, (doc_id, start, len(ids), ids.astype("<u4").tobytes(), tokens, base + number, offset, total), strict=True):
                    column.append(value)
                offset += len(ids)
            number, held = number + 1, held + total

        def flush() -> pa.RecordBatch:
            nonlocal held
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])
            for c in rows:
                c.clear()
            held = 0
            return out

        for batch in batches:
            for part, ts in texts(batch):
                id_type = part.column("doc_id").type
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), own.encode_all(ts), strict=True):
                    ids = np.frombuffer(raw + end, own.kind)
                    for window in packer.add((doc_id, len(ids)), ids):
                        add(window)
                    if held > 1 << 20:
                        yield flush()
        for window in packer.close(last=True):
            add(window)
            if held > 1 << 20:
                yield flush()
        if rows[0]:
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op13_sum_of_squares(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and sequence_tokens of each piece."""
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
