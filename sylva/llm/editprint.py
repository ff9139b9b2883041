"""Document fingerprints by a randomised edit embedding.

All texts walk the same random walk: at step j a text at character c writes c and goes on to its next character if a bit
that depends on j and c alone says so. Texts at a small edit distance soon stand at the same characters again, so
edit distance becomes Hamming distance of what they write. A fingerprint samples this: of each octave of steps
(128 to 255, 256 to 511 and so on; the first has 128 steps) it keeps one bit of what is written at 128 shared steps, and
the step at which the text ended. The likeness of two fingerprints weighs the octaves by their steps: agreeing bits
less the half that agrees by chance; steps after the end of just one text count as different.

Near duplicates: bands of sampled bits find candidates, likeness verifies them (similar_pairs).

A null text is empty, its fingerprint ends at step 0; two empty texts are alike (1). Rows with equal doc_id follow
each other in the order of their texts. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import cut, drop_cut, partitions_for
from sylva.llm.hashing import mix

_SAMPLES, _BLOCK, _CLASSES = 128, 128, 64
_PAD = _CLASSES  # the class of what stands after a text


def classes(text: str) -> np.ndarray:
    """Code points as 64 classes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return (mix(points + np.uint64(77)) & np.uint64(_CLASSES - 1)).astype(np.uint8)


def _octave(block: int) -> int:
    return block.bit_length()


def _tables(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the 128 steps of a block: advance by class, written bit by class, sampled steps, and their places."""
    steps = np.arange(block * _BLOCK, (block + 1) * _BLOCK, dtype=np.uint64)
    shifts = np.arange(_CLASSES, dtype=np.uint64)
    go = np.zeros((_BLOCK, _CLASSES + 1), np.int64)
    bit = np.zeros((_BLOCK, _CLASSES + 1), np.uint8)
    go[:, :_CLASSES] = mix(steps * np.uint64(2) + np.uint64(1))[:, None] >> shifts & np.uint64(1)
    bit[:, :_CLASSES] = mix(steps * np.uint64(2) + np.uint64(2))[:, None] >> shifts & np.uint64(1)
    k = _octave(block)
    places = sampled_steps(k)
    own = np.flatnonzero((places >= block * _BLOCK) & (places < (block + 1) * _BLOCK))
    return go, bit, places[own] - block * _BLOCK, own + k * _SAMPLES


_sampled: dict[int, np.ndarray] = {}


def sampled_steps(octave: int) -> np.ndarray:
    """The 128 steps of an octave that fingerprints keep."""
    if octave not in _sampled:
        first, n = (0, _BLOCK) if octave == 0 else (_BLOCK << octave - 1, _BLOCK << octave - 1)
        _sampled[octave] = first + np.sort(np.random.default_rng(4242 + octave).choice(n, _SAMPLES, replace=False))
    return _sampled[octave]


class Walks:
    """Many texts on the walk at once. bits: texts x octaves * 128; ends: steps taken (3 for each character at most)."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.buffer = np.concatenate([x for t in texts for x in (t, _SENTINEL)]) if texts else np.zeros(0, np.uint8)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.limits = 3 * self.sizes
        octaves = 1 + _octave(int(self.limits.max(initial=0)) // _BLOCK)
        self.bits = np.zeros((len(texts), octaves * _SAMPLES), np.uint8)
        self.ends = np.zeros(len(texts), np.int64)

    def run(self, joins: np.ndarray, positions: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Walk each text from block joins[i] at character positions[i].

        With marks, returns for each text the last block, and the character at its start, before character marks[i] was read.
        """
        finish = self.starts + self.sizes
        at = self.starts + positions
        seen_block, seen_at = joins.copy(), positions.copy()
        order = np.argsort(joins, kind="stable")
        waiting, block = 0, int(joins.min(initial=0))
        active = np.zeros(0, np.int64)
        while len(active) or waiting < len(order):
            if not len(active):
                block = max(block, int(joins[order[waiting]]))
            more = waiting + int(np.searchsorted(joins[order[waiting:]], block, side="right"))
            if more > waiting:
                active = np.concatenate((active, order[waiting:more]))
                waiting = more
                active = active[(at[active] < finish[active]) & (block * _BLOCK < self.limits[active])]
            if not len(active):
                block += 1
                continue
            if marks is not None:
                early = active[at[active] - self.starts[active] <= marks[active]]
                seen_block[early], seen_at[early] = block, at[early] - self.starts[early]
            go, bit, sampled, places = _tables(block)
            own, where = at[active], 0
            end, base = finish[active], block * _BLOCK
            last = np.zeros(len(active), np.int64)
            cap = np.minimum(self.limits[active] - base, _BLOCK)
            for j in range(_BLOCK):
                c = self.buffer[own]
                if where < len(sampled) and sampled[where] == j:
                    live = j < cap
                    self.bits[active, places[where]] = np.where(live, bit[j][c], 0)
                    where += 1
                own = own + go[j][c]
                last += own < end  # steps before the one that ended the text
            at[active] = own
            self.ends[active] = base + np.minimum(cap, np.minimum(last + 1, _BLOCK))
            block += 1
            active = active[(at[active] < finish[active]) & (block * _BLOCK < self.limits[active])]
        return seen_block, seen_at


_SENTINEL = np.full(1, _PAD, np.uint8)


def _blank(bits: np.ndarray, ends: np.ndarray) -> None:
    """Bits at and after the end are 0."""
    for k in range(bits.shape[1] // _SAMPLES):
        part = bits[:, k * _SAMPLES : (k + 1) * _SAMPLES]
        part[sampled_steps(k)[None, :] >= ends[:, None]] = 0


def fingerprints(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, ends) of texts given as classes."""
    w = Walks(texts)
    zero = np.zeros(len(texts), np.int64)
    w.run(zero, zero)
    _blank(w.bits, w.ends)
    return w.bits, w.ends


def fingerprints_with_edits(texts: list[np.ndarray], edited: list[np.ndarray], same: np.ndarray):
    """Those of texts, and of the first edited ones, which equal their texts in the first same[i] characters."""
    w, e = Walks(texts), Walks(edited)
    zero, n = np.zeros(len(texts), np.int64), len(edited)
    marks = np.concatenate((same, np.zeros(len(texts) - n, np.int64)))
    blocks, places = (x[:n] for x in w.run(zero, zero, marks))
    width = min(w.bits.shape[1], e.bits.shape[1])
    e.bits[:, :width] = w.bits[:n, :width]  # what stands before the block of the mark is the same
    for k in range(e.bits.shape[1] // _SAMPLES):
        e.bits[:, k * _SAMPLES : (k + 1) * _SAMPLES][sampled_steps(k)[None, :] >= (blocks * _BLOCK)[:, None]] = 0
    e.ends[:] = np.minimum(w.ends[:n], blocks * _BLOCK)
    e.run(blocks, places)
    _blank(w.bits, w.ends)
    _blank(e.bits, e.ends)
    return (w.bits, w.ends), (e.bits, e.ends)


def to_strings(bits: np.ndarray, ends: np.ndarray) -> list[str]:
    """The end in hexadecimal, a colon, and the bits of the octaves that began."""
    packed = np.packbits(bits, axis=1)
    return [f"{end:x}:" + row[: (1 + _octave(max(0, end - 1) // _BLOCK)) * _SAMPLES // 8 if end else 0].tobytes().hex() for end, row in zip(ends.tolist(), packed, strict=True)]


def from_string(fingerprint: str) -> tuple[np.ndarray, int]:
    end, _, bits = fingerprint.partition(":")
    return np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8)), int(end, 16)


def likeness(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Of each row of a to the row of b, from 0 to 1."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most, least = np.maximum(a_ends, b_ends), np.minimum(a_ends, b_ends)
    total, weights = np.zeros(len(a)), np.zeros(len(a))
    for k in range(width // _SAMPLES):
        steps = sampled_steps(k)
        first, n = (0, _BLOCK) if k == 0 else (_BLOCK << k - 1, _BLOCK << k - 1)
        weight = np.clip(most - first, 0, n).astype(np.float64)
        both, either = (steps[None, :] < least[:, None]), (steps[None, :] < most[:, None]).sum(axis=1)
        part = slice(k * _SAMPLES, (k + 1) * _SAMPLES)
        n_both = both.sum(axis=1)
        agree = ((a[:, part] == b[:, part]) & both).sum(axis=1)
        alike = np.where(n_both > 0, np.maximum(0.0, 2 * agree - n_both), 0.0) / np.maximum(1, either)
        weight = np.where(either > 0, weight, 0.0)
        total += weight * alike
        weights += weight
    return np.where(weights > 0, total / np.where(weights > 0, weights, 1), (a_ends == b_ends).astype(np.float64))


def fingerprint_df(df: DataFrame, text: str = "text", out: str = "fingerprint", rows: int = 2000) -> DataFrame:
    """df with the fingerprint of each text."""
    fields = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` string"])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                part = batch.slice(k, rows)
                prints = to_strings(*fingerprints([classes(t or "") for t in part.column(text).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(prints, pa.string())], [*(f.name for f in fields), out])

    return df.mapInArrow(run, schema)


def _keys(bits: np.ndarray, end: int, orders: list[np.ndarray], bands: int, band_bits: int, least: float) -> np.ndarray:
    """The band keys of a fingerprint: each band of an octave takes the first live samples in an order of its own.

    An octave with fewer live samples gives none, but for the first: there the bands of short texts are of half as many
    bits, a quarter and so on; a text has all those that a text of a likeness of `least` could have, too.
    """
    out = []
    for k in range(len(bits) // _SAMPLES):
        live = int(np.searchsorted(sampled_steps(k), end))
        order, part = orders[k], bits[k * _SAMPLES : (k + 1) * _SAMPLES].astype(np.int64)
        for level in range(1 if k else band_bits.bit_length()):
            n = band_bits >> level
            if live < n or level and live * least >= 2 * n + 2:
                continue
            picks = order[order < live].reshape(bands, live)[:, :n]
            place = (k * 64 + level) * bands + np.arange(bands)
            out.append((place << band_bits) + (part[picks] << np.arange(n)).sum(axis=1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def similar_pairs(prints: DataFrame, least: float = 0.8, bands: int = 32, band_bits: int = 24, block: int = 1024) -> DataFrame:
    """(a, b, likeness): pairs of different fingerprints with a common band, a > b, verified.

    prints has a column fingerprint. Equal fingerprints are one. Each octave that a text has gives `bands` bands: if the likeness
    is at least `least`, that of one octave is. All members of a bucket are compared, in pairs of blocks of about `block`
    members, so a large bucket is many join keys. Buckets join 64-bit numbers of fingerprints; a pair is verified once.
    """

    def band(batches):
        orders: list[np.ndarray] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, p in zip(part.column("id").to_pylist(), part.column("fingerprint").to_pylist(), strict=True):
                    bits, end = from_string(p)
                    while len(orders) < len(bits) // _SAMPLES:
                        rng = np.random.default_rng(99 + len(orders))
                        orders.append(np.array([rng.permutation(_SAMPLES) for _ in range(bands)]))
                    hashes.append(_keys(bits, end, orders, bands, band_bits, least))
                    ids.append(np.full(len(hashes[-1]), i))
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(hashes), pa.int64()), "id": pa.array(np.concatenate(ids), pa.int64())})

    def verify(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                value = likeness(*_rows(part.column("a").to_pylist()), *_rows(part.column("b").to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value, pa.float64())], ["a", "b", "likeness"])

    # ids are written before they are used: a repeated task can't deal others
    own = cut(prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct().select(F.monotonically_increasing_id().alias("id"), "fingerprint"), "prints")
    hashed = cut(own.mapInArrow(band, "h long, id long"), "bands")
    blocks = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("m"))
    dealt = hashed.join(blocks, "h").withColumn("own", F.expr("int(pmod(xxhash64(id), m))")).withColumn("with", F.explode(F.expr("sequence(0, m - 1)")))
    dealt = cut(dealt.select("h", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id"), "blocks")
    drop_cut(hashed)
    other = dealt.select("h", "i", "j", F.col("own").alias("other"), F.col("id").alias("y"))
    # the members of one block meet in the pair of the block with itself alone; merge: buckets grow with the table
    pairs = dealt.join(other.hint("merge"), ["h", "i", "j"]).where("id < y AND (i = j OR own <> other)").select(F.col("id").alias("x"), "y").distinct()
    pairs = cut(pairs, "pairs")
    drop_cut(dealt)
    named = pairs.join(own.select(F.col("id").alias("x"), F.col("fingerprint").alias("p")).hint("merge"), "x").join(own.select(F.col("id").alias("y"), F.col("fingerprint").alias("q")).hint("merge"), "y")
    named = named.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b"))
    return named.mapInArrow(verify, "a string, b string, likeness double").where(F.col("likeness") >= least)


def _rows(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    read = [from_string(p) for p in prints]
    bits = np.zeros((len(read), max(len(b) for b, _ in read)), np.uint8)
    for row, (b, _) in zip(bits, read, strict=True):
        row[: len(b)] = b
    return bits, np.array([end for _, end in read])


def _row(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    bits, end = from_string(fingerprint)
    return bits[None, :], np.array([end])


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_OUT_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _OUT.split(", ")]


def _judge(ids: list, texts: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    """Rows of all but the last text, which is only next to the one before."""
    points = [classes(t) for t in texts]
    n = len(ids)
    edited, sha, same = [], [], np.zeros(n, np.int64)
    for i in range(n):
        m = len(texts[i]) // 4
        same[i] = len(texts[i]) - m
        edited.append(np.concatenate((points[i][: same[i]], points[i + 1][:m])))
        sha.append(hashlib.sha256((texts[i][: same[i]] + texts[i + 1][:m]).encode("utf-8", "surrogatepass")).hexdigest())
    (bits, ends), (e_bits, e_ends) = fingerprints_with_edits(points, edited, same)
    prints = to_strings(bits, ends)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, id_type), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(sha), pa.array(prints[:-1]), pa.array(to_strings(e_bits, e_ends)),
         pa.array(likeness(bits[:-1], ends[:-1], e_bits, e_ends)), pa.array(likeness(bits[:-1], ends[:-1], bits[1:], ends[1:]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _results(part: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.string()), *batch.columns], ["kind", "part", "text", *batch.schema.names])


def _edges(part: int, kind: int, doc_id: pa.Array, text: str) -> pa.RecordBatch:
    """A row that carries a text at the edge of a part; the columns of results are null."""
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string()), doc_id, *(pa.nulls(1, t) for t in _OUT_TYPES)], ["kind", "part", "text", "doc_id", *_OUT_NAMES])


def op5_edit_fingerprints(docs: DataFrame, part_bytes: int = 24 << 20, batch_chars: int = 16 << 20) -> DataFrame:
    """Fingerprints of each text and its edited text, whose end is taken from the next document's beginning.

    Documents are range-partitioned by doc_id (any type that has an order, nulls first) and the beginning of the text, so that rows
    of one id, or of none, are dealt by their texts; Spark samples the ranges. Rows of one id are in the order of their
    texts. Each part judges all its rows but the last, whose next text is the first one of the part that follows: both
    travel as rows of the written result and meet in a join on the part's number. The driver gets two numbers of parts.

    A null text is empty; an empty table gives no rows; repeated rows are next to each other; other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total, n_rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    id_name = docs.schema["doc_id"].dataType.simpleString()
    if not n_rows:
        return spark.createDataFrame([], f"doc_id {id_name}, {_OUT}")
    n = partitions_for(spark, total, part_bytes)
    order = F.asc_nulls_first("doc_id")
    rows = docs.repartitionByRange(n, order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")

    def run(batches):
        part, ids, texts, size, id_type = TaskContext.get().partitionId(), [], [], 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                if id_type is None:
                    id_type = some.column("doc_id").type
                    yield _edges(part, 1, some.column("doc_id").slice(0, 1), some.column("text")[0].as_py())
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                    if size > batch_chars and len(ids) > 1:
                        yield _results(part, _judge(ids[:-1], texts, id_type))
                        ids, texts, size = ids[-1:], texts[-1:], len(text)
        if len(ids) > 1:
            yield _results(part, _judge(ids[:-1], texts, id_type))
        if ids:
            yield _edges(part, 2, pa.array(ids[-1:], id_type), texts[-1])

    def close(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, text, following = (batch.column(c).slice(k, 1) for c in ("doc_id", "text", "following"))
                yield _judge(doc_id.to_pylist(), [text[0].as_py(), following[0].as_py()], doc_id.type)

    judged = cut(rows.mapInArrow(run, f"kind int, part int, text string, doc_id {id_name}, {_OUT}"), "prints")
    first, last = judged.where("kind = 1").agg(F.min("part"), F.max("part")).first()
    heads = judged.where("kind = 1").select(F.col("part").alias("to"), F.col("text").alias("following"))
    tails = judged.where("kind = 2").select("doc_id", "text", F.when(F.col("part") == last, F.lit(first)).otherwise(F.col("part") + 1).alias("to"))
    met = tails.join(heads.hint("merge"), "to", "left")
    met = met.withColumn("following", F.coalesce("following", F.raise_error(F.lit("a part between others has no rows")).cast("string")))
    edges = met.select("doc_id", "text", "following").mapInArrow(close, f"doc_id {id_name}, {_OUT}")
    return judged.where("kind = 0").select("doc_id", *_OUT_NAMES).unionAll(edges)
