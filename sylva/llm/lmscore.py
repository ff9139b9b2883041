"""Language-model scores of all texts: context-tree weighting of bytes, and a unigram word model as the base.

Nothing of the model is collected or broadcast but what has a fixed size (65,536 entries for the contexts under two
bytes, 256 for each of at most 1024 heavy contexts of two bytes, and three totals). Texts are taken in blocks of some MB
where they are read. A block asks for its different byte strings of depth + 1 (grams) and its different words, with its
training counts of them; requests go to shards by the last two context bytes (words: by hash). The number of shards
grows with the texts' bytes, and a pair of bytes that takes more than half a shard's share is heavy: its grams are dealt
by three bytes. A shard adds up the counts of all blocks, weights its context trees and answers each block; a block's
answers and texts then meet once more. So what moves is a block's vocabulary, not its text length (a frequent gram
is one entry of a block), and the model grows with the corpus.

Rows whose crc32(doc_id as text) leaves 1 modulo 5 are held out of the counts. The score is the log10 probability of
the text's UTF-8 bytes, A-Z lowered, and one end symbol (byte FF, which UTF-8 never has; FF also stands before the
text). Words are told apart by a 64-bit hash. Grams of a very long text are made piece by piece. A null text is empty, a null doc_id counts as "" (training). Repeated
rows are scored each and counted each; an empty table gives an empty result; without training rows every base
probability is 1 and every bit costs one half. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm import ctw
from sylva.llm.common import cut, new_dir, remove
from sylva.llm.hashing import mix, word_hashes

_TOP = 2
_END = b"\xff"


def planes(x: np.ndarray) -> bytes:
    """An integer array, bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes())


def unplanes(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _deltas(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _undeltas(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, "<u8"), dtype=np.uint64)


def _shard_of(keys: np.ndarray, kind: str, depth: int, shards: int, heavy: np.ndarray) -> np.ndarray:
    context = keys
    if kind == "g":
        two = keys >> np.uint64(8 * (depth + 1 - _TOP))
        split = np.isin(two, heavy.astype(np.uint64))
        context = two << np.uint64(9)
        context[split] |= keys[split] >> np.uint64(8 * (depth - _TOP)) & np.uint64(255) | np.uint64(256)
    return (mix(context + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _chunks(raws: list[bytes], kind: str, size: int = 2 << 20):
    """Lists of pieces (text, begin, end) of about size bytes; a long text is cut for grams, and stays whole for words."""
    out, n = [], 0
    for k, raw in enumerate(raws):
        step = size if kind == "g" else len(raw) + 1
        for begin in range(0, len(raw) + 1, step):  # the end symbol may be a piece
            out.append((k, begin, min(begin + step, len(raw) + 1)))
            n += out[-1][2] - begin
            if n >= size:
                yield out
                out, n = [], 0
    if out:
        yield out


def _units(raws: list[bytes], pieces: list[tuple[int, int, int]], kind: str, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces' lengths in units, and their units (grams or word hashes) one piece after the other."""
    if kind == "w":
        each = [word_hashes(raws[k]) for k, *_ in pieces]
        return np.array([len(x) for x in each], np.int64), np.concatenate(each)
    # a piece comes after the bytes before it; end symbols before a text make it independent of the text before it
    joined = b"".join(raws[k][max(0, a - depth) : a].rjust(depth, _END) + raws[k][a:b] + (_END if b > len(raws[k]) else b"") for k, a, b in pieces)
    sizes = np.array([b - a for _, a, b in pieces], np.int64)
    every, ends = ctw.grams(joined, depth), np.cumsum(sizes + depth)
    keep = np.ones(len(every), bool)
    for k in range(depth):
        keep[ends - sizes - depth + k] = False
    return sizes, every[keep]


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values in a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _counted(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different units, sorted, and how often each occurs. Sorts units in place."""
    units.sort()
    starts = _runs(units)
    return units[starts], np.diff(starts, append=len(units)).astype(np.int32)


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted tables of units and counts as one."""
    if not len(one[0]) or not len(two[0]):
        return two if not len(one[0]) else one
    keys, counts = np.concatenate((one[0], two[0])), np.concatenate((one[1], two[1]))
    order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
    keys, counts = keys[order], counts[order]
    starts = _runs(keys)
    return keys[starts], np.add.reduceat(counts, starts, dtype=np.int32)


def block_requests(raws: list[bytes], train: np.ndarray, kind: str, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's different grams or words, sorted, and their counts in its training texts."""
    stack: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []  # chunks' tables; equal ranks are merged as they come
    for pieces in _chunks(raws, kind):
        sizes, units = _units(raws, pieces, kind, depth)
        used = np.repeat(train[[k for k, *_ in pieces]], sizes)
        held_out, table = _counted(units[~used])[0], _counted(units[used])
        del units, used
        rank, table = 0, _merged(table, (held_out, np.zeros(len(held_out), np.int32)))
        while stack and stack[-1][0] == rank:
            rank, table = rank + 1, _merged(stack.pop()[1], table)
        stack.append((rank, table))
    table = (np.zeros(0, np.uint64), np.zeros(0, np.int32))
    while stack:
        table = _merged(stack.pop()[1], table)
    return table


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # bytes: A-Z alone


def _blocks(docs: DataFrame, depth: int, shards: int, heavy: np.ndarray, block_bytes: int) -> DataFrame:
    """Rows of two kinds: a text (block, doc_id, held_out, z), and a block's requests to a shard (what, shard, keys, counts)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"what string, block long, doc_id {doc_type}, held_out boolean, shard int, a binary, b binary"

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        base = TaskContext.get().partitionId() << 32
        names = ["what", "block", "doc_id", "held_out", "shard", "a", "b"]

        def block(number, ids, held, raws):
            k = len(raws)
            yield pa.RecordBatch.from_arrays([pa.array(["d"] * k), pa.array([number] * k, pa.int64()), pa.concat_arrays(ids), pa.array(held, pa.bool_()), pa.nulls(k, pa.int32()), pa.array([z.compress(r) for r in raws], pa.binary()), pa.nulls(k, pa.binary())], names)
            none = pa.nulls(1, ids[0].type)
            for kind in "gw":
                keys, counts = block_requests(raws, ~np.array(held, bool), kind, depth)
                shard = _shard_of(keys, kind, depth, shards, heavy)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[s] : edges[s + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([number], pa.int64()), none, pa.nulls(1, pa.bool_()), pa.array([s], pa.int32()), pa.array([_deltas(keys[own])], pa.binary()), pa.array([planes(counts[own].astype("<u4"))], pa.binary())], names)

        ids, held, raws, size, number = [], [], [], 0, base
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                more = [_lowered(t) for t in part.column("text").to_pylist()]
                ids.append(part.column("doc_id"))
                held += part.column("held_out").to_pylist()
                raws += more
                size += sum(map(len, more))
                if size >= block_bytes:
                    yield from block(number, ids, held, raws)
                    ids, held, raws, size, number = [], [], [], 0, number + 1
        if raws:
            yield from block(number, ids, held, raws)

    flagged = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1).alias("held_out"))
    return flagged.mapInArrow(run, schema)


def _sum_requests(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each block's keys, all keys sorted, and their training counts."""
    each = [_undeltas(x.as_py()) for x in rows.column("a")]
    keys, back = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.concatenate([unplanes(x.as_py(), "<u4") for x in rows.column("b")])
    return each, keys, np.bincount(back, counts, len(keys)).astype(np.int64)


def _shard_trees(keys: np.ndarray, counts: np.ndarray, depth: int, heavy: np.ndarray):
    """A shard's grams that aren't of heavy contexts, and those that are: (their places, trees, bytes of the trees' tops)."""
    split = np.isin(keys >> np.uint64(8 * (depth + 1 - _TOP)), heavy.astype(np.uint64))
    for at, top in ((~split, _TOP), (split, _TOP + 1)):
        if at.any():
            yield at, ctw.Shard(keys[at], counts[at], depth, top), top


def _low(requests: DataFrame, depth: int, heavy: np.ndarray):
    """The shallow contexts' tables, of sums over all shards: counts by (context, byte) and log Pw by (context, node)."""

    def run(rows: pa.Table) -> pa.Table:
        _, keys, counts = _sum_requests(rows)
        logs, times = np.zeros((256 + len(heavy)) << 8), np.zeros((256 + len(heavy)) << 8, np.int64)
        two, x = (keys >> np.uint64(8 * (depth - 1))).astype(np.int64), (keys & np.uint64(255)).astype(np.int64)
        np.add.at(times, two >> 8 << 8 | x, counts)
        place = np.zeros(1 << 16, np.int64)
        place[heavy] = np.arange(len(heavy)) + 256
        for split, tree, top in _shard_trees(keys, counts, depth, heavy):
            at, sums = tree.tops()
            context, node = (at >> np.uint64(8)).astype(np.int64), (at & np.uint64(255)).astype(np.int64)
            if top == _TOP:
                np.add.at(logs, context >> 8 << 8 | node, sums)
            else:
                np.add.at(logs, place[context >> 8] << 8 | node, sums)
                np.add.at(times, place[two[split]] << 8 | x[split], counts[split])
        some = np.flatnonzero((logs != 0) | (times != 0))
        return pa.Table.from_pydict({"at": pa.array(some, pa.int32()), "logs": pa.array(logs[some]), "counts": pa.array(times[some])})

    sums = requests.where("what = 'g'").groupBy("shard").applyInArrow(run, "at int, logs double, counts long").groupBy("at").agg(F.sum("logs").alias("logs"), F.sum("counts").alias("counts"))
    logs, counts = np.zeros((256 + len(heavy)) << 8), np.zeros((256 + len(heavy)) << 8, np.int64)
    for at, log, count in sums.toLocalIterator():  # at most 65,536 rows, and 256 for each heavy context
        logs[at], counts[at] = log, count
    return ctw.low_tables(counts[: 1 << 16], logs[: 1 << 16], heavy, counts[1 << 16 :], logs[1 << 16 :])


def _answers(requests: DataFrame, depth: int, heavy: np.ndarray, low) -> DataFrame:
    """For each block and shard the values of its keys in their order: log probabilities, or counts of words."""

    def run(rows: pa.Table) -> pa.Table:
        kind, shard = rows.column("what")[0].as_py(), rows.column("shard")[0].as_py()
        each, keys, counts = _sum_requests(rows)
        if kind == "g":
            logs = np.zeros(len(keys), "<f4")
            for at, tree, _ in _shard_trees(keys, counts, depth, heavy):
                logs[at] = tree.log_probabilities(low)
            values = logs.view("<u4")
        else:
            values = np.minimum(counts, 0xFFFFFFFF).astype("<u4")
        n = len(each)
        return pa.Table.from_pydict({
            "what": pa.array([kind] * n), "block": rows.column("block").combine_chunks(), "shard": pa.array([shard] * n, pa.int32()),
            "values": pa.array([planes(values[np.searchsorted(keys, k)]) for k in each], pa.binary()),
            "known": pa.array([int((counts > 0).sum())] + [0] * (n - 1), pa.int64()), "total": pa.array([int(counts.sum())] + [0] * (n - 1), pa.int64()),
        })

    return requests.groupBy("what", "shard").applyInArrow(run, "what string, block long, shard int, values binary, known long, total long")


def _block_values(raws: list[bytes], kind: str, answers: dict[int, bytes], depth: int, shards: int, heavy: np.ndarray, value: str):
    """Chunks of pieces with the value of each unit: (the pieces' texts, sizes, values)."""
    keys = block_requests(raws, np.ones(len(raws), bool), kind, depth)[0]
    values = np.zeros(len(keys), value)
    if len(keys):
        shard = _shard_of(keys, kind, depth, shards, heavy)
        order = np.argsort(shard, kind="stable")
        values[order] = np.concatenate([unplanes(answers[s], value) for s in sorted(answers)])
        del shard, order
    for pieces in _chunks(raws, kind):
        sizes, units = _units(raws, pieces, kind, depth)
        codes, different = pd.factorize(units)
        order = np.argsort(different)
        own = np.empty(len(different), value)
        own[order] = values[np.searchsorted(keys, different[order])]  # sorted look-ups stay in the cache
        yield np.array([k for k, *_ in pieces]), sizes, own[codes]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate(([0], np.cumsum(sizes)))
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[ends[1:]] - total[ends[:-1]]


def _pairs(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Bytes of all texts with an end symbol each or so, and how often each pair of bytes occurs (its number: the later byte first)."""

    def run(batches):
        counts, total = np.zeros(1 << 16, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                raw = _END.join([b"", *map(_lowered, batch.column(0).slice(at, 256).to_pylist()), b""])
                raw = np.frombuffer(raw, np.uint8)
                total += len(raw)
                for k in range(0, len(raw) - 1, 1 << 20):
                    part = raw[k : k + (1 << 20) + 1].astype(np.uint16)
                    counts += np.bincount(part[1:] << 8 | part[:-1], minlength=1 << 16)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(counts[some], total))})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 65,537 rows
    counts = np.zeros(1 << 16, np.int64)
    total = 0
    for r in found:
        if r.pair < 0:
            total = r.n
        else:
            counts[r.pair] = r.n
    return total, counts


def score(docs: DataFrame, depth: int = 6, block_bytes: int = 16 << 20, shards: int | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of each row."""
    if not _TOP < depth <= 7:
        raise ValueError("depth must be from 3 to 7")
    spark = docs.sparkSession
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    out_schema = f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    if docs.isEmpty():
        return spark.createDataFrame([], out_schema)
    total, pairs = _pairs(docs)
    shards = shards or max(32, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), total // shard_bytes)
    heavy = np.flatnonzero(pairs > total * max(1 / (2 * shards), 1 / 1024))
    path = new_dir(spark, "blocks")
    _blocks(docs, depth, shards, heavy, block_bytes).write.option("compression", "zstd").partitionBy("what").parquet(path)
    schema = f"block long, doc_id {doc_type}, held_out boolean, shard int, a binary, b binary, what string"
    rows = spark.read.schema(schema).parquet(path)
    requests = rows.where("what <> 'd'").select("what", "block", "shard", "a", "b")
    low = _low(requests, depth, heavy)
    answers = cut(_answers(requests, depth, heavy, low), "answers")
    for kind in "gw":
        remove(spark, f"{path}/what={kind}")
    texts = spark.read.schema(f"block long, doc_id {doc_type}, held_out boolean, a binary").parquet(f"{path}/what=d")
    words, tokens = answers.where("what = 'w'").agg(F.sum("known"), F.sum("total")).first()
    n_train = texts.where("NOT held_out").count()
    known, train_tokens = (words or 0) + (n_train > 0), (tokens or 0) + n_train

    def run(_key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        raws = [z.decompress(x.as_py()) for x in texts.column("a")]
        by_kind: dict[str, dict[int, bytes]] = {"g": {}, "w": {}}
        for kind, shard, values in zip(*(answers.column(c).to_pylist() for c in ("what", "shard", "values")), strict=True):
            by_kind[kind][shard] = values
        logs, n_tokens, n_known, base = (np.zeros(len(raws)) for _ in range(4))
        for at, sizes, values in _block_values(raws, "g", by_kind["g"], depth, shards, heavy, "<f4"):
            np.add.at(logs, at, _sums(values, sizes) / np.log(10))
        under = np.log10(train_tokens + 0.5 * (known + 1))
        for at, sizes, values in _block_values(raws, "w", by_kind["w"], depth, shards, heavy, "<u4"):
            n_tokens[at] = sizes + 1
            n_known[at] = _sums(values > 0, sizes) + (n_train > 0)
            base[at] = _sums(np.log10(values + 0.5) - under, sizes) + (np.log10(n_train + 0.5) - under)
        whole = lambda x: pa.array(x.astype(np.int64))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": whole(n_tokens), "n_known": whole(n_known),
            "train_tokens": pa.array([train_tokens] * len(raws), pa.int64()), "base_score": pa.array(base), "score": pa.array(logs),
            "n_bytes": pa.array([len(r) for r in raws], pa.int64()),
        })

    left = texts.select("block", "doc_id", "held_out", "a").groupBy("block")
    right = answers.select("block", "what", "shard", "values").groupBy("block")
    return left.cogroup(right).applyInArrow(run, out_schema)


def op1_ctw_score(docs: DataFrame) -> DataFrame:
    """The scores, and the code length in bits per byte (of the text and its end symbol)."""
    return score(docs).withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1))
