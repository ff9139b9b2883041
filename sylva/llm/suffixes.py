"""Repeated passages by a sparse suffix array over all texts.

Wanted: every byte that lies in a string of `least` bytes which also starts anywhere else. Sorting each of the
corpus's suffixes would move `least` bytes for every byte, so only anchored suffixes are sorted:

1. Equal texts become one row with their number (a text that stands twice is removed whole if it is long enough).
2. The anchor of a window (a string of `least` bytes) is the place in it, `tail` bytes or more from its end, whose
   8 bytes hash lowest. It depends on the window's bytes alone, so equal windows have their anchors at the same
   offset. The windows of one anchor are a range of offsets.
3. Windows whose offset lies in the same block share a core, a string that all of them contain. A core that occurs
   once in the corpus can't be part of a repeat; only anchors with a core whose hash recurs go on. This drops no
   repeat, whatever the hashes do. Cores that recur in one task are known to go on there, and one row of each is
   shuffled, so frequent passages don't make a hot key.
4. The suffixes at those anchors (with the bytes before them, reversed, as second key) are range-partitioned by
   splitters sampled from them (a bounded number) and sorted in each bucket by multikey quicksort. Common prefixes of neighbours
   then say for each offset which windows are equal: those with the same class of suffixes and of bytes before.
5. Across boundaries: a window can only have an equal in another bucket if it shares its bytes after the anchor with
   the splitter. Those windows are compared by 128-bit hash, one row for each different window of a bucket.

Rows with a null text have the empty text. Repeated rows count as places of their own. Texts under `least` bytes
have no windows. doc_id may repeat or be null, results are joined by content, and other columns aren't read. An
empty table gives an empty result. A text's windows and spans are in one task; no group of texts is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import cut, drop_cut, partitions_for

_PLACE = np.uint64((1 << 26) - 1)


def content_key(raw: bytes) -> bytes:
    """The first half of a text's SHA-256; key_column() is the same in Spark."""
    return hashlib.sha256(raw).digest()[:16]


def key_column(text: str) -> F.Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (16 bytes of the content's hash), rid (8 of them), z (zstd of the UTF-8 bytes) and n (rows with that text).

    Copies within a batch of rows are counted before the shuffle.
    """

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            found: dict[bytes, list] = {}
            for value in batch.column(0):
                raw = (value.as_py() or "").encode()
                key = content_key(raw)
                if key in found:
                    found[key][1] += 1
                else:
                    found[key] = [z.compress(raw), 1]
            yield pa.RecordBatch.from_pydict({"key": pa.array(found, pa.binary()), "z": pa.array([v[0] for v in found.values()], pa.binary()), "n": pa.array([v[1] for v in found.values()], pa.int64())})

    def unite(batches):
        last = None
        for batch in batches:
            out = []
            for key, z, n in zip(batch.column("key").to_pylist(), batch.column("z").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if last and last[0] == key:
                    last[2] += n
                else:
                    out += [last] if last else []
                    last = [key, z, n]
            if out:
                yield _texts_batch(out)
        if last:
            yield _texts_batch([last])

    packed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(pack, "key binary, z binary, n long")
    return packed.repartition("key").sortWithinPartitions("key").mapInArrow(unite, "key binary, rid long, z binary, n long")


def _texts_batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"key": pa.array([r[0] for r in rows], pa.binary()), "rid": pa.array([_short(r[0]) for r in rows], pa.int64()), "z": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})


def anchors(raw: bytes, least: int, tail: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, and for each the lowest and highest offset of its windows' starts before it."""
    n = len(raw) - least + 1  # windows
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    w = least - tail + 1
    first, low, high = [], [], []
    step = 1 << 20  # windows in a slice; places in it fit in 26 bits
    for base in range(0, n, step):
        m = min(step, n - base)
        grams = np.ndarray((m + w - 1,), "<u8", raw, base, (1,))
        x = grams * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x = (x & ~_PLACE) | np.arange(len(x), dtype=np.uint64)
        size = -(-len(x) // w) * w
        padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(x)] = x
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & _PLACE).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(starts[1:], m) - 1
        first.append(at[starts] + base)
        low.append(at[starts] - ends)
        high.append(at[starts] - starts)
    return np.concatenate(first), np.concatenate(low), np.concatenate(high)


def _pack(a: int, low: int, high: int) -> int:
    return a << 30 | low << 15 | high


def _unpack(x: int) -> tuple[int, int, int]:
    return x >> 30, x >> 15 & 0x7FFF, x & 0x7FFF


def recurring_cores(found: DataFrame, least: int, tail: int, block: int, batch_bytes: int = 32 << 20) -> DataFrame:
    """(rid, place) of the anchors, by block of offsets, whose core's hash recurs; place packs anchor and offsets."""
    span = least - block + 1

    def cores(rows):
        hashes, rids, places = [], [], []
        for rid, raw in rows:
            for a, low, high in zip(*(x.tolist() for x in anchors(raw, least, tail)), strict=True):
                for t in range(low // block, high // block + 1):
                    s = a - t * block
                    hashes.append(xxhash.xxh3_64_intdigest(raw[s : s + span], t))
                    rids.append(rid)
                    places.append(_pack(a, max(low, t * block), min(high, t * block + block - 1)))
        if not hashes:
            return None
        h = np.array(hashes, np.uint64)
        _, lead, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        sure = count[back] > 1
        is_lead = np.zeros(len(h), bool)
        is_lead[lead] = True
        h = h.astype(np.int64)
        # what needs no comparing gets a group of its own
        group = np.where(is_lead, h, np.array(places, np.int64) * 1_000_003 ^ np.array(rids, np.int64))
        return pa.RecordBatch.from_pydict({"g": pa.array(group, pa.int64()), "rid": pa.array(rids, pa.int64()), "place": pa.array(places, pa.int64()), "sure": pa.array(sure)})

    def run(batches):
        z = zstandard.ZstdDecompressor()
        rows, size = [], 0
        for batch in batches:
            for rid, blob in zip(batch.column("rid").to_pylist(), batch.column("z"), strict=True):
                raw = z.decompress(blob.as_py())
                rows.append((rid, raw))
                size += len(raw)
                if size >= batch_bytes:
                    if out := cores(rows):
                        yield out
                    rows, size = [], 0
        if out := cores(rows):
            yield out

    hashed = found.select("rid", "z").mapInArrow(run, "g long, rid long, place long, sure boolean")
    counted = hashed.selectExpr("rid", "place", "sure", "count(*) OVER (PARTITION BY g) AS c")
    return counted.where("sure OR c > 1").select("rid", "place")


def contexts(found: DataFrame, places: DataFrame, least: int) -> DataFrame:
    """key, a, low, high, n, suffix (from the anchor on) and before (the bytes before it, reversed) of each anchor."""
    lists = places.groupBy("rid").agg(F.collect_list("place").alias("places"))

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                raw = z.decompress(batch.column("z")[i].as_py())
                merged: dict[int, tuple[int, int]] = {}
                for a, low, high in map(_unpack, batch.column("places")[i].as_py()):
                    was = merged.get(a, (low, high))
                    merged[a] = (min(was[0], low), max(was[1], high))
                rows = [(a, low, high) for a, (low, high) in merged.items() if a >= high and a - low + least <= len(raw)]
                if rows:
                    m, key, n = len(rows), batch.column("key")[i].as_py(), batch.column("n")[i].as_py()
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([key] * m, pa.binary()), "a": pa.array([r[0] for r in rows], pa.int64()),
                        "low": pa.array([r[1] for r in rows], pa.int32()), "high": pa.array([r[2] for r in rows], pa.int32()), "n": pa.array([n] * m, pa.int64()),
                        "suffix": pa.array([raw[a : a + least - low] for a, low, _ in rows], pa.binary()),
                        "before": pa.array([raw[a - high : a][::-1] for a, _, high in rows], pa.binary()),
                    })

    joined = found.join(lists, "rid").select("key", "n", "z", "places")
    return joined.mapInArrow(run, "key binary, a long, low int, high int, n long, suffix binary, before binary")


def words_matrix(strings: list[bytes], width: int) -> np.ndarray:
    """Strings padded with zero bytes to a multiple of 8, as big-endian 64-bit words: they compare as the strings."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), ">u8").reshape(len(strings), width // 8).astype(np.uint64)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows: three-way partition by one word, then the equal rows by the next word."""
    n, width = words.shape
    order = np.arange(n)
    todo = [(0, n, 0)]
    while todo:
        a, b, k = todo.pop()
        if b - a < 2 or k >= width:
            continue
        part = order[a:b].copy()
        if b - a <= 24:
            order[a:b] = sorted(part.tolist(), key=lambda r: words[r, k:].tolist())
            continue
        column = words[part, k]
        some = np.sort(column[:: max(1, len(column) // 64)])
        pivot = some[len(some) // 2]
        less, same = column < pivot, column == pivot
        order[a:b] = np.concatenate((part[less], part[same], part[~(less | same)]))
        mid, end = a + int(less.sum()), a + int(less.sum() + same.sum())
        todo += [(a, mid, k), (mid, end, k + 1), (end, b, k)]
    return order


def neighbour_prefixes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the row before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 8192):
        rows = np.arange(a, min(a + 8192, len(order)))
        differ = words[order[rows]].astype(">u8").view(np.uint8) != words[order[rows - 1]].astype(">u8").view(np.uint8)
        out[rows] = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
    return out


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] equal, a[:hi] not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


_FOUND = pa.schema([("key", pa.binary()), ("s", pa.int64()), ("e", pa.int64()), ("window", pa.binary()), ("bucket", pa.int64())])


def bucket_matches(rows: pa.Table, least: int, edges: tuple[bytes | None, bytes | None], bucket: int) -> pa.Table:
    """Repeats within a bucket as spans (key, s, e), and what must be compared across its edges (window, bucket)."""
    get = lambda c: rows.column(c).to_pylist()
    keys, places, suffix, before = get("key"), get("a"), get("suffix"), get("before")
    low, high, weight = (np.array(get(c), np.int64) for c in ("low", "high", "n"))
    n = len(keys)
    right, left = words_matrix(suffix, max(map(len, suffix))), words_matrix(before, max([8, *map(len, before)]))
    by_right, by_left = multikey_quicksort(right), multikey_quicksort(left)
    lcp_right, lcp_left = neighbour_prefixes(right, by_right), neighbour_prefixes(left, by_left)
    touch = np.zeros(n, np.int64)  # bytes of the suffix that an edge of the bucket shares
    for edge in edges:
        if edge is not None:
            touch = np.maximum(touch, [_shared(s, edge) for s in suffix])
    out: dict[str, list] = {c: [] for c in _FOUND.names}
    again = np.zeros((n, int(high.max()) + 1), bool)
    for o in range(int(low.min()), int(high.max()) + 1):
        d = least - o
        active = np.flatnonzero((low <= o) & (o <= high))
        if not len(active):
            continue
        classes = np.empty(n, np.int64)
        classes[by_right] = np.cumsum(lcp_right < d) * (n + 1)
        other = np.empty(n, np.int64)
        other[by_left] = np.cumsum(lcp_left < o)
        _, lead, back = np.unique((classes + other)[active], return_index=True, return_inverse=True)
        repeated = np.bincount(back, weight[active])[back] > 1
        again[active[repeated], o] = True
        for i in active[np.unique(np.concatenate((lead, np.flatnonzero(~repeated))))].tolist() if touch.max(initial=0) >= d else ():
            if touch[i] >= d:
                start = places[i] - o
                out["key"].append(None if again[i, o] else keys[i])
                out["s"].append(start)
                out["e"].append(start + least)
                out["window"].append(xxhash.xxh3_128_digest(before[i][:o][::-1] + suffix[i][:d], o))
                out["bucket"].append(bucket)
    padded = np.zeros((n, again.shape[1] + 2), np.int8)
    padded[:, 1:-1] = again
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    _, last = np.nonzero(change == -1)
    for i, o1, o2 in zip(row.tolist(), first.tolist(), (last - 1).tolist(), strict=True):
        out["key"].append(keys[i])
        out["s"].append(places[i] - o2)
        out["e"].append(places[i] - o1 + least)
        out["window"].append(None)
        out["bucket"].append(bucket)
    return pa.Table.from_pydict(out, schema=_FOUND)


_ORDER = ["suffix", "before", "key", "a"]


def _cuts(rows: DataFrame, n: int, total: int) -> list[tuple]:
    """n - 1 splitters or fewer, from a sample of about 16 n suffixes."""
    if n < 2:
        return []
    share = max(1, total // (n * 16))
    sample = sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows.where(f"pmod(xxhash64(key, a), {share}) = 0").select(*_ORDER).collect())
    return sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []


def stream_buckets(batches, bucket_rows: int, edges):
    """Sorted rows of some ranges as tables of bucket_rows rows: (range, number in it, table, its two edges)."""

    def flush(k, number, rows, before, after):
        own = edges(k)
        return k, number, rows, (own[0] if before is None else before, own[1] if after is None else after)

    now, number, held, size, before = None, 0, [], 0, None
    for batch in batches:
        ranges = np.asarray(batch.column("bucket"))
        starts = np.concatenate(([0], np.flatnonzero(ranges[1:] != ranges[:-1]) + 1, [len(ranges)])) if len(ranges) else [0]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            part = batch.slice(a, b - a)
            if now is not None and now != ranges[a]:
                yield flush(now, number, pa.Table.from_batches(held), before, None)
                number, held, size, before = 0, [], 0, None
            now = int(ranges[a])
            while part.num_rows:
                if size >= bucket_rows:
                    yield flush(now, number, pa.Table.from_batches(held), before, part.column("suffix")[0].as_py())
                    before = held[-1].column("suffix")[-1].as_py()
                    number, held, size = number + 1, [], 0
                held.append(part.slice(0, bucket_rows - size))
                size += held[-1].num_rows
                part = part.slice(held[-1].num_rows)
    if held:
        yield flush(now, number, pa.Table.from_batches(held), before, None)


def sorted_matches(rows: DataFrame, least: int, bucket_rows: int = 12_000, most: int = 4096) -> DataFrame:
    """(key, s, e): spans of repeated windows, from contexts().

    At most `most` splitters are sampled. If that makes ranges of more than bucket_rows, a range is put in order
    by Spark's sort, which may spill, and cut into buckets as it streams by.
    """
    spark = rows.sparkSession
    total = rows.count()
    n = max(1, -(-total // bucket_rows))
    splitters = _cuts(rows, min(n, most), total)
    schema = "key binary, s long, e long, window binary, bucket long"

    def deal(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in _ORDER]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(splitters, k) for k in zip(*columns, strict=True)], pa.int32()), *batch.columns], ["bucket", *batch.schema.names])

    def edges(k: int):
        return splitters[k - 1][0] if k else None, splitters[k][0] if k < len(splitters) else None

    def match(rows: pa.Table) -> pa.Table:
        k = rows.column("bucket")[0].as_py()
        return bucket_matches(rows, least, edges(k), k)

    def stream(batches):
        for k, number, table, own in stream_buckets(batches, bucket_rows, edges):
            yield from bucket_matches(table, least, own, k << 32 | number).to_batches()

    dealt = rows.mapInArrow(deal, "bucket int, key binary, a long, low int, high int, n long, suffix binary, before binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(n, most))
    dealt = dealt.repartition(parts, "bucket")
    if n <= most:
        found = dealt.groupBy("bucket").applyInArrow(match, schema)
    else:
        found = dealt.sortWithinPartitions("bucket", *_ORDER).mapInArrow(stream, schema)
    found = cut(found, "spans")
    inside = found.where("window IS NULL").select("key", "s", "e")
    if n == 1:
        return inside
    edge = found.where("window IS NOT NULL")
    both = edge.groupBy("window").agg(F.min("bucket").alias("b0"), F.max("bucket").alias("b1")).where("b0 < b1").select("window")
    return inside.unionAll(edge.where("key IS NOT NULL").join(both, "window").select("key", "s", "e"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as ascending maximal runs."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, least: int = 400, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct texts (key, rid, z, n) and their repeated spans: (key, spans), texts without any left out."""
    if not 32 <= least < 1 << 15:
        raise ValueError("least must be from 32 to 32767 bytes")
    tail = 16
    block = -(-(least - tail + 1) // 3)
    found = cut(distinct_texts(docs, text), "texts")
    rows = cut(contexts(found, recurring_cores(found, least, tail, block), least), "suffixes")
    matches = sorted_matches(rows, least)
    drop_cut(rows)
    spans = matches.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return found, spans


_RESULT = "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def without_repeats(docs: DataFrame, least: int = 400, text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay) and text of each distinct text.

    text is what stays as a text, in which a character that lost a byte goes whole.
    """
    found, spans = repeats(docs, least, text)

    def one(key, raw, n, spans):
        runs = [(0, len(raw))] if n > 1 and len(raw) >= least else merge_spans([(x["s"], x["e"]) for x in spans or ()])
        ends = [0, *(x for r in runs for x in r), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
        return key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")

    def run(batches):
        z = zstandard.ZstdDecompressor()
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = zip(*(batch.slice(k, 64).column(c).to_pylist() for c in ("key", "z", "n", "spans")), strict=True)
                out = [one(key, z.decompress(blob), n, spans) for key, blob, n, spans in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return found.join(spans, "key", "left").select("key", "z", "n", "spans").mapInArrow(run, _RESULT)


def with_key(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns and _key, the content's key of the text."""
    return docs.select(*[F.col(f"`{c}`") for c in columns], key_column(text).alias("_key"))


def op7_suffix_dedup(docs: DataFrame, least: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left) of each row."""
    kept = without_repeats(docs, least).withColumnRenamed("key", "_key")
    return with_key(docs, ["doc_id"]).join(kept, "_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def remove_repeats(docs: DataFrame, least: int = 200) -> DataFrame:
    """docs with repeated passages cut out of text (a character that loses a byte goes whole); n_chars is the new length."""
    clean = without_repeats(docs, least).select(F.col("key").alias("_key"), F.col("text").alias("_kept"))
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever names docs has, they don't clash
    rows = docs.toDF(*names)
    at = docs.columns.index("text")
    joined = with_key(rows, [c for k, c in enumerate(names) if k != at], names[at]).join(clean, "_key")
    out = [F.col("_kept" if k == at else c) for k, c in enumerate(names)]
    if "n_chars" in docs.columns:
        out[docs.columns.index("n_chars")] = F.length("_kept").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[c.alias(n) for c, n in zip(out, names, strict=True)]).toDF(*docs.columns)
