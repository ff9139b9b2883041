"""Best-fit packing into bins of several permitted sizes.

Lengths are whole numbers up to the largest size, so a histogram says all that a plan needs, and it has at most as many
rows as the largest size, however many pieces there are. The driver packs the histogram: lengths go down, a
piece goes to the open bin with the least room that holds it, equal bins are handled as ranges of bin numbers. If no
bin has room, one of the least-cost size is opened: for each size it is worked out what the histogram's rest could
fill the new bins with (longest pieces first, an equal share for each of the bins that are opened together) and
which size they would be cut down to; the size whose bins cost least for each token in them is opened. Every single
size is tried as the only one to open, too, and the plan whose bins cost least is taken. At last each bin gets the
least size that holds its contents.

Texts longer than the largest size are cut into full pieces and a rest. Pieces of equal length are numbered by hash
buckets and prefix sums of the buckets' counts, so a frequent length is no hot key. The plan's rows (ranges of
equal pieces) are looked up by binary search.

A null text is empty; an empty text has one piece, its end token. Repeated rows are packed each. An empty table
gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import cut

SIZES = (1024, 2048, 4096, 8192)


def _pack(histogram: dict[int, int], opens: Callable[[int, int], int]):
    """(placements, bins). A placement (length, first, n, bin, each, at): n pieces from rank first on, `each` to a bin from
    bin number `bin` on, the first of a bin at offset `at`. A range of bins is (first bin, n, contents)."""
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left: ranges (first bin, n, size)
    rooms: list[int] = []
    placements, bins = [], 0

    def put(space: int, first: int, n: int, size: int) -> None:
        if n:
            if space not in room:
                room[space] = []
                insort(rooms, space)
            room[space].append((first, n, size))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                space = rooms[k]
                first, n, size = room[space].pop()
                if not room[space]:
                    del room[space], rooms[k]
            else:
                size = space = opens(length, todo)
                n = -(-todo // (space // length))
                first, bins = bins, bins + n
            each = space // length
            full = min(n, todo // each)
            if full:
                placements.append((length, rank, full * each, first, each, size - space))
                put(space - each * length, first, full, size)
                rank, todo = rank + full * each, todo - full * each
            if full < n and todo:  # a last bin gets the rest
                placements.append((length, rank, todo, first + full, todo, size - space))
                put(space - todo * length, first + full, 1, size)
                rank, todo, full = rank + todo, 0, full + 1
            put(space, first + full, n - full, size)
    return placements, [(first, n, size - space) for space, ranges in room.items() for first, n, size in ranges]


def _expected(length: int, todo: int, size: int, lengths: np.ndarray, counts: np.ndarray) -> int:
    """Contents of each of the bins of `size` that `todo` pieces need, if every bin gets an equal share of the shorter ones."""
    each = size // length
    n = -(-todo // each)
    held = min(each, todo) * length
    shorter = lengths[: np.searchsorted(lengths, length)]
    some = np.flatnonzero(counts[: len(shorter)] >= n)
    at = len(some)
    while (at := min(at, int(np.searchsorted(shorter[some], size - held, side="right"))) - 1) >= 0:
        k = some[at]
        held += int(min(counts[k] // n, (size - held) // shorter[k]) * shorter[k])
    return held


def policies(histogram: dict[int, int], sizes: tuple[int, ...], cost: Callable[[int], float]) -> list[Callable[[int, int], int]]:
    """Sizes to open for a length and a number of pieces: the one of least expected cost for a token, and each size alone."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    at_least = lambda n: sizes[bisect_left(sizes, n)]

    def cheapest(length: int, todo: int) -> int:
        held = {s: _expected(length, todo, s, lengths, counts) for s in sizes if s >= length}
        return min(held, key=lambda s: (cost(at_least(held[s])) / held[s], s))

    return [cheapest, *(lambda length, _, s=s: max(s, at_least(length)) for s in sizes)]


def total_cost(ranges, sizes: tuple[int, ...], cost: Callable[[int], float]) -> float:
    return sum(n * cost(sizes[bisect_left(sizes, max(1, held))]) for _, n, held in ranges)


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = float):
    """The placements and bins (first bin, n, contents, size) of the cheapest plan found."""
    sizes = tuple(sorted(sizes))
    plans = [_pack(histogram, opens) for opens in policies(histogram, sizes, cost)]
    placements, ranges = min(plans, key=lambda p: total_cost(p[1], sizes, cost))
    return placements, sorted((first, n, held, sizes[bisect_left(sizes, max(1, held))]) for first, n, held in ranges)


def pieces(docs: DataFrame, most: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, piece, start and n_tokens: a text's words and an end token, cut at `most`."""
    words = F.expr(r"cast(size(array_remove(split(coalesce(cast(text as string), ''), r'[\x20\x09-\x0D]+'), '')) + 1 as long)")
    counted = docs.select(*keep, words.alias("_n"))
    each = counted.select(*keep, "_n", F.explode(F.expr(f"sequence(0L, (_n - 1) div {most})")).alias("piece"))
    return each.select(*keep, "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("_n") - F.col("piece") * most).alias("n_tokens"))


def best_fit(parts: DataFrame, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = float, bucket_rows: int = 100_000) -> DataFrame:
    """parts (any columns and n_tokens, from 1 to the largest size) with bin_id, bin_offset, bin_tokens and bin_size."""
    spark = parts.sparkSession
    rows = cut(parts, "pieces")
    names = rows.columns
    counts = {r.n_tokens: r.n for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most the largest size
    if any(not 0 < k <= max(sizes) for k in counts):
        raise ValueError("lengths must be from 1 to the largest size")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{fields}, bin_id long, bin_offset long, bin_tokens long, bin_size long"
    if not counts:
        return spark.createDataFrame([], schema)
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    numbered = rows.withColumn("_b", F.expr(f"pmod(xxhash64({', '.join(f'`{c}`' for c in names)}), {buckets})"))
    before = numbered.groupBy("n_tokens", "_b").agg(F.count("*").alias("_c"))
    before = before.selectExpr("n_tokens", "_b", "sum(_c) OVER (PARTITION BY n_tokens ORDER BY _b) - _c AS _before")
    order = ", ".join(f"`{c}`" for c in names)
    ranked = numbered.selectExpr("*", f"row_number() OVER (PARTITION BY n_tokens, _b ORDER BY {order}) - 1 AS _r").join(before, ["n_tokens", "_b"])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in names], (F.col("_r") + F.col("_before")).cast("long").alias("_rank"))

    placements, ranges = plan(counts, sizes, cost)
    place = np.array(sorted(placements), np.int64)
    bins = np.array(ranges, np.int64)
    key = place[:, 0] << 44 | place[:, 1]

    def look_up(batches):
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            rank = batch.column("_rank").to_numpy()
            p = place[np.searchsorted(key, n << 44 | rank, side="right") - 1]
            nth = rank - p[:, 1]
            bin_id, offset = p[:, 3] + nth // p[:, 4], p[:, 5] + nth % p[:, 4] * n
            own = bins[np.searchsorted(bins[:, 0], bin_id, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (bin_id, offset, own[:, 2], own[:, 3]))], [*names, "bin_id", "bin_offset", "bin_tokens", "bin_size"])

    return ranked.mapInArrow(look_up, schema)


def op2_best_fit(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_tokens and bin_size of every piece of every row."""
    return best_fit(pieces(docs, max(sizes)), sizes)
