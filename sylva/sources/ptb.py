"""Bracketed trees: text to node table and back, and other tables that follow from one tree at a time.

A tree is one row of text, so reading it is row-local: an Arrow kernel cuts a batch of trees and returns the rows of the
table, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.forest import Forest
from sylva.functions.rowtree import RowTree

Keys = str | tuple[str, ...]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def each_tree(trees: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str, key: Keys = "sent_id", tree: Keys = "tree") -> DataFrame:
    """key and schema: the rows that rows(tree, ...) gives for the texts of each row, read as RowTree (None if unreadable)."""
    keys, texts = _keys(key), _keys(tree)
    kinds = ", ".join(f"`{c}` {trees.schema[c].dataType.simpleString()}" for c in keys)
    out = trees.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part, at, found = batch.slice(a, 256), [], []
                for i, cells in enumerate(zip(*(part.column(f"_t{j}").to_pylist() for j in range(len(texts))), strict=True)):
                    new = list(rows(*map(RowTree.read, cells)))
                    at += [i] * len(new)
                    found += new
                own = part.take(pa.array(at, pa.int64()))
                columns = zip(*found, strict=True) if found else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keys), *(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True))], [*keys, *arrow.names])

    return trees.select(*keys, *[F.col(c).alias(f"_t{j}") for j, c in enumerate(texts)]).mapInArrow(run, f"{kinds}, {schema}")


#: Bytes of text that a kernel reads at once; a longer text is read alone.
PIECE_BYTES = 2_000_000


def pieces(batch: pa.RecordBatch, texts: list[str]) -> Iterable[pa.RecordBatch]:
    """A batch cut into runs of rows with about PIECE_BYTES of text."""
    size = sum(np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]).astype(np.int64) for c in (batch.column(t) for t in texts)) if batch.num_rows else np.zeros(0, np.int64)
    part = np.cumsum(size) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def list_pieces(batch: pa.RecordBatch, texts: str) -> Iterable[pa.RecordBatch]:
    """A batch of rows with lists of texts, cut into runs of whole lists with about PIECE_BYTES of text."""
    lists = batch.column(texts)
    size = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    weight = np.cumsum(np.append(0, pc.binary_length(lists.flatten().cast(pa.string())).fill_null(0).to_numpy().astype(np.int64)))
    part = weight[np.cumsum(size) - size] // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def each_forest(trees: DataFrame, rows: Callable[..., tuple[np.ndarray, list]], schema: str, key: Keys = "sent_id", tree: Keys = "tree") -> DataFrame:
    """key and schema, from many trees at once: rows(texts, ...) gives each new row's place among the texts, and the columns.

    Without keys (an empty tuple) rows are not of one text each, such as counts, and the places aren't looked at.
    """
    keys, texts = _keys(key), _keys(tree)
    kinds = ", ".join(f"`{c}` {trees.schema[c].dataType.simpleString()}" for c in keys)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(trees.sparkSession.createDataFrame([], schema).schema)
    names = [f"_t{j}" for j in range(len(texts))]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, names):
                at, columns = rows(*(part.column(n) for n in names))
                own = part.select(keys).take(pa.array(at, pa.int64())).columns if keys else []
                made = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, *(c if c.type == f.type else c.cast(f.type) for c, f in zip(made, arrow, strict=True))], [*keys, *arrow.names])

    return trees.select(*keys, *[F.col(c).alias(n) for c, n in zip(texts, names, strict=True)]).mapInArrow(run, f"{kinds}, {schema}" if keys else schema)


def different(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of numbers from 0: a row of each different kind, each row's number among these, and how many rows each has."""
    out, room = np.zeros(len(columns[0]), np.int64), 1
    for x in columns:
        more = int(x.max()) + 1 if len(x) else 1
        if room * more >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            room = len(out) + 1
        out, room = out * more + x, room * more
    _, some, place, times = np.unique(out, return_index=True, return_inverse=True, return_counts=True)
    return some, place, times


def forest_totals(trees: DataFrame, draw: Callable[..., tuple[list, list]], by: str, sums: str = "", tree: Keys = "tree") -> DataFrame:
    """by, n and sums: how many of the rows that draw(texts, ...) gives are of each kind, and their sums of whole numbers.

    draw gives for each column of `by` the rows' places among an array of values, and that array; and for each of `sums` numbers. Rows
    are counted where the trees are read, so partial counts move.
    """
    names, added = ([x.split()[0] for x in s.split(", ") if x] for s in (by, sums))

    def run(*texts):
        groups, numbers = draw(*texts)
        some, place, n = different([places for places, _ in groups])
        return some, [*(values.take(pa.array(places[some])) for places, values in groups), n, *(np.bincount(place, x, len(some)).astype(np.int64) for x in numbers)]

    found = each_forest(trees, run, ", ".join(x for x in (by, "n long", sums) if x), (), tree)
    return found.groupBy(*names).agg(*(F.sum(c).alias(c) for c in ("n", *added)))


def _node_rows(texts: pa.Array):
    f = Forest.read(texts)
    local = f.local(f.parent)
    at = np.arange(len(f)) - f.base
    return f.row[f.tree], [at.astype(np.int32), pa.array(local.astype(np.int32), mask=local < 0), f.depth, f.start.astype(np.int32), f.finish.astype(np.int32), f.label, f.word]


def read_nodes(trees: DataFrame, key: Keys = "sent_id", tree: str = "tree") -> DataFrame:
    """key, node, parent, depth, start, finish, label, word: a row for each constituent, nodes in pre-order.

    An opening bracket without a label is S1; a word under -NONE- has no width. A text that isn't one tree, or is null,
    has no rows.
    """
    return each_forest(trees, _node_rows, "node int, parent int, depth int, start int, finish int, label string, word string", key, tree)


def errors(trees: DataFrame, key: Keys = "sent_id", tree: str = "tree") -> DataFrame:
    """key of the rows whose text isn't one tree."""
    return each_tree(trees, lambda t: [(True,)] if t is None else [], "bad boolean", key, tree).drop("bad")


def changed_trees(trees: DataFrame, change: Callable[[RowTree], RowTree | None], key: Keys = "sent_id", tree: str = "tree") -> DataFrame:
    """key, tree: every tree after a change (null where nothing is left or the text isn't a tree)."""

    def run(t):
        new = change(t) if t is not None else None
        return [(new.write() if new is not None else None,)]

    return each_tree(trees, run, "tree string", key, tree)


def changed_forests(trees: DataFrame, change: Callable[[Forest], Forest], normal: bool = False, key: Keys = "sent_id", tree: str = "tree") -> DataFrame:
    """changed_trees for many trees at once; normal: as the ranker sees them. The change leaves each tree its place."""

    def run(texts):
        f = change(Forest.read(texts, normal))
        at = np.full(len(texts), -1)
        at[f.row] = np.arange(len(f.row))
        return np.arange(len(texts)), [f.write().take(pa.array(at, mask=at < 0))]

    return each_forest(trees, run, "tree string", key, tree)


def write_trees(nodes: DataFrame, key: str = "sent_id") -> DataFrame:
    """key, tree: the bracketed text of a node table; closing brackets follow from the next node's depth."""
    order = Window.partitionBy(key).orderBy("node")
    closes = F.col("depth") - F.coalesce(F.lead("depth").over(order), F.lit(0)) + 1
    opened = F.concat(F.lit("("), F.col("label"), F.coalesce(F.concat(F.lit(" "), "word"), F.lit("")))
    part = nodes.withColumn("n", closes).select(key, "node", F.concat(opened, F.expr("repeat(')', n)")).alias("part"))
    ordered = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node", "part"))).alias("parts"))
    return ordered.select(key, F.array_join(F.transform("parts", lambda x: x["part"]), " ").alias("tree"))
