"""Bracketed trees over several lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

_marks = re.compile(r"[()]|[^\s()]+").findall


def read(tree: str):
    """A tree as [label, child, ...]; words are strings."""
    stack: list[list] = [[]]
    for mark in _marks(tree):
        if mark == "(":
            stack.append([])
        elif mark == ")":
            if len(stack) < 2:
                raise ValueError("a bracket closes that wasn't opened")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(mark)
    if len(stack) > 1 or len(stack[0]) != 1:
        raise ValueError("not one whole tree")
    return stack[0][0]


def one_line(node) -> str:
    return node if isinstance(node, str) else "(" + " ".join(map(one_line, node)) + ")"


def pretty(tree: str, width: int = 75, step: int = 2) -> str:
    """A node that fits the width stands on one line; else each child begins a line of its own, two columns further in."""

    def write(node, at: int) -> str:
        flat = one_line(node)
        if isinstance(node, str) or at + len(flat) <= width or all(isinstance(x, str) for x in node):
            return flat
        label = node[0] if isinstance(node[0], str) else ""
        children = node[1:] if label else node
        return f"({label}" + "".join("\n" + " " * (at + step) + write(c, at + step) for c in children) + ")"

    return write(read(tree), 0)


def pretty_df(df: DataFrame, column: str = "tree", out: str = "pretty", width: int = 75) -> DataFrame:
    """df with the trees of a column over several lines; null stays null."""
    fields = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` string"])

    def run(batches):
        for batch in batches:
            texts = [None if t is None else pretty(t, width) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(texts, pa.string())], [*(f.name for f in fields), out])

    return df.mapInArrow(run, schema)
