"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Two texts are linked if the Jaccard similarity of their sets of n consecutive words (A-Z lowered) is at least the
threshold. Band and row counts are the most selective ones that reach the target recall at the threshold within the
budget of hashes. Equal texts are one text with a number of rows. Texts with a common band hash are joined to the
least of them (a star, not all pairs); the components of these stars are what is compared. A component is compared
in pairs of blocks of at most `block` texts, each pair of blocks a task of its own, which returns a number of
links for each text and a spanning forest of the links, never the pairs. The components of the forests are the classes.

A null text is empty. Texts without words are linked to equal texts alone; texts of fewer than n words have one n-gram,
of all their words. doc_id may repeat or be null (a class id is the least doc_id of its rows, null if there's none).
Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import cut, drop_cut
from sylva.llm.components import components
from sylva.llm.hashing import mix, shingles
from sylva.llm.suffixes import distinct_texts, key_column, with_key


def choose_bands(threshold: float = 0.8, recall: float = 0.9999, budget: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands find a pair at the threshold with probability recall within budget."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, budget + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= budget:
            best = (bands, rows)
    return best


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of MinHash values of a set."""
    rng = np.random.default_rng(977)
    a, b = rng.integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
    a = a * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(0, len(grams), 2048):
        least = np.minimum(least, (grams[k : k + 2048, None] * a + b).min(axis=0))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in (least >> np.uint64(20)).reshape(bands, rows).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def _grams(blob, n: int, z) -> np.ndarray:
    return shingles(z.decompress(blob).lower(), n)


def candidate_stars(found: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Edges (a, b) of rids: every text of a band's bucket and the bucket's least text."""

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rids, hashes = [], []
                for rid, blob in zip(part.column("rid").to_pylist(), part.column("z"), strict=True):
                    grams = _grams(blob.as_py(), n, z)
                    if len(grams):
                        hashes.append(band_hashes(grams, bands, rows))
                        rids.append(np.full(bands, rid, np.int64))
                if rids:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(hashes).astype(np.int64)), "rid": pa.array(np.concatenate(rids))})

    hashed = cut(found.select("rid", "z").mapInArrow(run, "h long, rid long"), "bands")
    least = hashed.groupBy("h").agg(F.min("rid").alias("b"), F.max("rid").alias("_max")).where("b < _max").select("h", "b")
    stars = cut(hashed.join(least, "h").where("rid <> b").select(F.col("rid").alias("a"), "b").distinct(), "stars")
    drop_cut(hashed)
    return stars


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    every = np.concatenate([*left, *right])
    values, ids, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # only what occurs twice can be common
    width = int(shared[-1]) + 1 if len(values) else 0
    at = np.repeat(np.arange(len(left) + len(right)), [*map(len, left), *map(len, right)])
    keep = times[ids] > 1
    at, ids = at[keep], shared[ids[keep]]
    order = np.argsort(ids, kind="stable")
    at, ids = at[order], ids[order]
    out = np.zeros((len(left), len(right)), np.float32)
    step = max(256, (8 << 20) // (4 * (len(left) + len(right))))
    for k in range(0, width, step):
        a, b = np.searchsorted(ids, (k, k + step))
        dense = np.zeros((len(left) + len(right), step), np.float32)
        dense[at[a:b], ids[a:b] - k] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, as (node, root)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs.tolist():
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [(i, root(i)) for i in range(n) if root(i) != i]


_LINKS = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("other", pa.binary())])


def _compare(rows: pa.Table, threshold: float, n: int) -> pa.Table:
    """Links of a pair of blocks: number for each text, and forest edges (key, other) with 0 links."""
    z = zstandard.ZstdDecompressor()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    keys, own, weight = rows.column("key").to_pylist(), np.array(rows.column("own").to_pylist()), np.array(rows.column("n").to_pylist(), np.int64)
    sets = [_grams(x.as_py(), n, z) for x in rows.column("z")]
    size = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    links, pairs = np.zeros(len(keys), np.int64), []
    for a in range(0, len(left), 512):
        for b in range(0 if i != j else a, len(right), 512):
            la, rb = left[a : a + 512], right[b : b + 512]
            common = _counts([sets[k] for k in la], [sets[k] for k in rb])
            union = size[la][:, None] + size[rb][None, :] - common
            linked = (common >= threshold * union - 1e-6) & (common > 0)
            if i == j and a == b:
                linked = np.triu(linked, 1)
            x, y = np.nonzero(linked)
            np.add.at(links, la[x], weight[rb[y]])
            np.add.at(links, rb[y], weight[la[x]])
            pairs.append(np.stack([la[x], rb[y]], axis=1))
    some = np.flatnonzero(links)
    forest = _forest(len(keys), np.concatenate(pairs)) if pairs else []
    return pa.Table.from_pydict({
        "key": [keys[k] for k in some] + [keys[a] for a, _ in forest],
        "links": links[some].tolist() + [0] * len(forest),
        "other": [None] * len(some) + [keys[b] for _, b in forest],
    }, schema=_LINKS)


def links(found: DataFrame, threshold: float, n: int, recall: float, block: int = 1024) -> DataFrame:
    """(key, links, other): partial numbers of links, and forest edges where other is set."""
    stars = candidate_stars(found, n, *choose_bands(threshold, recall))
    roots = cut(components(stars), "candidates")
    drop_cut(stars)
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("m"))
    # a text is in a pair of blocks with each block of its component; small components have one block
    # merge: the candidates grow with the corpus, whatever a small one would allow
    dealt = found.join(roots.withColumnRenamed("node", "rid").hint("merge"), "rid").join(blocks, "root").select("root", "key", "n", "z", "m", F.expr("int(pmod(xxhash64(key), m))").alias("own"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, m - 1)"))).select("root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "key", "own", "n", "z")
    out = cut(dealt.groupBy("root", "i", "j").applyInArrow(lambda rows: _compare(rows, threshold, n), "key binary, links long, other binary"), "links")
    drop_cut(roots)
    return out


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """_key (of a text), _class (a key, that all texts of a class share) and _links (rows linked to a row of that text)."""
    found = cut(distinct_texts(docs), "texts")
    linked = links(found, threshold, n, recall)
    root = components(linked.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("_key"), "root")
    number = linked.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    copies = found.select(F.col("key").alias("_key"), F.col("n").alias("_n")).join(number.withColumnRenamed("key", "_key"), "_key", "left").join(root, "_key", "left")
    out = cut(copies.select("_key", F.coalesce("root", "_key").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("_n") - 1).alias("_links")), "classes")
    drop_cut(found, linked)
    return out


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns of every row (whatever their names), _class and _links."""
    names = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], key_column("text").alias("_key"))
    return rows.join(classes(docs, threshold, n, recall), "_key").select(*names, "_class", "_links").toDF(*keep, "_class", "_links")


def op6_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and n_links of each row."""
    joined = cut(jaccard_join(docs), "classes")
    classes = joined.groupBy("_class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return joined.join(classes, "_class").select("doc_id", "class_id", "class_size", F.col("_links").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """docs with one row of each class, that of the least doc_id (nulls last; of rows with equal doc_id, any one)."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    judged = with_key(rows, [doc_id], text).join(classes(rows.select(F.col(text).alias("text")), threshold, n), "_key")
    best = judged.groupBy("_class").agg(F.min(F.struct(F.col(doc_id).isNull().alias("_none"), F.col(doc_id).alias("_least"), "_key")).alias("b")).select("b._key", "b._least")
    # a class keeps one text; of the rows with that text and that doc_id one stays
    kept = with_key(rows, names, text).join(best, "_key").where(F.col(doc_id).eqNullSafe(F.col("_least")))
    return kept.dropDuplicates(["_key"]).select(*names).toDF(*docs.columns)
