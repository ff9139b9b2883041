"""Source divergence audit: how far the sources of a language are from each other, and the terms that set one apart.

A term is a run of ASCII letters (A-Z lowered) and non-ASCII characters. A language keeps the terms that at least
`min_docs` of its documents hold, V of them. In a group (lang, source), and in a language, a kept term that occurs c times
has the share 1 + floor(10^9 * (c + 5) / (N + 5 * V)), N being the occurrences of all kept terms there.

Counting: a task adds up its documents' terms before anything moves, and counts then meet by (lang, term), so neither a
language nor a source that holds much of the corpus is a key of an exchange of texts.

Pairs: with z the share of a term that doesn't occur, the distance of groups a and b over all V terms is
  V * |za - zb|  +  the sum over a's terms of |p - zb| - |za - zb|  +  the same for b's terms
  +  the sum over terms in both of |pa - pb| - |pa - zb| - |za - pb| + |za - zb|.
The second and third part come of each group's histogram of shares, the last of the postings: groups that hold the same
term meet by (lang, term), and their sums are added up before they move.

Top terms: f = p - q over terms that occur in the group with p > q, q being the language's share. A group's terms fall
into buckets of about equal count; a bucket's largest p less its smallest q bounds f. Buckets are evaluated best bound first:
at first those that hold the first k terms with p > q; their k-th value is a threshold, and buckets whose bound isn't strictly below
it follow. All others are left unseen, as none of their terms can be among the first k, ties included.

Null text, lang and source are read as ''. Groups without terms (empty texts) are groups, too; a language without kept terms
has distances 0 and no top terms. Repeated rows count each. An empty table gives an empty result. doc_id and extra
columns aren't read. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylva.llm.common import cut, drop_cut

MIN_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50

#: Bytes of terms stay, A-Z lowered; all others are spaces. UTF-8 bytes of non-ASCII characters are from 0x80 on.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_AT_ONCE = 1 << 20


def _terms(raw: bytes):
    """Lists of a text's terms as bytes; a long text comes in several lists."""
    raw = raw.translate(_TERM_BYTES)
    a = 0
    while len(raw) - a > _AT_ONCE and (b := raw.find(b" ", a + _AT_ONCE)) > 0:
        yield raw[a:b].split()
        a = b
    yield raw[a:].split()


def count_terms(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents), added up in each task as far as `most` entries allow."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("d", pa.int64())])

    def run(batches):
        n, d = defaultdict(Counter), defaultdict(Counter)

        def flush():
            for (lang, source), own in n.items():
                in_docs = d[lang, source]
                terms = list(own)
                for a in range(0, len(terms), 50_000):
                    part = terms[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()), pa.array([own[t] for t in part], pa.int64()), pa.array([in_docs[t] for t in part], pa.int64())], schema=schema)
            n.clear()
            d.clear()

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for lang, source, raw in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("raw"), strict=True):
                    own, seen = n[lang, source], set()
                    for terms in _terms(raw.as_py()):
                        own.update(terms)
                        seen.update(terms)
                    d[lang, source].update(seen)
                if sum(map(len, n.values())) > most:
                    yield from flush()
        yield from flush()

    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    read = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("raw"))
    return read.mapInArrow(run, "lang string, source string, term binary, n long, d long").withColumn("term", F.col("term").cast("string"))


def _share(c: str, total: str, v: str = "v") -> str:
    return f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * ({c} + {SMOOTH}) div ({total} + {SMOOTH} * {v}))"


def scored_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, terms). groups: lang, source, v, z of every group; terms: lang, source, term, n, p, q, z, bucket of every kept
    term that occurs in a group. Both are tables in the shared folder."""
    term = W.partitionBy("lang", "term")
    summed = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = summed.select("lang", "source", "term", "n", F.sum("n").over(term).alias("ln"), F.sum("d").over(term).alias("ld"), F.min("source").over(term).alias("least"))
    kept = cut(kept.where(F.col("ld") >= min_docs).select("lang", "source", "term", "n", "ln", (F.col("source") == F.col("least")).cast("long").alias("first")), "kept")

    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    sums = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("first").alias("v"))
    groups = docs.select(text("lang"), text("source")).distinct().join(own.drop("first"), ["lang", "source"], "left").join(sums, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "v"])
    groups = cut(groups.selectExpr("*", f"CASE WHEN v > 0 THEN {_share('0', 'total')} ELSE 0L END AS z"), "groups")
    terms = kept.drop("first").join(groups, ["lang", "source"])
    terms = terms.selectExpr("lang", "source", "term", "n", f"{_share('n', 'total')} AS p", f"{_share('ln', 'lang_total')} AS q", "z", "CAST(floor(4 * log2(n)) AS INT) AS bucket")
    terms = cut(terms, "terms")
    drop_cut(kept)
    return groups.select("lang", "source", "v", "z"), terms


def pair_distances(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair of a language's sources."""
    a = groups.selectExpr("lang", "source AS a", "v", "z AS za")
    b = groups.selectExpr("lang", "source AS b", "z AS zb")
    absent = a.join(b, "lang").where("a < b").selectExpr("lang", "a", "b", "v * abs(za - zb) AS value")
    shares = terms.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("k"))
    one = shares.join(b, "lang").where("source <> b")
    one = one.groupBy("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b")).agg(F.expr("sum(k * (abs(p - zb) - abs(z - zb)))").alias("value"))
    mine = terms.selectExpr("lang", "term", "source AS a", "p AS pa", "z AS za")
    other = terms.selectExpr("lang", "term", "source AS b", "p AS pb", "z AS zb")
    both = mine.join(other, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.expr("sum(abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb))").alias("value"))
    total = absent.unionAll(one).unionAll(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return total.select("lang", ways.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def evaluated_terms(terms: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item and value (over 0) of terms in the buckets that best-first search has to open."""
    group = ["lang", "source"]
    best_first = W.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    buckets = terms.groupBy(*group, "bucket").agg(F.count_if(F.col("p") > F.col("q")).alias("held"), (F.max("p") - F.min("q")).alias("bound")).where("held > 0")
    buckets = buckets.select(*group, "bucket", "bound", (F.sum("held").over(best_first) - F.col("held") < k).alias("early"))
    value = terms.where("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), "bucket")
    early = value.join(buckets.where("early").select(*group, "bucket"), [*group, "bucket"]).drop("bucket")
    ranked = early.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("value"), "item"))).where(F.col("r") <= k)
    kth = ranked.where(F.col("r") == k).select(*group, F.col("value").alias("kth"))
    late = buckets.where("NOT early").join(kth, group, "left").where("kth IS NULL OR bound >= kth").select(*group, "bucket", "kth")
    return early.unionAll(value.join(late, [*group, "bucket"]).where("kth IS NULL OR value >= kth").drop("bucket", "kth"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: of each group, every other source of its language by
    distance, and the `top` terms by how far the group's share is over the language's."""
    groups, terms = scored_terms(docs, min_docs)
    rank = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(rank).cast("int").alias("rank"))

    return part(pair_distances(groups, terms), "pair").unionAll(part(evaluated_terms(terms, top), "term").where(F.col("rank") <= top))


def op12_source_divergence(docs: DataFrame) -> DataFrame:
    return divergence(docs)


#: The same in DuckDB SQL, with every kept term of every group.
SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
lt AS (SELECT lang, count(*) AS v, sum(ln) AS lang_total FROM kept GROUP BY lang),
gt AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN lt USING (lang) LEFT JOIN gt USING (lang, source)),
s AS (SELECT lang, source, term, coalesce(n, 0) AS n,
  1 + (CAST({SCALE} AS HUGEINT) * (coalesce(n, 0) + {SMOOTH})) // (total + {SMOOTH} * v) AS p, 1 + (CAST({SCALE} AS HUGEINT) * (ln + {SMOOTH})) // (lang_total + {SMOOTH} * v) AS q
  FROM g JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(dist.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}"""
