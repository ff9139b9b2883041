"""The corpus pipeline: quality rules, one document of each group of near copies, no repeated passages, packed bins.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage a null text is empty, a null doc_id is an id like others, columns that no stage knows pass through (but
for the last, which returns its own), and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import jaccard, packing, quality, suffixes
from sylva.llm.common import cut, table

#: Most passages of over 50 words are longer than this many bytes; those of very short words aren't, and stay.
PASSAGE_BYTES = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule. Repeated rows are judged each; empty texts go, as they have no words."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the Jaccard join (five words, 0.8), the one of the least doc_id.

    Null ids come last; of the rows with that id and that text one stays. Texts without words are alike only if equal.
    """
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE_BYTES or more that stand in more than one place; every copy of them goes.

    Repeated rows are places of their own. A text of which nothing is left stays, empty.
    """
    return suffixes.remove_repeats(docs, PASSAGE_BYTES)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each row with its bin; an empty text has one piece, its end token, and repeated rows are packed each."""
    return packing.op2_best_fit(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packed_bins", packed_bins)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Similarity classes and suffix sorting aren't SQL; tests/llm holds the whole pipeline against a brute-force version.
ORACLE_SQL = None
