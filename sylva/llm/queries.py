"""The subpackage's queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import alignment, bytebpe, divergence, editprint, jaccard, licences, lmscore, packing, quality, suffixes, sumsquares, tokenfile, urlfilter
from sylva.llm.common import table
from sylva.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers that the machine offers; SYLVA_TOKENIZERS names another folder."""
    folder = os.environ.get("SYLVA_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.op1_ctw_score(table(spark, sf_dir, "documents"))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2_best_fit(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = importlib.import_module("public_tokenizers").PATTERN
    return bytebpe.op3_byte_bpe(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), pattern)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op4_token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.op5_edit_fingerprints(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op6_jaccard_join(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op7_suffix_dedup(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op8_url_filter(table(spark, sf_dir, "pages"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op9_licence_scan(table(spark, sf_dir, "documents"), windows=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10_quality_rules(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op11_token_alignment(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op12_source_divergence(table(spark, sf_dir, "documents"))


def op13_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sumsquares.op13_sum_of_squares(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ctw_score, op2_best_fit, op3_byte_bpe, op4_token_files, op5_edit_fingerprints, op6_jaccard_join, op7_suffix_dedup, op8_url_filter, op9_licence_scan, op10_quality_rules, op11_token_alignment, op12_source_divergence, op13_sum_of_squares)}
