"""Input tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the cores if its files have fewer parts than those; a table of many parts isn't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df
