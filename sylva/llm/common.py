"""Helpers that the training-data operators share: tables, the shared folder, cuts of the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="sylva-"))
    return base.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages and retries start from the files."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files behind df
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*dfs: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for df in dfs:
        path = getattr(df, "_cut_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_col(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """Partitions that hold about `each` bytes, and at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-int(total_bytes) // each))
