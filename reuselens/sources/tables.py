"""Parquet sources. Every read names its columns so the scan's
ReadSchema is pruned to what the query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    ship_package(spark)
    df = spark.read.parquet(path(sf_dir, name))
    if cols:
        df = df.select(*cols)
    if name == "events" and (not cols or "ts" in cols):
        # events.ts is TIMESTAMP_NTZ in the files; watermarks need TIMESTAMP.
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def first_n(spark: SparkSession, sf_dir: str, name: str, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of a table by ``key`` (TakeOrderedAndProject:
    a per-partition top-n, then one merge of n rows per partition)."""
    return load(spark, sf_dir, name).orderBy(key).limit(n)
