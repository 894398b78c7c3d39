"""Scans of the input tables (SC1).

A corpus is any table: parquet by default, any `spark.read` format otherwise.
Reading goes through `spark.read` so that column pruning and filter pushdown
reach the scan; nothing here collects or caches.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, path: str, fmt: str = "parquet", partition_filters: dict | None = None,
           **options) -> DataFrame:
    """Open one corpus (SC1 re-aimed): a table directory; config / split /
    revision live as directory partitions and are selected by equality
    filters, which Spark turns into partition pruning."""
    df = spark.read.format(fmt).options(**options).load(path)
    for column, value in (partition_filters or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def with_file_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """A stable per-row ordinal for sources without an id column: the file a
    row came from and its index inside it (parquet `_metadata` fields).
    Unlike `monotonically_increasing_id` it does not depend on how the scan
    was split, so "the first n rows" is reproducible."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.row_index").alias("row")))
