"""Corpora as a partitioned store (SC1): config, split and revision are directories.

A store is written once per session and input and then only read, so a request
for some corpora opens their directories and no others: equality on a partition
column prunes when the plan is made, a join with a table of requests when it
runs. A null or empty partition value is written under `default_`.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgate.session import scratch_dir

EMPTY = "default_"
_OPEN: dict[tuple, tuple[str, StructType]] = {}


def ingest(rows: DataFrame, partitions: list[str]) -> tuple[str, StructType]:
    """`rows` written as Parquet, partitioned by the text columns `partitions`: where, and with what columns."""
    spark = rows.sparkSession
    rows = rows.withColumns({p: F.coalesce(F.nullif(F.col(p).cast("string"), F.lit("")), F.lit(EMPTY)) for p in partitions})
    path = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    rows.write.partitionBy(*partitions).parquet(path)
    data = [f for f in rows.schema.fields if f.name not in partitions]
    return path, StructType([*data, *[rows.schema[p] for p in partitions]])  # given when read, so that '01' stays text


def located(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame],
            partitions: list[str]) -> tuple[str, StructType]:
    """Folder and columns of the store `name` of the input folder `source`: `make()` is ingested at its first use in
    a session."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _OPEN:
        _OPEN[key] = ingest(make(), partitions)
    return _OPEN[key]


def opened(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame], partitions: list[str]) -> DataFrame:
    """The rows of the store."""
    path, schema = located(spark, name, source, make, partitions)
    return spark.read.schema(schema).parquet(path)
