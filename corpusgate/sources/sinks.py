"""Report and configuration sinks (SC8, SC9).

Reports and configurations are rows of (key, text) in a few JSON-lines files,
written by the executors and never gathered on the driver. One text file per
key, in a folder of its own, is an option for readers that want files by name.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate import constants as K


def write_reports(reports: DataFrame, out_dir: str, key: str, text: str = "markdown", mode: str = "overwrite",
                  per_key: bool = False) -> None:
    """SC8: Markdown per key (manifest, pull request). The submission report
    appends (`mode="append"`), the dataset report overwrites. Where nothing was
    written, the fixed "nothing to report" text is; the reports run once."""
    spark = reports.sparkSession
    note = spark.createDataFrame([(None, K.NOTHING_TO_REPORT)], f"`{key}` string, `{text}` string")
    if per_key:
        reports.select(F.col(key).cast("string").alias(key), F.col(text).alias("value")).write.mode(mode).partitionBy(
            key).text(out_dir)
        return
    reports.select(F.col(key).cast("string").alias(key), text).write.mode(mode).json(out_dir)
    if spark.read.schema(note.schema).json(out_dir).isEmpty():  # reads what was written, not the reports again
        note.coalesce(1).write.mode("append").json(out_dir)


def committed(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch, rows) of every batch that was appended to `out_dir` in whole."""
    schema = "rows bigint, batch string"
    try:
        return spark.read.schema(schema).json(f"{out_dir}/commits")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":  # nothing was committed yet
            raise
        return spark.createDataFrame([], schema)


def append_batch(rows: DataFrame, out_dir: str, batch: str) -> bool:
    """SC8, append that can be repeated: the rows of one batch, under its id, then a commit record.

    A batch that has its record is left alone (False). One without, because a run broke off, is written anew in
    the same place. Readers (`read_batches`) see a batch when its record is there, so in whole or not at all."""
    spark = rows.sparkSession
    if not batch or set(batch) & set("/=%\\\"'"):
        raise ValueError(f"a batch id is part of a path: {batch!r}")
    if not committed(spark, out_dir).filter(F.col("batch") == batch).isEmpty():
        return False
    path = f"{out_dir}/data/batch={batch}"
    rows.write.mode("overwrite").json(path)
    n = spark.read.schema(rows.schema).json(path).count()
    spark.createDataFrame([(n,)], "rows bigint").coalesce(1).write.mode("overwrite").json(f"{out_dir}/commits/batch={batch}")
    return True


def read_batches(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """The rows of all committed batches and their `batch`; the other folders are not opened."""
    known = F.broadcast(committed(spark, out_dir).filter(F.col("rows") >= 0).select("batch"))  # one row per batch
    return spark.read.schema(f"{schema}, batch string").json(f"{out_dir}/data").join(known, "batch", "left_semi")


def write_configs(docs: DataFrame, out_dir: str, per_name: bool = False) -> None:
    """SC9: one configuration document per manifest, as (name, document, config)
    rows; `per_name` also writes the documents as text, in a folder per task name."""
    document = F.concat(F.col("header"), F.col("config_json"), F.lit("\n"))
    docs.select("name", document.alias("document"), F.col("config_json").alias("config")).write.mode(
        "overwrite").json(f"{out_dir}/configs")
    if per_name:
        docs.select("name", document.alias("value")).write.mode("overwrite").partitionBy("name").text(
            f"{out_dir}/documents")
