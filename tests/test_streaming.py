"""Streaming gate and running counts over a directory of parquet files."""
import pytest
from pyspark.sql import functions as F

from corpusgate.plans.streams import QUERIES
from corpusgate.streaming.gate import run_to_table, stream_eval_gate, stream_row_counts

LONG = "x" * 300


def test_stream_gate_and_counts(spark, tmp_path):
    rows = [("a", f"{i % 3:05d} {LONG}") for i in range(9)] + [("b", "short"), ("b", LONG)]
    df = spark.createDataFrame(rows, "source string, text string")
    for i in range(3):  # three files → three micro-batches
        df.where(f"hash(text, {i}) % 3 = {i} or true").limit(4 + i).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = {r.source: r.n for r in run_to_table(spark, stream_eval_gate(stream), "t_gate")
            .groupBy("source").count().withColumnRenamed("count", "n").collect()}
    written = spark.read.parquet(str(tmp_path / "in"))
    expected = {r.source: r.n for r in written.where("length(text) >= 200").groupBy("source")
                .agg(F.count_distinct("text").alias("n")).collect()}
    assert kept == expected
    counts = {r.source: (r.rows, r.usable_rows) for r in run_to_table(
        spark, stream_row_counts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
                                 .parquet(str(tmp_path / "in"))), "t_counts", output_mode="update").collect()}
    total = {r.source: (r["count"], None) for r in written.groupBy("source").count().collect()}
    assert {k: v[0] for k, v in counts.items()} == {k: v[0] for k, v in total.items()}


def _documents(spark, tmp_path, folder: bool) -> str:
    """A `documents` table as one file, or as a folder of part files, beside another table."""
    rows = [(i, f"{i % 7:05d} {LONG}" if i % 5 else "short", "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if folder:
        df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        df.toPandas().to_parquet(tmp_path / "documents.parquet")
    df.limit(1).write.parquet(str(tmp_path / "documents2.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("folder", [True, False])
def test_gate_query_reads_a_table_of_any_layout(spark, tmp_path, folder):
    path = _documents(spark, tmp_path, folder)
    expected = (spark.read.parquet(f"{path}/documents.parquet").where("length(text) >= 200").groupBy("source")
                .agg(F.count_distinct("text").alias("kept")).collect())
    assert sorted(QUERIES["stream_eval_gate"](spark, path).collect()) == sorted(expected)


@pytest.mark.parametrize("folder", [True, False])
def test_count_query_reads_a_table_of_any_layout(spark, tmp_path, folder):
    path = _documents(spark, tmp_path, folder)
    expected = spark.read.parquet(f"{path}/documents.parquet").groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.length("text") >= 200).alias("usable_rows"),
        F.lit(0).cast("long").alias("long_rows")).collect()
    assert sorted(QUERIES["stream_row_counts"](spark, path).collect()) == sorted(expected)


def test_counts_need_no_server_in_the_driver(spark, tmp_path, monkeypatch):
    def refused(*_):
        raise OSError("no port may be opened")

    monkeypatch.setattr("pyspark.java_gateway.ensure_callback_server_started", refused)
    path = _documents(spark, tmp_path, folder=True)
    spark.createDataFrame([(99, None, None), (100, "y" * 5000, None)], "doc_id long, text string, source string") \
        .write.mode("append").parquet(f"{path}/documents.parquet")
    got = {r.source: tuple(r)[1:] for r in QUERIES["stream_row_counts"](spark, path).collect()}
    assert got == {"a": (30, 24, 0), "b": (30, 24, 0), None: (2, 1, 1)}


def test_counts_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["stream_row_counts"](spark, str(tmp_path))
    assert got.columns == ["source", "rows", "usable_rows", "long_rows"] and got.collect() == []
