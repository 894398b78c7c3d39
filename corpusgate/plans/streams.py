"""Streaming queries: the eval gate and running counts over the
`documents` table read as a stream of parquet files."""
from __future__ import annotations

from pyspark.sql import functions as F

from corpusgate.sources.tables import table
from corpusgate.streaming.gate import run_to_table, stream_eval_gate, stream_row_counts


def _document_stream(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), f"{sf_dir.rstrip('/')}/documents.parquet"
    # the table is a folder of part files, or one file: then a pattern, as a plain path has to be a folder
    if [f.rsplit("/", 1)[-1] for f in docs.inputFiles()] == ["documents.parquet"]:
        path = f"{path[:-1]}[t]"
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)


def q_stream_eval_gate(spark, sf_dir):
    """Rows the streaming eval gate keeps, counted per source. Which row of a
    duplicate group survives depends on arrival; how many survive does not."""
    kept = run_to_table(spark, stream_eval_gate(_document_stream(spark, sf_dir)), "eval_gate")
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))


def q_stream_row_counts(spark, sf_dir):
    return run_to_table(spark, stream_row_counts(_document_stream(spark, sf_dir), sequence_length=1024),
                        "row_counts", output_mode="update")


QUERIES = {
    "stream_eval_gate": q_stream_eval_gate,
    "stream_row_counts": q_stream_row_counts,
}

ORACLES = {
    "stream_eval_gate": """
select source, count(distinct substring(text, 1, 200)) as kept from documents where length(text) >= 200
group by source""",
    "stream_row_counts": """
select source, count(*) as rows, count(*) filter (where length(text) >= 200) as usable_rows,
  count(*) filter (where length(text) > 1024 * 4) as long_rows from documents group by source""",
}
