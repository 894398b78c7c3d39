"""Structured Streaming forms of the row checks.

The stateless checks (rendering, usable / over-window rows, path rules)
are Column expressions and run on a streaming DataFrame unchanged. Two
stateful operators are provided:

* `stream_eval_gate` — drop rows under 200 characters and keep the first row
  seen per (source, 200-character prefix): a streaming deduplication whose
  state is one 16-byte key per distinct prefix. On an endless stream give an
  event-time column: `dropDuplicatesWithinWatermark` then bounds the state;
  without one it grows with the distinct prefixes of the stream.
* `stream_row_counts` — running rows / usable / over-window counts per
  source (a streaming aggregation, update mode).

Sinks are files under the shared checkpoint folder, never the driver;
running values are read from the checkpoint's state.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgate import constants as K
from corpusgate.operators.profile import over_window, prefix_key, usable
from corpusgate.session import scratch_dir


def stream_eval_gate(rows: DataFrame, source: str = "source", text: str = "text",
                     event_time: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Usable rows, one per (source, prefix) — the first to arrive."""
    keyed = rows.where(usable(text)).withColumn("__pk", prefix_key(text))
    if event_time is not None:
        return (keyed.withWatermark(event_time, watermark)
                .dropDuplicatesWithinWatermark([source, "__pk"]).drop("__pk"))
    return keyed.dropDuplicates([source, "__pk"]).drop("__pk")


def stream_row_counts(rows: DataFrame, source: str = "source", text: str = "text",
                      sequence_length: int = K.DEFAULT_SEQUENCE_LENGTH) -> DataFrame:
    """Running per-source counts: rows, usable rows, rows over one window."""
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(usable(text)).alias("usable_rows"),
        F.count_if(over_window(text, sequence_length)).alias("long_rows"))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, output_mode: str = "append",
                 fmt: str = "parquet", keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Run a streaming DataFrame over everything available now and return
    what it wrote, read back as a batch DataFrame; in update mode the last
    values of each of `keys`. Output and checkpoint
    live under the session's shared checkpoint folder.

    File sinks only append. In update mode `stream` is an aggregation whose
    state is its result (counts, minima, maxima): its last values are read from
    the checkpoint by Spark's state reader. So no batch calls back into the
    driver's Python, which would take a server there."""
    base = f"{scratch_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"
    to = stream.writeStream.option("checkpointLocation", f"{base}/ckpt").outputMode(output_mode).trigger(availableNow=True)
    if output_mode == "append":
        to.format(fmt).option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).format(fmt).load(f"{base}/out")

    q = to.format("noop").start()
    q.awaitTermination()
    if q.lastProgress is None:  # no file, no batch, no state
        return spark.createDataFrame([], stream.schema)
    state = spark.read.format("statestore").load(f"{base}/ckpt")
    kinds = {f.name: f.dataType for f in stream.schema}
    parts = {"key": list(keys), "value": [c for c in kinds if c not in keys]}
    for part, columns in parts.items():
        if [f.dataType for f in state.schema[part].dataType] != [kinds[c] for c in columns]:
            raise ValueError(f"the state of {name} is not its result: {state.schema.simpleString()}")
        # a cast goes by place: all counts of a state have the same name
        state = state.withColumn(part, F.col(part).cast(T.StructType([T.StructField(c, kinds[c]) for c in columns])))
    return state.select("key.*", "value.*").select(*stream.columns)
