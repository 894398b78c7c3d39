"""Join helpers."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from corpusgate.session import scratch_dir

PART_ROWS = 200_000

def sized(df: DataFrame, name: str) -> DataFrame:
    """`df`, an already reduced table, written once to the shared checkpoint
    folder and read back.

    Spark then knows its bytes and broadcasts it only below
    `spark.sql.autoBroadcastJoinThreshold`; above it the join shuffles on its
    keys. Nothing is cached on executors, and what follows neither recomputes
    the table nor depends on the executors that made it."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(*tables: DataFrame) -> int:
    """How many partitions keep `PART_ROWS` rows of the tables, or fewer, in each: what a task holds while it groups
    or sorts then stays the same however many rows there are."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where null equals null (`<=>`), keeping the left
    key columns."""
    r = right.select(*[right[c].alias(f"__r_{c}") if c in keys else right[c] for c in right.columns])
    cond = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys]
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys]) if how not in ("left_semi", "left_anti") else out
