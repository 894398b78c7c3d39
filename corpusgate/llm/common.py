"""Shared pieces of the operators: table reads, staged tables, worker caches, word rules."""
from __future__ import annotations

import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpusgate
from corpusgate.session import remove, scratch_dir

# Task functions travel inside the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(corpusgate)

WORD = r"[^\x20\x09-\x0D]+"  # a word: a run of anything but ASCII white space; bytes.split() cuts the same


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once into the session's part of the shared checkpoint folder and read back: later jobs
    neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstaged(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    remove(df.sparkSession, df.staged_path)


def spare(docs: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores in front until no column of `docs` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_field(df: DataFrame, name: str, ddl: str) -> T.StructType:
    """The schema of `df` and one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, T.DataType.fromDDL(ddl))])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def low_hash(share: Column | float, *key: str) -> Column:
    """Whether the hash of `key` lies in the lowest `share` of all hashes."""
    return F.shiftrightunsigned(F.xxhash64(*key), 1) / float(1 << 63) <= share


def drawn(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The n rows whose hash of `key` is lowest (ties by key).

    Only rows in the lowest 4 n / count of all hashes are sorted: that some n
    are among them is certain but for chances far below one in a billion, and
    what meets in one task stays a few n however large the table is."""
    part = df.filter(low_hash(4.0 * n / max(1, df.count()), *key))
    return part.orderBy(F.xxhash64(*key), *key).limit(n)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker and is shared by its tasks."""
    store = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast `value` (of proven size); the result gives it in a task, unpickled once per worker."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    key = f"shared_{uuid.uuid4().hex}"
    return lambda: worker_cache(key, lambda: pickle.loads(blob.value))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


Batches = Iterator[pa.RecordBatch]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each between single spaces, and where each starts (one entry more than texts)."""
    buf = b" " + b" ".join(texts) + b" "
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(buf, np.uint8), np.concatenate([[0], np.cumsum(lens + 1)])
