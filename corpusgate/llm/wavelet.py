"""Operator 3: token ids in wavelet-matrix files, one succinct matrix per shard.

Writing. Documents are range-partitioned by doc_id (nulls first) and text and sorted;
each task encodes its texts, appends the end id, and closes a shard at the first
document border after `SHARD` tokens, so a task's shards follow each other and
every shard is one row of one file in the output folder:

    part, shard     the partition and the shard's place in it; together the order of the corpus
    start           tokens in the earlier shards of the partition
    n_tokens        tokens of the shard
    doc_ids         int64 array, null where the document's id is null
    doc_tokens      int64 array: tokens of each document, end id included
    zeros           int64 array: zero bits of each plane, highest plane first
    planes          binary array: the bit-planes, packed, highest first
    ranks           binary array: per plane, little-endian uint32 one-bits before each block of 512 bits

The files are Parquet (zstd), written by Spark's own commit protocol, so they
can lie in any store and a lost executor's shards are simply written again.

Reading. `Matrix` gives access to a token, the count of an id in a range and the
place of its k-th occurrence from planes and ranks alone; `decode` gives all ids.
`read` returns one row per document with its first position in the corpus; the
only thing gathered at once is the token total of each partition.

Cases: null and empty texts are documents of just the end id; documents with
the same id are ordered by text; an empty table writes no shard; a document
longer than a shard makes a longer shard; ids beyond 16 bits get more planes.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, table, worker_cache
from corpusgate.llm.token_counts import tokenizer_path
from corpusgate.llm.tokens import CACHE, Pieces
from corpusgate.session import scratch_dir

SHARD = 1 << 18  # tokens; small enough that a plane and its ids stay in a core's cache
END = 2
BLOCK = 512  # bits of a rank block
HEAD = 128   # characters of a text that help to range documents
LAYOUT = ("part int, shard int, start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
          "zeros array<bigint>, planes array<binary>, ranks array<binary>")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(ids: np.ndarray, bits: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Zero counts, packed planes and rank directories of a wavelet matrix, highest plane first."""
    zeros, planes, ranks = [], [], []
    for plane in range(bits - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << plane)) != 0
        packed = np.packbits(one)
        zeros.append(int(len(ids) - np.count_nonzero(one)))
        planes.append(packed.tobytes())
        ranks.append(directory(packed))
        ids = np.concatenate([np.compress(~one, ids), np.compress(one, ids)])
    return zeros, planes, ranks


def directory(packed: np.ndarray) -> bytes:
    words = np.zeros(-(-len(packed) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    words[:len(packed)] = packed
    per = np.bitwise_count(words.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per)]).astype("<u4").tobytes()


class Matrix:
    """Rank/select queries on one shard's row."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, list(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (7 - (i & 7)) & 1

    def rank1(self, plane: int, i: int) -> int:
        """One-bits before place i of a plane."""
        block, packed = i // BLOCK, self.planes[plane]
        total = int(self.ranks[plane][block]) + int(_ONES[packed[block * BLOCK // 8:i >> 3]].sum())
        return total + (int(_ONES[packed[i >> 3] >> (8 - (i & 7))]) if i & 7 else 0)

    def select(self, plane: int, k: int, one: bool) -> int:
        """The place of the k-th (from 0) one- or zero-bit of a plane."""
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(plane, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for plane in range(len(self.planes)):
            b, ones = self.bit(plane, i), self.rank1(plane, i)
            value = value << 1 | b
            i = self.zeros[plane] + ones if b else i - ones
        return value

    def narrow(self, value: int, start: int, stop: int) -> tuple[int, int]:
        """The range that the occurrences of an id in [start, stop) hold after the last plane."""
        if value >> len(self.planes):
            return 0, 0
        for plane in range(len(self.planes)):
            a, b = self.rank1(plane, start), self.rank1(plane, stop)
            if value >> (len(self.planes) - 1 - plane) & 1:
                start, stop = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id occurs in [start, stop)."""
        a, b = self.narrow(value, start, self.n if stop is None else stop)
        return b - a

    def locate(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        a, b = self.narrow(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = bool(value >> (len(self.planes) - 1 - plane) & 1)
            i = self.select(plane, i - self.zeros[plane] if one else i, one)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane says which side an id came from."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for up, (packed, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            one = np.unpackbits(packed, count=self.n).view(bool)
            before = np.empty_like(ids)
            before[np.flatnonzero(~one)] = ids[:zeros]
            before[np.flatnonzero(one)] = ids[zeros:] | kind(1 << up)
            ids = before
        return ids


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard: int = SHARD, remembered: int = CACHE) -> None:
    """Encode `docs` (doc_id, text) in ascending doc_id order into wavelet-matrix files under `path`.
    remembered: pieces that each worker keeps with their ids; fewer take less memory and more time."""
    def run(batches: Batches) -> Batches:
        pieces = worker_cache(f"pieces_{tokenizer}_{remembered}", lambda: Pieces(tokenizer, limit=remembered))
        kind = np.uint16 if pieces.code == "H" else np.uint32
        tail = np.array([end], kind).tobytes()
        bits = max(1, int(max(pieces.lib.get_vocab_size() - 1, end)).bit_length())
        names, sizes, parts, total, number, start, place = [], [], [], 0, 0, 0, None

        def close():
            zeros, planes, ranks = build(np.frombuffer(b"".join(parts), kind), bits)
            return pa.RecordBatch.from_pylist([{
                "part": place, "shard": number, "start": start, "n_tokens": total, "doc_ids": names, "doc_tokens": sizes,
                "zeros": zeros, "planes": planes, "ranks": ranks}], schema)

        for batch in batches:
            place = batch.column("part")[0].as_py() if len(batch) else place
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), pieces.column(batch.column("text"))):
                parts += [ids, tail]
                names.append(doc_id)
                sizes.append((len(ids) + len(tail)) // len(tail))
                total += sizes[-1]
                if total >= shard:
                    yield close()
                    names, sizes, parts, start, total, number = [], [], [], start + total, 0, number + 1
        if names:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
                        ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
                        ("ranks", pa.list_(pa.binary()))])
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               # the beginning of the text orders as the text does and lets rows of one id (or none) spread
               .repartitionByRange("doc_id", F.substring("text", 1, HEAD)).sortWithinPartitions("doc_id", "text")
               .withColumn("part", F.spark_partition_id()))
    ordered.mapInArrow(run, LAYOUT).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(LAYOUT).parquet(path)
    # one number per writing task: bounded by the number of partitions, not by the data
    totals = shards.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect()
    before = dict(zip([r[0] for r in totals], np.concatenate([[0], np.cumsum([r[1] for r in totals])]).tolist()))
    shared = spark.sparkContext.broadcast(before)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                raw = Matrix(row["n_tokens"], row["zeros"], row["planes"], row["ranks"]).decode().astype("<u4")
                cuts = np.concatenate([[0], np.cumsum(row["doc_tokens"])])
                view, ends = memoryview(raw).cast("B"), (cuts * 4).tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(cuts[:-1] + shared.value[row["part"]] + row["start"], pa.int64()),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())})

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read(spark, path)
