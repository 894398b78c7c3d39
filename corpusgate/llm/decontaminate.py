"""Operator 9: benchmark decontamination by a broadcast hash set of normalised n-grams.

Words are runs of ASCII digits, letters (A-Z lowered) and non-ASCII characters;
everything else separates. An item's windows are its runs of `n` consecutive
words; an item of fewer words, but not none, is one window. The windows go into
a hash set whose keys are exact word sequences, so a hit is verified by the
look-up itself. Every task scans whole documents: a word inside any occurrence
of any window is hit.

The benchmark is a stated query set. Its size is checked: it is read in blocks
of at most `block_bytes` of text (one item at least). Each block is broadcast,
scanned by one pass whose hits are written, and dropped, so the driver holds two
blocks, an executor and each worker one, however large the benchmark is.

Cases: a null text has no words; an item without words (or null) has no window;
repeated items are counted by distinct item_id, and a null item_id counts as the
empty text; repeated documents each give their own row; an empty benchmark hits
nothing; extra columns pass through untouched.
"""
from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, spare, staged, table, with_columns, with_field, worker_cache

WINDOW = 10
BLOCK_BYTES = 32 << 20
LEAK = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: int, stop: int>>>"
KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                  ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
# byte -> byte: A-Z to a-z, ASCII that is neither digit nor letter to a space, the rest as it is
_NORMAL = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class WindowSet:
    """The windows of a block of items: word ids, and for each length the id sequences with their items."""

    def __init__(self, items: Iterable[tuple[str, str | None]], n: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[str]]] = {}
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            seq = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words], np.int32)
            k = min(n, len(seq))
            for i in range(len(seq) - k + 1):
                owners = self.windows.setdefault(k, {}).setdefault(seq[i:i + k].tobytes(), [])
                if item_id not in owners[-1:]:
                    owners.append(item_id)
        self.shortest = min(self.windows, default=0)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none) and the items whose windows occur."""
        if not self.windows or len(words) < self.shortest:
            return None, set()
        seq = np.fromiter(map(self.ids.get, words, (0,) * len(words)), np.int32, len(words))
        # only runs of benchmark words as long as the shortest window can hold one
        edge = np.flatnonzero(np.diff(np.concatenate([[0], seq != 0, [0]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = np.flatnonzero(ends - starts >= self.shortest)
        hit, found = None, set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            raw = seq[a:b].tobytes()
            for k, known in self.windows.items():
                for i in range(b - a - k + 1):
                    owners = known.get(raw[4 * i:4 * (i + k)])
                    if owners:
                        if hit is None:
                            hit = np.zeros(len(words), bool)
                        hit[a + i:a + i + k] = True
                        found.update(owners)
        return hit, found


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of at most `block_bytes` of text (one item at least), one at a
    time; an empty benchmark is one empty block."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    for item_id, text in rows.toLocalIterator():
        n = len(text or "") * 4 + 64
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += n
    yield block


def only(spark: SparkSession, windows: WindowSet) -> tuple[Callable[[], WindowSet], Callable[[], None]]:
    """The window set in a task, and how to drop it on the driver and all executors. A worker holds one set at a
    time: a task of the next pass puts its own in the place of the last."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(windows))
    token = uuid.uuid4().hex

    def here() -> WindowSet:
        held = worker_cache("leak_windows", dict)
        if token not in held:
            held.clear()
            held[token] = pickle.loads(blob.value)
        return held[token]

    return here, blob.destroy


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES,
         out: str = "leak") -> DataFrame:
    """`docs` with a struct column `out`: n_words, n_hit, items (sorted distinct), spans (half-open word ranges).

    A benchmark of one block is one narrow pass. Of more, each block scans a staged, numbered copy of the
    texts; what it hits is written before the next block is read, and the block is dropped; the hits of a row,
    as many as it has words at most for each block, are put together at the end.
    """
    spark = docs.sparkSession
    out = spare(docs, out)
    blocks = blocks_of(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        windows, _ = only(spark, WindowSet(block, n))

        def whole(batches: Batches) -> Batches:
            for batch in batches:
                rows = []
                for text in batch.column("text").to_pylist():
                    words = normal_words(text)
                    rows.append(leak_of(len(words), *windows().scan(words)))
                yield with_columns(batch, **{out: pa.array(rows, KIND)})

        return docs.mapInArrow(whole, with_field(docs, out, LEAK))

    row, found = spare(docs, "row_number"), spare(docs, "hits")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts, hits = numbered.select(F.col(row).alias("row"), "text"), None
    while block is not None:
        windows, drop = only(spark, WindowSet(block, n))

        def part(batches: Batches, windows=windows) -> Batches:
            for batch in batches:
                rows, leaks = [], []
                for number, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                    words = normal_words(text)
                    hit, items = windows().scan(words)
                    if hit is not None:
                        rows.append(number)
                        leaks.append(leak_of(len(words), hit, items))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(leaks, KIND)], ["row", "leak"])

        each = staged(texts.mapInArrow(part, f"row bigint, leak {LEAK}"), "leaks")
        drop()
        hits = each if hits is None else hits.unionByName(each)
        block, following = following, next(blocks, None)
    together = hits.groupBy("row").agg(F.collect_list("leak").alias(found)).withColumnRenamed("row", row)

    def joined(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for text, leaks in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist()):
                size = len(normal_words(text))
                hit = np.zeros(size, bool) if leaks else None
                for leak in leaks or []:
                    for span in leak["spans"]:
                        hit[span["start"]:span["stop"]] = True
                rows.append(leak_of(size, hit, {i for leak in leaks or [] for i in leak["items"]}))
            kept = batch.select([c for c in batch.schema.names if c not in (row, found)])
            yield with_columns(kept, **{out: pa.array(rows, KIND)})

    full = numbered.join(together, row, "left").select(*numbered.columns, found)
    return full.mapInArrow(joined, with_field(docs, out, LEAK))


def leak_of(size: int, hit: np.ndarray | None, items: set[str]) -> dict:
    """A row's result from the words that are hit (None: none)."""
    if hit is None:
        return {"n_words": size, "n_hit": 0, "items": [], "spans": []}
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))).tolist()
    return {"n_words": size, "n_hit": int(hit.sum()), "items": sorted(items),
            "spans": [{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2])]}


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """`docs` without the rows in which a benchmark window occurs."""
    out = spare(docs, "leak")
    return scan(docs, benchmark, n, out=out).filter(F.col(out)["n_hit"] == 0).drop(out)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """`docs` whose texts have lost the hit words; rows without a hit keep their text as it is.

    In a row with a hit, the normalised words that stay are joined by one space.
    """
    out = spare(docs, "leak")
    found = scan(docs, benchmark, n, out=out)

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            texts = []
            for text, leak in zip(batch.column("text").to_pylist(), batch.column(out).to_pylist()):
                if leak["n_hit"]:
                    words = normal_words(text)
                    for span in reversed(leak["spans"]):
                        del words[span["start"]:span["stop"]]
                    text = b" ".join(words).decode("utf-8", "surrogatepass")
                texts.append(text)
            kept = batch.select([c for c in batch.schema.names if c != out])
            yield kept.set_column(kept.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return found.mapInArrow(cut, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    leak = F.col("leak")
    return found.select(
        "doc_id", leak["n_words"].alias("n_words"), leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"))
