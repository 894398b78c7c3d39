"""Benchmark-item contamination (RA3): which training rows contain a
benchmark item's text verbatim, and which share its word n-grams.

Exact containment reads the rows' texts once: the items become an Aho–Corasick
automaton that finds all of them, of any length, in one walk over a text. The
items are read in blocks of at most `BLOCK_BYTES` of text (one item at least);
a block is broadcast, each worker builds its automaton once, and with several
blocks each one's hits are written and the block dropped before the next. No
row is ever paired with an item that it does not contain.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.joins import sized
from corpusgate.functions.workers import held

BLOCK_BYTES = 2 << 20  # a worker's automaton has a node of some 40 bytes per character
TOKEN_SPLIT = r"\s+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, TOKEN_SPLIT), lambda t: t != "")


def ngram_overlap(items: DataFrame, rows: DataFrame, n: int = 8, item_id: str = "item_id", item_text: str = "text",
                  row_id: str = "doc_id", row_text: str = "text") -> DataFrame:
    """(item_id, row_id, shared, total): how many of an item's distinct word
    n-grams (lower-cased) occur in a row, for every pair that shares one. Items
    and rows of fewer than n words have none.

    An n-gram travels as two 64-bit hashes. The items' n-grams are a table of
    known size, so the join keeps the rows' n-grams where they are while that
    table is small; only pairs that share one are counted, per (item, row)."""
    def grams(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        words = tokens(F.lower(F.col(text)))
        cut = df.select(F.col(key).alias(name), words.alias("w")).where(F.size("w") >= n)
        at = F.explode(F.sequence(F.lit(1), F.size("w") - (n - 1)))
        gram = F.array_join(F.slice("w", F.col("i"), n), " ")
        return cut.select(name, "w", at.alias("i")).select(
            name, F.xxhash64(gram).alias("g1"), F.xxhash64(F.lit(1), gram).alias("g2"))

    wanted = sized(grams(items, item_id, item_text, "item_id").distinct(), "item-ngrams")
    total = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    shared = (grams(rows, row_id, row_text, "row_id").join(wanted, ["g1", "g2"])
              .groupBy("item_id", "row_id").agg(F.count_distinct("g1", "g2").alias("shared")))
    return shared.join(total, "item_id").select(F.col("item_id").alias(item_id), F.col("row_id").alias(row_id),
                                                "shared", "total")


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """(n, item_text) rows in blocks of at most `block_bytes` of text, one at a time."""
    block, size = [], 0
    for n, text in items.select("n", "item_text").toLocalIterator():
        if block and size + 4 * len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((n, text))
        size += 4 * len(text)
    if block:
        yield block


def automaton(block: list[tuple[int, str]]):
    """Every text of the block, with the numbers of the items that have it."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for n, text in block:
        if not found.exists(text):
            found.add_word(text, [])
        found.get(text).append(n)
    found.make_automaton()
    return found


def contamination(items: DataFrame, rows: DataFrame, item_id: str = "item_id", item_text: str = "text",
                  row_id: str = "doc_id", row_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, row_id) for every row whose text contains the item's text.

    An item without any token (null, empty, white space only) is contained in
    nothing: it would match every row and say nothing about any. Repeated items
    and repeated rows each give their own pairs."""
    it = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text"))
    it = sized(it.where(F.size(tokens(F.col("item_text"))) > 0).withColumn("n", F.monotonically_increasing_id()), "items")
    texts = rows.select(F.col(row_id).alias("row_id"), F.col(row_text).alias("row_text"))
    ddl = f"row_id {texts.schema['row_id'].dataType.simpleString()}, n bigint"
    sc = rows.sparkSession.sparkContext
    blocks = blocks_of(it, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    several, hits = following is not None, None
    while block is not None:
        blob, token = sc.broadcast(block), uuid.uuid4().hex

        def scan(batches, blob=blob, token=token):
            for batch in batches:
                found = held("items", token, lambda: automaton(blob.value))
                at, numbers = [], []
                for i, text in enumerate(batch.column("row_text").to_pylist()):
                    if text and len(found):
                        here = {n for _, owners in found.iter(text) for n in owners}
                        at += [i] * len(here)
                        numbers += here
                yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(at, pa.int64())),
                                                  pa.array(numbers, pa.int64())], ["row_id", "n"])

        each = texts.mapInArrow(scan, ddl)
        if several:
            each = sized(each, "item-hits")
            blob.destroy()
        hits = each if hits is None else hits.unionByName(each)
        block, following = following, next(blocks, None) if several else None
    return hits.join(it.select("n", "item_id"), "n").select(F.col("item_id").alias(item_id), F.col("row_id").alias(row_id))
