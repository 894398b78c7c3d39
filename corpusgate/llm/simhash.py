"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: words (A-Z lowered, runs of anything but ASCII white space) in
shingles of `shingle` words, repeats included; each shingle's XXH64 (seed 42)
votes on 64 bits, and a bit is 1 if set in over half of the votes.

Linking: documents with one fingerprint are first folded into that fingerprint.
Two fingerprints within `radius` bits have a common point within half of it, so
each distinct fingerprint emits all variants within radius / 2 bits (65 for
radius 2), and the variants are shuffled. No variant can gather more than one
ball of fingerprints, whatever the data, so no bucket is large. Neighbours in a
bucket's sorted order are linked (that chain connects the bucket with one link
per member instead of all pairs; all members of a radius-2 ball lie within 2
bits of each other), deduplicated and verified by their bit distance. Connected
components of the links give each document the smallest doc_id it can reach.

Cases: a text with fewer words than a shingle is one shingle; null texts and
texts without words have fingerprint 0, which links like any other; repeated
rows each get their row; null doc_ids get their class's smallest id that is not
null; an empty table gives no row.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import Batches, spare, staged, table, texts_of
from corpusgate.llm.graph import components

SHINGLE = 3
RADIUS = 2
SEED = 42
PIECE = 1 << 15  # shingles whose votes are counted at a time


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text, as a signed integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1:].tolist()
    starts = [0, *(ends[:len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for a in range(0, len(starts), PIECE):
        hashes = np.array([digest(flat[x:y], SEED) for x, y in zip(starts[a:a + PIECE], stops[a:a + PIECE])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """(doc_id, row, text_hash, fp) of every row of `docs` (doc_id, text); row: the column of that name, or null."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "row", "text_hash")],
                 pa.array([fingerprint(t, shingle) for t in texts_of(batch)], pa.int64())],
                ["doc_id", "row", "text_hash", "fp"])

    number = F.col(row) if row else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"),
                       F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id bigint, row bigint, text_hash bigint, fp bigint")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (`fp`) within `radius` bits of each other.

    For an odd radius a ball reaches further than asked; for radii above 2 not
    all members of a bucket are that close. Then each member is compared with
    the whole of its bucket, whose size the ball bounds.
    """
    half = (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for n in range(half + 1) for bits in combinations(range(64), n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    # dealt out before each row becomes a ball: a plan sized by the few bytes before would use a few tasks
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    balls = fps.select("fp", F.explode(F.array([F.col("fp").bitwiseXOR(F.lit(m)) for m in masks])).alias("variant"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    if radius == 2:
        order = Window.partitionBy("variant").orderBy("fp")
        pairs = balls.select(F.lag("fp").over(order).alias("a"), F.col("fp").alias("b")).filter("a is not null")
    else:
        pairs = (balls.select("variant", F.col("fp").alias("a")).join(balls.withColumnRenamed("fp", "b"), "variant")
                 .filter("a < b").select("a", "b"))
    return pairs.filter(close).distinct()


def classes(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, first, root): every fingerprint of `found` (doc_id, fp), its smallest doc_id and its class."""
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), radius))
    # classes of several fingerprints only; a fingerprint alone is its own class
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: doc_id, fp, component_id."""
    found = staged(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    member = classes(found, radius)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each class: of smallest doc_id (null last), then smallest text hash, then first read.

    The rows are numbered in a staged copy, so ids may be null or stand on many rows, and a lost executor
    changes no number."""
    row = spare(docs, "row_number")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = staged(fingerprints(numbered, shingle, row), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row")
    heads = (found.join(classes(found, radius), "fp").groupBy("root").agg(F.min(order)["row"].alias("head"))
             .select("head"))
    # as many heads as classes: by size Spark would send them whole to every executor on small inputs only
    return numbered.join(staged(heads, "heads").hint("merge"), F.col(row) == F.col("head"), "left_semi").drop(row)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
