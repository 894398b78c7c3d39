"""Weighted mixture of corpora (RA1): how many rows each source contributes
to a training mix of N rows, and which rows.

* quota_s = floor(w_s · N), topped up by largest remainder (ties by source)
  until the quotas sum to N, never past a source's row count; what a source
  cannot give is shared again among the others;
* N defaults to the largest mix no source under-fills: min_s floor(n_s / w_s);
* within a source, rows are taken in the order of md5("<seed>:<id>") (then
  id), a reproducible pseudo-random order.

Picking "the first q rows of a source in hash order" is an exact top-k with
a k that differs per source and may be most of a hot source, so it is not a
window over the whole source. Instead: a histogram of rows per (source,
hash bucket) — the first 5 hex digits, 2^20 buckets — finds, per source, the
bucket where the quota runs out. Rows in earlier buckets are taken whole,
rows in later ones dropped, and only the one boundary bucket per source is
ranked row by row. Every step is an aggregate with map-side combine or a
window over one bucket, so a source holding most rows spreads over all tasks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 5


def pick_key(seed: str, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def quotas(counts: DataFrame, weights: DataFrame, total: int | None = None) -> DataFrame:
    """counts(source, n) ⋈ weights(source, weight) → (source, n, weight, quota, shortfall).

    A source gives at most its n rows; what it cannot give goes to the others
    by weight, until the quotas sum to N or every source is used up. `shortfall`
    is what a source's weight asked for beyond its quota (0 if nothing).

    The sources in the order of n / weight are the order in which a rising
    common level uses them up; the level is the first one that stays below its
    own source's limit. One row per source of one mix: the windows below run
    over the mix's sources only."""
    everything = Window.partitionBy(F.lit(0))
    w = counts.join(weights, "source").withColumn("rows", F.sum("n").over(everything))
    wanted = F.min(F.floor(F.col("n") / F.col("weight"))).over(everything) if total is None \
        else F.lit(total).cast("bigint")
    before = everything.orderBy(F.col("n") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = (w.withColumn("asked", wanted).withColumn("mix_n", F.least(F.col("asked"), F.col("rows")))
         .withColumn("level", (F.col("mix_n") - F.coalesce(F.sum("n").over(before), F.lit(0)))
                     / (F.lit(1.0) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
         .withColumn("limit", F.col("n") / F.col("weight"))
         .withColumn("level", F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "source", "level")))
                     .over(everything)["level"])
         .withColumn("share", F.least(F.coalesce(F.col("weight") * F.col("level"), F.col("n").cast("double")),
                                      F.col("n").cast("double")))
         .withColumn("base", F.floor("share").cast("bigint"))
         .withColumn("rem", F.col("share") - F.col("base"))
         .withColumn("deficit", F.col("mix_n") - F.sum("base").over(everything))
         .withColumn("open", F.when(F.col("base") < F.col("n"), 0).otherwise(1))
         .withColumn("rank", F.row_number().over(everything.orderBy("open", F.col("rem").desc(), F.col("source")))))
    top_up = (F.col("rank") <= F.col("deficit")) & (F.col("open") == 0)
    w = w.withColumn("quota", (F.col("base") + F.when(top_up, 1).otherwise(0)).cast("bigint"))
    return w.select("source", "n", "weight", "quota", F.greatest(
        F.floor(F.col("weight") * F.col("asked")) - F.col("quota"), F.lit(0)).cast("bigint").alias("shortfall"))


def weighted_mixture(rows: DataFrame, source: str, row_id: str, weights: DataFrame, seed: str = "0",
                     total: int | None = None) -> DataFrame:
    """RA1: the rows of the mix, with their rank inside their source."""
    keyed = rows.select(F.col(source).alias("source"), F.col(row_id).alias("row_id"),
                        pick_key(seed, F.col(row_id)).alias("key"))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_HEX))
    counts = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    q = quotas(counts, weights, total)
    hist = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("c"))
    cum = hist.withColumn("upto", F.sum("c").over(Window.partitionBy("source").orderBy("bucket")))
    cum = cum.join(q.select("source", "quota"), "source")
    # buckets taken whole, and the boundary bucket with how many rows precede it
    whole = cum.where(F.col("upto") <= F.col("quota")).select("source", "bucket")
    boundary = cum.where((F.col("upto") > F.col("quota")) & (F.col("upto") - F.col("c") < F.col("quota"))) \
        .select("source", "bucket", (F.col("upto") - F.col("c")).alias("before"), "quota")
    taken_whole = keyed.join(whole, ["source", "bucket"], "left_semi")
    in_boundary = keyed.join(boundary, ["source", "bucket"])
    ranked = in_boundary.withColumn(
        "r", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "row_id")))
    partial = ranked.where(F.col("before") + F.col("r") <= F.col("quota")).select("source", "row_id", "key")
    picked = taken_whole.select("source", "row_id", "key").unionByName(partial)
    return picked
