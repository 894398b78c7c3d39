"""Corpus profiling: row statistics, first-n sampling, the eval gate and the
window estimate (AG1–AG6, WI1–WI2, SE3, RA2).

Scale notes
-----------
* `row_stats` reads the text once: rows collapse map-side into
  (key, length, prefix key, n) and are exchanged on all of those, so a hot
  source spreads over every reducer and repeated prefixes never move twice.
  From that one shuffle output (a reused exchange) come the counts with the
  single distinct aggregate (exchange on (key, prefix), then on key) and
  the length histogram. Later exchanges carry distinct keys, not rows.
* The duplicate key is a 128-bit hash of the 200-character prefix (two
  independent xxhash64), not the prefix: 16 bytes instead of up to 800 per
  distinct row through the shuffle. `exact=True` keys on the prefix itself.
* The exact median is `percentile(length, 0.5, frequency)` over the
  (key, length) histogram, so its object buffer only ever sees distinct
  lengths, never one buffer per distinct prefix (which would force
  sort-based aggregation).
* `first_n` and `eval_gate` are `row_number` filters that Spark turns into
  WindowGroupLimit (a map-side top-n before the exchange), so a hot group
  sends at most n rows per map task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate import constants as K

_SEED2 = 0x2545F491  # second xxhash64 stream for the 128-bit prefix key


def prefix(text) -> Column:
    return F.substring(F.col(text) if isinstance(text, str) else text, 1, K.DEDUP_PREFIX_CHARS)


def prefix_key(text, exact: bool = False) -> Column:
    """Key of the 200-character prefix: the prefix itself or a 128-bit hash."""
    p = prefix(text)
    if exact:
        return p
    return F.struct(F.xxhash64(p).alias("h1"), F.xxhash64(F.lit(_SEED2), p).alias("h2"))


def usable(text) -> Column:
    """FI1: text of at least 200 code points (no trimming)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.length(t) >= K.MIN_TEXT_CHARS, F.lit(False))


def over_window(text, sequence_length) -> Column:
    """FI2: longer than one training window of `sequence_length` tokens."""
    t = F.col(text) if isinstance(text, str) else text
    seq = F.col(sequence_length) if isinstance(sequence_length, str) else F.lit(sequence_length)
    return F.coalesce(F.length(t) > seq * K.CHARS_PER_TOKEN, F.lit(False))


def row_stats_approx(texts: DataFrame, keys: list[str], text: str = "text",
                     sequence_length=K.DEFAULT_SEQUENCE_LENGTH, rsd: float = 0.01, accuracy: int = 10_000) -> DataFrame:
    """AG6, opt-in approximate form: one pass, one exchange on the keys.
    Distinct prefixes by HyperLogLog++ (`approx_count_distinct`, relative
    error `rsd`) and the median by `percentile_approx`; counts stay exact.
    Each aggregate buffer has a fixed size, so a hot source costs no more
    than any other."""
    seq = F.col(sequence_length) if isinstance(sequence_length, str) else F.lit(sequence_length)
    t = F.col(text)
    length = F.coalesce(F.length(t), F.lit(0))
    ok = usable(text)
    stats = texts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.percentile_approx(length, 0.5, accuracy).cast("bigint").alias("median_chars"),
        F.count_if(ok).alias("usable_rows"),
        F.approx_count_distinct(F.when(ok, F.xxhash64(prefix(text))), rsd).alias("distinct_prefixes"),
        F.count_if(length > seq * K.CHARS_PER_TOKEN).alias("long_rows"))
    return stats.select(
        *keys, "rows", "median_chars",
        (F.lit(1) - F.col("usable_rows") / F.col("rows")).alias("short_share"),
        F.when(F.col("usable_rows") == 0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1) - F.col("distinct_prefixes") / F.col("usable_rows")))
        .alias("dup_share"),
        (F.col("long_rows") / F.col("rows")).alias("long_share"))


def row_stats(texts: DataFrame, keys: list[str], text: str = "text", sequence_length=K.DEFAULT_SEQUENCE_LENGTH,
              exact: bool = False) -> DataFrame:
    """AG6: rows, median_chars, short_share, dup_share, long_share per key.

    `texts` holds rendered text (string; null counts as length 0).
    `sequence_length` is an int or the name of a column constant per key.

    One scan: the rows collapse map-side into (key, length, prefix key, n)
    — the only exchange that carries row-level volume. Both the counts
    (with the distinct prefixes) and the length histogram for the exact
    median are aggregated from that one shuffle output (Spark reuses the
    exchange), so the text column is read once.
    """
    if not keys:  # one group: key it by a constant so the two halves join on it
        out = row_stats(texts.withColumn("__all", F.lit(0)), ["__all"], text, sequence_length, exact)
        return out.drop("__all")
    seq = F.col(sequence_length) if isinstance(sequence_length, str) else F.lit(sequence_length)
    length = F.coalesce(F.length(F.col(text)), F.lit(0))
    base = (texts.select(*keys, seq.alias("__seq"), length.alias("__len"),
                         F.when(usable(text), prefix_key(text, exact)).alias("__pk"))
            .groupBy(*keys, "__seq", "__len", "__pk").agg(F.count(F.lit(1)).alias("__n")))
    counts = base.groupBy(*keys).agg(
        F.sum("__n").alias("rows"),
        F.sum(F.when(F.col("__len") >= K.MIN_TEXT_CHARS, F.col("__n")).otherwise(0)).alias("usable_rows"),
        F.count_distinct("__pk").alias("distinct_prefixes"),
        F.sum(F.when(F.col("__len") > F.col("__seq") * K.CHARS_PER_TOKEN, F.col("__n")).otherwise(0))
        .alias("long_rows"),
    )
    hist = base.groupBy(*keys, "__len").agg(F.sum("__n").alias("__freq"))
    med = hist.groupBy(*keys).agg(
        F.floor(F.percentile(F.col("__len"), F.lit(0.5), F.col("__freq"))).cast("bigint").alias("median_chars"))
    med = med.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "median_chars")
    cond = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]  # null source is a key too
    stats = counts.join(med, cond, "left")
    return stats.select(
        *keys, F.col("rows").cast("bigint").alias("rows"), "median_chars",
        # operand order as in the definition: 1 - usable / rows
        (F.lit(1) - F.col("usable_rows") / F.col("rows")).alias("short_share"),
        F.when(F.col("usable_rows") == 0, F.lit(0.0))
        .otherwise(F.lit(1) - F.col("distinct_prefixes") / F.col("usable_rows")).alias("dup_share"),
        (F.col("long_rows") / F.col("rows")).alias("long_share"),
    )


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int = K.DEFAULT_SAMPLE_ROWS,
            rank_col: str | None = None) -> DataFrame:
    """WI1 / SC2: the first n rows of every key in `order` (a stable ordinal)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = rank_col or "__rn"
    out = rows.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n)
    return out if rank_col else out.drop(rn)


def eval_gate(rows: DataFrame, keys: list[str], text: str, order: list[str], exact: bool = False) -> DataFrame:
    """WI2: drop rows under 200 characters, then keep one row per 200-character
    prefix within each key — the one first in `order`."""
    w = Window.partitionBy(*keys, prefix_key(text, exact)).orderBy(*order)
    return (rows.where(usable(text))
            .withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") == 1).drop("__rn"))


def duplicate_prefix_groups(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """SE3 / AG4: every 200-character prefix shared by more than one usable row,
    with its first row and number of copies. Grouped on the prefix itself so
    the prefix is part of the answer; partial aggregation runs map-side."""
    return (rows.where(usable(text))
            .groupBy(*keys, prefix(text).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias(f"first_{order}"))
            .where(F.col("copies") > 1))


def window_estimate(texts: DataFrame, keys: list[str], text: str = "text",
                    sequence_length=K.DEFAULT_SEQUENCE_LENGTH) -> DataFrame:
    """RA2: training windows (`ceil(chars / (4*seq_len))`) and approximate
    tokens (`chars / 4`) per key."""
    seq = F.col(sequence_length) if isinstance(sequence_length, str) else F.lit(sequence_length)
    length = F.coalesce(F.length(F.col(text)), F.lit(0))
    return texts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(length).alias("chars"),
        (F.sum(length) / F.lit(K.CHARS_PER_TOKEN)).alias("approx_tokens"),
        F.sum(F.ceil(length / (seq * K.CHARS_PER_TOKEN))).cast("bigint").alias("windows"),
        F.count_if(length > seq * K.CHARS_PER_TOKEN).alias("over_window_rows"),
    )
