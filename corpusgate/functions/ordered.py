"""Texts of one key put together in order, without one task holding all of them as rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 1000  # consecutive ordinals that are joined in a first step


def joined(df: DataFrame, keys: list[str], bucket: Column, order: list[str], text: str, sep: str, out: str,
           parts: int | None = None, count: str | None = None) -> DataFrame:
    """(keys, out): the `text`s of each key in `order`, `sep` between them; with `count` also how many they are.

    Two levels: the rows of a bucket become one piece, the pieces of a key one text. `bucket` must rise with
    `order` and hold few rows of a key, so a hot key's rows spread over as many groups as it has buckets, and
    what meets at last is its pieces. `parts`: deal the rows of either level over so many partitions."""
    b, piece, n = "__bucket", "__piece", "__n"
    rows = df.withColumn(b, bucket)
    first = ((rows.repartition(parts, *keys, b) if parts else rows).groupBy(*keys, b)
             .agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__text")))).alias(piece))
             .select(*keys, b, F.size(piece).alias(n), F.array_join(F.transform(piece, lambda x: x["__text"]), sep).alias(piece)))
    total = [F.sum(n).alias(count)] if count else []
    return ((first.repartition(parts, *keys) if parts else first).groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(b, piece))).alias(out), *total)
            .withColumn(out, F.array_join(F.transform(out, lambda x: x[piece]), sep)))


def step(ordinal: str) -> Column:
    """Buckets of STEP consecutive whole numbers; null comes last."""
    return F.coalesce(F.floor(F.col(ordinal) / STEP).cast("bigint"), F.lit((1 << 63) - 1))
