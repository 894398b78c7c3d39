"""Findings from row statistics (CL4 threshold part) and finding arrays.

A finding is `(ord, level, subject, message)`. Each classifier builds an
array of optional finding structs per input row, drops the empty ones and
explodes: one narrow pass, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.text import message, percent


def finding(ord_: int, level: Column, msg: Column) -> Column:
    return F.struct(F.lit(ord_).alias("ord"), level.alias("level"), msg.alias("message"))


def explode_findings(df: DataFrame, findings: Column, keep: list[str]) -> DataFrame:
    """Keep the non-empty findings of `findings` (array of finding structs)
    and return one row per finding with the `keep` columns."""
    kept = F.filter(findings, lambda f: f["level"].isNotNull())
    return (df.select(*keep, F.inline(kept)))


def stats_findings(short_share: Column, dup_share: Column) -> list[Column]:
    """CL4 thresholds: short (error > 0.5, else warning > 0.1) and duplicate
    prefixes (error > 0.3, else warning > 0.05), independently."""
    short = (
        F.when(short_share > K.SHORT_ERROR_SHARE,
               F.struct(F.lit("error").alias("l"), message(K.MSG_SHORT_ERROR, pct=percent(short_share)).alias("m")))
        .when(short_share > K.SHORT_WARNING_SHARE,
              F.struct(F.lit("warning").alias("l"), message(K.MSG_SHORT_WARNING, pct=percent(short_share)).alias("m")))
    )
    dup = (
        F.when(dup_share > K.DUP_ERROR_SHARE,
               F.struct(F.lit("error").alias("l"), message(K.MSG_DUP_ERROR, pct=percent(dup_share)).alias("m")))
        .when(dup_share > K.DUP_WARNING_SHARE,
              F.struct(F.lit("warning").alias("l"), message(K.MSG_DUP_WARNING, pct=percent(dup_share)).alias("m")))
    )
    return [short, dup]


def ok_message(text_column: Column, template_columns: Column, rows: Column) -> Column:
    """The 'ok' line of a source: names the text column or the template columns."""
    cols = F.array_join(F.transform(template_columns, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", ")
    return F.when(F.coalesce(text_column, F.lit("")) != "",
                  message(K.MSG_OK_COLUMN, column=text_column, n=rows)) \
        .otherwise(message(K.MSG_OK_TEMPLATE, columns=cols, n=rows))


def source_stat_verdicts(stats: DataFrame, keys: list[str], subject: Column, text_column: Column,
                         template_columns: Column | None = None) -> DataFrame:
    """Findings for sources whose rows were read: thresholds, then 'ok' when
    the subject has no error (warnings allowed)."""
    template_columns = template_columns if template_columns is not None else F.array().cast("array<string>")
    short, dup = stats_findings(F.col("short_share"), F.col("dup_share"))
    has_error = (F.col("short_share") > K.SHORT_ERROR_SHARE) | (F.col("dup_share") > K.DUP_ERROR_SHARE)
    ok = F.when(~has_error, F.struct(F.lit("ok").alias("l"),
                                      ok_message(text_column, template_columns, F.col("rows")).alias("m")))
    arr = F.array(*[F.struct(F.lit(i + 1).alias("ord"), c["l"].alias("level"), c["m"].alias("message"))
                    for i, c in enumerate([short, dup, ok])])
    return explode_findings(stats.withColumn("subject", subject), arr, keys + ["subject"])
