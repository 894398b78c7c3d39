"""Markdown and console reports (RE1–RE4, AG8, AG11, AG12, SF8–SF10).

A report is assembled per manifest (or per pull request) from an array of
that manifest's own findings — bounded by the manifest's size — sorted by
explicit ordinals and joined into text. Only finished report text would
ever reach the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.text import message, percent, thousands

def _lookup(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def console_line(level: Column, subject: Column, text: Column) -> Column:
    """RE4: `  ✓ subject: message` with ✗ / ! / ✓ marks."""
    return F.concat(F.lit("  "), _lookup(K.CONSOLE_MARKS)[level], F.lit(" "), subject, F.lit(": "), text)


def console(manifests: DataFrame, findings: DataFrame) -> DataFrame:
    """RE4: the console of checking each manifest by name: its offline problems,
    or that it is well-formed, that its data is being checked, and every
    finding. (phase, kind, pos, ord) is the order.

    `manifests` has manifest_id, folder, file_stem, problems; `findings`, as
    `dataset_reports` takes them, those of manifests without a problem."""
    file = F.concat("folder", F.lit("/"), "file_stem", F.lit(K.PROPOSAL_SUFFIX))
    zero = F.lit(0)
    problems = manifests.select("manifest_id", F.lit(0).alias("phase"), zero.alias("kind"), zero.alias("pos"),
                                F.posexplode("problems").alias("ord", "line")).withColumn(
        "line", F.concat(F.lit(f"{K.CONSOLE_MARKS['error']} "), "line"))
    good = manifests.where(F.size("problems") == 0).select("manifest_id", F.posexplode(F.array(
        message(K.CONSOLE_WELL_FORMED, n=1, files=file), message(K.CONSOLE_CHECKING, name=F.col("file_stem")))).alias(
        "ord", "line")).select("manifest_id", F.lit(1).alias("phase"), zero.alias("kind"), zero.alias("pos"), "ord", "line")
    found = findings.select("manifest_id", "kind", "pos", "subject", F.inline("findings")).select(
        "manifest_id", F.lit(2).alias("phase"), "kind", "pos", "ord",
        console_line(F.col("level"), F.col("subject"), F.col("message")).alias("line"))
    return problems.unionByName(good).unionByName(found)


def _finding_line(f: Column) -> Column:
    return F.concat(F.lit("| "), _lookup(K.LEVEL_ICONS)[f["level"]], F.lit(" | `"), f["subject"], F.lit("` | "),
                    F.translate(f["message"], "|", "/"), F.lit(" |"))


def _stats_line(s: Column) -> Column:
    return F.concat(F.lit("| `"), s["subject"], F.lit("` | "), s["rows"].cast("string"), F.lit(" | "),
                    thousands(s["median_chars"]), F.lit(" | "), percent(s["short_share"]), F.lit(" | "),
                    percent(s["dup_share"]), F.lit(" | "), percent(s["long_share"]), F.lit(" |"))


def settled(findings: DataFrame) -> DataFrame:
    """CL4 across a manifest: a subject that an earlier entry of the same
    manifest has an error for is not "ok" (two entries can share a subject,
    an empty and a missing config for one)."""
    earlier = Window.partitionBy("manifest_id", "subject").orderBy("kind", "pos").rowsBetween(
        Window.unboundedPreceding, -1)
    bad = F.exists("findings", lambda f: f["level"] == "error")
    return (findings.withColumn("__bad", F.coalesce(F.max(bad).over(earlier), F.lit(False)))
            .withColumn("findings", F.filter("findings", lambda f: ~(F.col("__bad") & (f["level"] == "ok"))))
            .drop("__bad"))


def dataset_reports(findings: DataFrame) -> DataFrame:
    """RE1 per manifest.

    `findings`: one row per checked subject with manifest_id, name, kind
    (0 source, 1 benchmark), pos, subject, findings ARRAY<STRUCT<ord, level,
    message>>, stats_ok and the row statistics. Output: manifest_id, name,
    passed, errors, warnings, oks, markdown."""
    per = findings.groupBy("manifest_id", "name").agg(F.array_sort(F.collect_list(F.struct(
        "kind", "pos", "subject", "findings", "stats_ok", "rows", "median_chars", "short_share", "dup_share",
        "long_share"))).alias("subjects"))
    subjects = F.col("subjects")
    flat = F.flatten(F.transform(subjects, lambda s: F.transform(
        F.array_sort(s["findings"]), lambda f: F.struct(s["subject"].alias("subject"), f["level"].alias("level"),
                                                        f["message"].alias("message")))))
    n_level = lambda lvl: F.size(F.filter(flat, lambda f: f["level"] == lvl))
    with_stats = F.filter(subjects, lambda s: s["stats_ok"])
    # stats are kept per subject: first position, last values
    names = F.array_distinct(F.transform(with_stats, lambda s: s["subject"]))
    stats = F.transform(names, lambda n: F.element_at(F.filter(with_stats, lambda s: s["subject"] == n), -1))
    verdict = F.when(n_level("error") == 0, F.lit(K.REPORT_PASS)).otherwise(F.lit(K.REPORT_FAIL))
    head = F.array(message(K.REPORT_TITLE, name=F.col("name")), F.lit(""), verdict, F.lit(""),
                   *[F.lit(x) for x in K.REPORT_TABLE_HEAD])
    stats_block = F.when(F.size(stats) > 0, F.concat(
        F.array(F.lit(""), F.lit(K.REPORT_STATS_HEAD[0]), F.lit(""), F.lit(K.REPORT_STATS_HEAD[1]),
                F.lit(K.REPORT_STATS_HEAD[2])),
        F.transform(stats, _stats_line))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(head, F.transform(flat, _finding_line), stats_block)
    return per.select(
        "manifest_id", "name",
        (n_level("error") == 0).alias("passed"),
        n_level("error").alias("errors"), n_level("warning").alias("warnings"), n_level("ok").alias("oks"),
        F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("markdown"))


def overall_outcome(reports: DataFrame) -> DataFrame:
    """AG12: did anything fail, and how many findings of each level."""
    return reports.agg(F.bool_or(~F.col("passed")).alias("failed"), F.count(F.lit(1)).alias("manifests"),
                       F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def problems_report(problems: Column) -> Column:
    """RE3: the offline problems of one check as Markdown ('' when none)."""
    return F.when(F.size(problems) > 0, F.concat(
        F.lit(f"{K.PROBLEMS_TITLE}\n\n{K.PROBLEMS_BAD}\n\n"),
        F.array_join(F.transform(problems, lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("\n"))
    ).otherwise(F.lit(""))
