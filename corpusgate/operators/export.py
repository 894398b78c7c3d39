"""Manifest → task configuration (PR7–PR11, SC9).

A narrow projection of the nested manifest: no shuffle. The configuration
is a struct column serialised with `to_json` (nulls dropped), the header is
one text column built with higher-order functions over the benchmarks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.text import truthy


def export_source(s: Column) -> Column:
    """PR8 per source: path, name only when set, split, weight, then the
    text column or else the template; license is not exported."""
    tc = truthy(s["text_column"])
    return F.struct(
        s["path"].alias("path"),
        F.when(truthy(s["name"]), s["name"]).alias("name"),
        s["split"].alias("split"),
        s["weight"].alias("weight"),
        F.when(tc, s["text_column"]).alias("text_column"),
        F.when(~tc, s["text_template"]).alias("text_template"),
    )


def revision_pins(sources: Column) -> Column:
    """PR9: path → revision for sources that pin one; a path listed twice
    keeps its last revision; null when there is none."""
    pinned = F.filter(sources, lambda s: truthy(s["revision"]))
    pins = F.aggregate(pinned, F.create_map().cast("map<string,string>"),
                       lambda acc, s: F.map_concat(F.map_filter(acc, lambda k, v: k != s["path"]),
                                                   F.create_map(s["path"], s["revision"])))
    return F.when(F.size(pinned) > 0, pins)


def task_config(m: Column, group_id: Column) -> Column:
    """PR8 + PR9: the task configuration struct of one manifest."""
    sources = m["data"]["dataset_sources"]
    return F.struct(
        group_id.alias("group_id"),
        F.struct(
            F.transform(sources, export_source).alias("dataset_sources"),
            F.lit(K.EXPORT_PER_DEVICE_TRAIN_BATCH_SIZE).alias("per_device_train_batch_size"),
            F.lit(K.EXPORT_BATCH_SIZE).alias("batch_size"),
            m["data"]["sequence_length"].alias("sequence_length"),
            F.lit(K.EXPORT_SEEDED_SHARD_PICK).alias("eval_source_seeded_shard_pick"),
            F.lit(K.EXPORT_SKIP_MAX).alias("eval_source_skip_max"),
            revision_pins(sources).alias("eval_source_revision_pin"),
        ).alias("data"),
    )


def suggestion_line(st: Column) -> Column:
    """PR10: `# The proposer suggested: N steps, batch size M (not applied).`;
    each half only when set (and non-zero); '' when neither is given."""
    steps, batch = st["steps"], st["batch_size"]
    parts = F.concat_ws(", ",
                        F.when(F.coalesce(steps, F.lit(0)) != 0, F.concat(steps.cast("string"), F.lit(" steps"))),
                        F.when(F.coalesce(batch, F.lit(0)) != 0, F.concat(F.lit("batch size "), batch.cast("string"))))
    none = st.isNull() | (steps.isNull() & batch.isNull())
    return F.when(none, F.lit("")).otherwise(
        F.concat(F.lit("# The proposer suggested: "), parts, F.lit(" (not applied).\n")))


def header(m: Column) -> Column:
    """PR11: the comment block above an exported configuration."""
    name, github = m["name"], m["proposer"]["github"]
    bench = F.array_join(F.transform(m["benchmarks"], lambda b: F.concat(
        F.lit("#   - "), b["name"], F.lit(": "), b["harness"],
        F.when(truthy(b["task"]), F.concat(F.lit(" task "), b["task"], F.lit(", "),
                                           F.coalesce(b["num_fewshot"].cast("string"), F.lit("None")),
                                           F.lit("-shot"))).otherwise(F.lit("")),
        F.lit(", metric "), b["metric"], F.lit(" ("),
        F.when(b["higher_is_better"], F.lit("higher")).otherwise(F.lit("lower")), F.lit(" is better)\n"))), "")
    return F.concat(
        F.lit("# "), name, F.lit(": "), m["title"], F.lit("\n"),
        F.lit("# Exported from proposals/"), github, F.lit("/"), name, F.lit(".yaml,\n"),
        F.lit("# proposed by @"), github, F.lit(".\n"),
        F.lit(K.EXPORT_HEADER),
        bench, suggestion_line(m["suggested_training"]))


def export_documents(manifests: DataFrame, group_id: Column) -> DataFrame:
    """SC9: one configuration document per manifest: header + JSON body."""
    m = F.col("m")
    return manifests.select("manifest_id", m["name"].alias("name"), header(m).alias("header"),
                            F.to_json(task_config(m, group_id)).alias("config_json"))
