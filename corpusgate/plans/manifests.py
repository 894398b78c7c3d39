"""Manifest-rule queries over the derived manifest fixtures."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusgate.functions.render import source_subject
from corpusgate.functions.text import fmt_g
from corpusgate.operators import rules as R
from corpusgate import constants as K
from corpusgate.operators.changes import layout_problems
from corpusgate.operators.names import duplicate_names, find_manifests, taken_names
from corpusgate.sources.fixtures import fixture
from corpusgate.session import scratch_dir
from corpusgate.sources.listing import scan_manifest_files, write_files
from corpusgate.sources.manifests import fixture_documents, fixture_manifests, manifest_problems


def _nested(spark, sf_dir):
    """Nested manifests with the whole manifest as one struct column `m`."""
    n = fixture_manifests(spark, sf_dir)
    return n.select("manifest_id", "folder", "file_stem", "n_sources", "n_benchmarks",
                    F.struct(*[F.col(c) for c in n.columns]).alias("m"))


def _ruled(spark, sf_dir):
    """Nested manifests with every rule evaluated (`with_rule_columns`)."""
    return R.with_rule_columns(_nested(spark, sf_dir))


def _explode_errors(df, errs, *extra):
    return df.select("manifest_id", *extra, F.explode(errs).alias("e")).select(
        "manifest_id", *extra, F.col("e.loc").alias("loc"), F.col("e.msg").alias("message"))


def q_source_rules(spark, sf_dir):
    """MV3–MV9: list length, per-source field rules and rendering rules."""
    m = R.with_error_columns(_nested(spark, sf_dir))
    errs = F.filter(F.col("_e_data"), lambda e: e["item"] < 1000)
    out = m.select("manifest_id", F.col("m.data").alias("data"), F.explode(errs).alias("e"))
    src = F.get(F.col("data.dataset_sources"), F.col("e.item"))
    subject = F.when(F.col("e.loc") != "data.dataset_sources",
                     source_subject(src["path"], src["name"], src["split"]))
    return out.select("manifest_id", subject.alias("subject"), F.col("e.loc").alias("loc"),
                      F.col("e.msg").alias("message"))


def q_weight_sum(spark, sf_dir):
    """MV11 / AG7: weight total per manifest (summed per group, so rounded)."""
    src = fixture(spark, sf_dir, "fx_sources")
    g = src.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("weight").alias("total"))
    return g.select("manifest_id", "n_sources", F.round("total", 9).alias("total_weight"),
                    (F.abs(F.col("total") - 1.0) <= 1e-6).alias("sums_to_one"),
                    fmt_g(F.col("total")).alias("total_text"))


def q_duplicate_sources(spark, sf_dir):
    """MV12: (path, config, split) listed more than once; null config = null."""
    src = fixture(spark, sf_dir, "fx_sources")
    return (src.groupBy("manifest_id", "path", "name", "split").agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def q_manifest_rules(spark, sf_dir):
    """MV10, MV18–MV22: sequence length and the proposal's own fields."""
    m = _nested(spark, sf_dir).withColumn("_e_data_f", R.c_data_field_errors())
    seq = F.filter(F.col("_e_data_f"), lambda e: e["item"] == 1000)
    return _explode_errors(m, F.concat(R.c_field_errors(), seq))


def q_benchmark_rules(spark, sf_dir):
    """MV13–MV17 per benchmark and list, plus MV23 (names unique)."""
    m = _nested(spark, sf_dir)
    unique = R.errors(R.err(R.c_names_repeat(), R.SEC["top"], 0, 0, "(top level)",
                            R.value_error(F.lit(K.MSG_BENCH_UNIQUE))))
    return _explode_errors(m, F.concat(R.c_benchmark_errors(), unique))


def q_heldout_violations(spark, sf_dir):
    """MV24 / JO4: null-safe left-semi join of benchmarks to the manifest's
    own sources on (path, config, split); the first offending benchmark."""
    src = fixture(spark, sf_dir, "fx_sources").select(
        F.col("manifest_id").alias("s_mid"), F.col("path").alias("s_path"), F.col("name").alias("s_name"),
        F.col("split").alias("s_split"))
    bench = fixture(spark, sf_dir, "fx_benchmarks")
    cond = ((bench.manifest_id == src.s_mid) & (bench.ds_path == src.s_path)
            & bench.ds_name.eqNullSafe(src.s_name) & bench.ds_split.eqNullSafe(src.s_split))
    hits = bench.join(src, cond, "left_semi")
    first = hits.groupBy("manifest_id").agg(F.min(F.struct("pos", "name", "ds_path", "ds_split")).alias("b"))
    b = F.struct(F.col("b.name").alias("name"),
                 F.struct(F.col("b.ds_path").alias("path"), F.col("b.ds_split").alias("split")).alias("dataset"))
    return first.select("manifest_id", F.col("b.name").alias("benchmark"),
                        R.value_error(R.held_out_message(b)).alias("message"))


def q_file_identity(spark, sf_dir):
    """MV25, MV26 on every file (not gated here)."""
    m = _nested(spark, sf_dir)
    errs = R.c_file_errors()
    return m.select("manifest_id", F.explode(errs).alias("e")).select("manifest_id",
                                                                       F.col("e.msg").alias("message"))


def q_taken_and_duplicate_names(spark, sf_dir):
    """MV21 / JO6 and MV27."""
    man = fixture(spark, sf_dir, "fx_manifests")
    return taken_names(man).unionByName(duplicate_names(man))


def q_all_problems(spark, sf_dir):
    """MV28 / MV29: every problem of the tree — files that do not belong, then
    per file in path order, then task names used in more than one folder.
    (phase, folder, file, manifest_id, seq) is the order of the report. The
    tree's other files are those that the change log names."""
    m = _ruled(spark, sf_dir)
    per_file = m.select(F.lit(2).alias("phase"), "folder", F.concat("file_stem", F.lit(K.PROPOSAL_SUFFIX)).alias("file"),
                        "manifest_id", F.posexplode("problems").alias("seq", "problem")).withColumn(
        "seq", F.col("seq") + 1)
    whole = lambda phase, folder, file, text: (
        F.lit(phase).alias("phase"), folder.cast("string").alias("folder"), file.cast("string").alias("file"),
        F.lit(None).cast("bigint").alias("manifest_id"), F.lit(1).alias("seq"), text.alias("problem"))
    rel = F.regexp_replace("file", "^[^/]+/", "")
    stray = layout_problems(fixture(spark, sf_dir, "fx_changes")).select(*whole(
        1, F.regexp_extract(rel, "^(.*)/[^/]*$", 1), F.regexp_extract(rel, "([^/]*)$", 1), F.col("problem")))
    dup = duplicate_names(fixture(spark, sf_dir, "fx_manifests")).select(*whole(
        3, F.lit(None), F.col("key"), F.col("message")))
    return stray.unionByName(per_file).unionByName(dup)


def q_manifest_scan(spark, sf_dir):
    """SC6 + MV1 + MV28: the fixture manifests written out as documents,
    decoded again and checked from the raw text — the same problems as the
    nested path must come out."""
    probs = manifest_problems(fixture_documents(spark, sf_dir), deal=False)  # dealt by the join that made them
    return probs.select("manifest_id", F.posexplode("problems").alias("seq", "problem")).select(
        "manifest_id", (F.col("seq") + 1).alias("seq"), "problem")


def q_manifest_files(spark, sf_dir):
    """SC5, SC6, MV1, MV2: a tree of manifest files, JSON and YAML, written out, listed (names that start with
    `.` or `_` too), decoded and checked; and the whole numbers that were read."""
    root = f"{scratch_dir(spark)}/tree-{uuid.uuid4().hex}/proposals"
    write_files(fixture(spark, sf_dir, "fx_tree"), root)
    found = manifest_problems(scan_manifest_files(spark, [root, root + "-none"]))
    number = lambda c: c.cast("string")
    yaml_error = F.transform("problems", lambda p: F.regexp_replace(p, "(not valid YAML — )[\\s\\S]*", "$1…"))
    return found.select("root", "folder", "file", F.array_join(yaml_error, "\n").alias("problems"),
                        number(F.col("m.suggested_training.steps")).alias("steps"),
                        number(F.col("m.suggested_training.batch_size")).alias("batch_size"),
                        number(F.get("m.benchmarks", F.lit(0))["num_fewshot"]).alias("num_fewshot"))


def q_find_manifest(spark, sf_dir):
    """SO3: task names, and some paths given directly, against the files of
    both roots (every third manifest also lies in `examples`)."""
    man = fixture(spark, sf_dir, "fx_manifests")
    files = man.select(F.lit("proposals").alias("root"), "folder", "file_stem").unionByName(
        man.where("manifest_id % 3 = 0").select(F.lit("examples").alias("root"), "folder", "file_stem"))
    names = man.select(F.col("file_stem").alias("name")).unionByName(
        man.where("manifest_id % 50 = 0").select(F.concat(F.lit("proposals/"), "folder", F.lit("/"), "file_stem",
                                                          F.lit(".yaml")).alias("name")))
    return find_manifests(names, files)


def q_problem_reports(spark, sf_dir):
    """RE3: the offline-check Markdown of every file that has problems."""
    from corpusgate.operators.report import problems_report

    m = _ruled(spark, sf_dir)
    return m.where(F.size("problems") > 0).select("manifest_id", problems_report(F.col("problems")).alias("markdown"))


QUERIES = {
    "problem_reports": q_problem_reports,
    "manifest_scan": q_manifest_scan,
    "manifest_files": q_manifest_files,
    "find_manifest": q_find_manifest,
    "source_rules": q_source_rules,
    "weight_sum": q_weight_sum,
    "duplicate_sources": q_duplicate_sources,
    "manifest_rules": q_manifest_rules,
    "benchmark_rules": q_benchmark_rules,
    "heldout_violations": q_heldout_violations,
    "file_identity": q_file_identity,
    "taken_and_duplicate_names": q_taken_and_duplicate_names,
    "all_problems": q_all_problems,
}

from corpusgate.plans.manifests_sql import ORACLES  # noqa: E402,F401
