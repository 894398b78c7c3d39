"""Data-check queries: catalog findings, load errors, source and benchmark
verdicts and the per-proposal report, over the derived fixtures.

The fixture corpus store (`fx_store`): dataset `org/corpus-<k>` is the `documents`
rows of source `src<k mod 20>`, ordinal `doc_id`. German rows are its config `a`,
French ones `r`, and all others, a null language included, `default`; every third
document is in the split `validation`, the others in `train`; every fourth was added
after the pinned revision. So every document belongs to a corpus that a request can
name. Benchmarks read the same store.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.render import source_subject
from corpusgate.functions.text import message
from corpusgate.operators import catalog as C
from corpusgate.operators import datacheck as D
from corpusgate.operators import report as RP
from corpusgate.plans.manifests import _ruled
from corpusgate.functions.joins import sized
from corpusgate.sources import store
from corpusgate.sources.fixtures import fixture
from corpusgate.sources.tables import corpus, table, with_file_ordinal

SAMPLE_ROWS = K.DEFAULT_SAMPLE_ROWS
TIMEOUT = 60.0


PIN = "0a" * 20
PARTITIONS = ["config", "split", "added"]


def corpus_key(path, name, split, revision):
    """What a (path, config, split, revision) names: a null dataset for paths of no known shape."""
    k = F.regexp_extract(path, r"^org/corpus-([0-9]+)$", 1)
    return {"dataset": F.when(k != "", F.concat(F.lit("src"), (k.cast("bigint") % 20).cast("string"))),
            "config": F.coalesce(F.nullif(name, F.lit("")), F.lit("default")), "split": split,
            "added": F.coalesce(F.nullif(revision, F.lit("")), F.lit("head"))}


def corpora(spark, sf_dir) -> D.Corpora:
    docs = table(spark, sf_dir, "documents")
    rows = store.opened(spark, "documents", sf_dir, lambda: fixture(spark, sf_dir, "fx_store"), PARTITIONS)
    visible = spark.createDataFrame([("head", PIN), ("head", "later"), (PIN, PIN)], "k_added string, added string")
    return D.Corpora(rows, ["dataset", *PARTITIONS], corpus_key, docs.schema, "doc_id", visible=visible)


def q_corpus_scan(spark, sf_dir):
    """SC1: one config and split opened as a corpus of its own (its partitions alone are read), with the ordinals
    that files give their rows."""
    path, _ = store.located(spark, "documents", sf_dir, lambda: fixture(spark, sf_dir, "fx_store"), PARTITIONS)
    rows = with_file_ordinal(corpus(spark, path, partition_filters={"config": "default", "split": "validation"}))
    return rows.groupBy("dataset", "added").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("n_chars").cast("long")).alias("chars"),
        F.count_distinct("ord").alias("ordinals"))


def catalog(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "fx_catalog").select(
        "path", "revision", "http_status", "detail", "disabled", "gated", F.split("sibling_list", ",").alias("siblings"))


def _sources(spark, sf_dir) -> DataFrame:
    src = fixture(spark, sf_dir, "fx_sources")
    man = fixture(spark, sf_dir, "fx_manifests").select("manifest_id", F.col("sequence_length").alias("seq_len"))
    return (src.join(man, "manifest_id")
            .withColumn("subject", source_subject(F.col("path"), F.col("name"), F.col("split"))))


def _explode(df: DataFrame, keys: list[str]) -> DataFrame:
    # not `inline`: the filter on empty lists that Spark puts before it would hold the findings once more
    return df.select(*keys, F.inline_outer("findings")).where(F.col("ord").isNotNull())


def q_hub_entry_findings(spark, sf_dir):
    """JO1, CL1, FI6, FI7: catalog findings of every training source."""
    src = C.with_catalog(_sources(spark, sf_dir), "path", catalog(spark, sf_dir), F.col("revision"))
    hub, _ = C.hub_entry(F.col("path"), F.col("revision"), True, F.col("c_found"), F.col("c_http_status"),
                         F.col("c_disabled"), F.col("c_gated"), F.col("c_siblings"), F.col("c_detail"))
    return src.select("manifest_id", "pos", "subject", F.inline(hub))


def q_load_error_findings(spark, sf_dir):
    """CL2, CL3, JO3, SO2: what a failed or stalled load of each source reports."""
    src = C.with_loads(_sources(spark, sf_dir), "path", fixture(spark, sf_dir, "fx_loads"),
                       fixture(spark, sf_dir, "fx_splits"), F.col("name"), F.col("split"), F.col("revision"))
    msg = (F.when(F.col("l_status") == "timeout",
                  message(K.MSG_STALL, detail=C.timeout_text(F.col("path"), SAMPLE_ROWS, TIMEOUT)))
           .when(F.col("l_status") == "error",
                 message(K.MSG_CANNOT_STREAM, detail=C.load_error_text(
                     F.col("path"), F.col("name"), F.col("split"), F.col("l_error_type"), F.col("l_error_msg"),
                     F.col("known_pairs"), F.col("known_text")))))
    return src.where(msg.isNotNull()).select("manifest_id", "pos", "subject", F.lit("error").alias("level"),
                                             msg.alias("message"))


def checked_sources(spark, sf_dir, sources: DataFrame | None = None) -> DataFrame:
    """CL4 for the fixture sources against the fixture corpus store."""
    # read for the distinct specs and again for their verdicts: written once, and the subject, which follows from
    # other columns, is not carried along
    src = sources if sources is not None else sized(
        _sources(spark, sf_dir).select("manifest_id", "pos", *D.SPEC), "sources")
    found = D.check_sources(src, catalog(spark, sf_dir), fixture(spark, sf_dir, "fx_loads"),
                            fixture(spark, sf_dir, "fx_splits"), corpora(spark, sf_dir), TIMEOUT)
    return found.withColumn("subject", source_subject(F.col("path"), F.col("name"), F.col("split")))


def q_source_findings(spark, sf_dir):
    return _explode(checked_sources(spark, sf_dir), ["manifest_id", "pos", "subject"])


def checked_benchmarks(spark, sf_dir, benchmarks: DataFrame | None = None) -> DataFrame:
    """CL5 for every benchmark: catalog, one-row readability, task registry."""
    bench = benchmarks if benchmarks is not None else fixture(spark, sf_dir, "fx_benchmarks")
    return D.check_benchmarks(bench, catalog(spark, sf_dir), fixture(spark, sf_dir, "fx_loads"),
                              fixture(spark, sf_dir, "fx_splits"), corpora(spark, sf_dir),
                              fixture(spark, sf_dir, "fx_tasks"), TIMEOUT)


def q_benchmark_verdicts(spark, sf_dir):
    return _explode(checked_benchmarks(spark, sf_dir), ["manifest_id", "pos", "subject"])


def q_benchmark_verdicts_unverified(spark, sf_dir):
    """JO5 where no task registry is installed: tasks pass, and the verdict says that they were not verified."""
    found = D.check_benchmarks(fixture(spark, sf_dir, "fx_benchmarks"), catalog(spark, sf_dir),
                               fixture(spark, sf_dir, "fx_loads"), fixture(spark, sf_dir, "fx_splits"),
                               corpora(spark, sf_dir), None, TIMEOUT)
    return _explode(found, ["manifest_id", "pos", "subject"])


def valid_manifests(spark, sf_dir) -> DataFrame:
    """Manifests with no offline problem — only these get a data check —
    with their nested manifest struct.

    Used several times downstream, so it is written to the shared checkpoint
    folder once: the rule pass does not rerun and the lineage is cut."""
    m = _ruled(spark, sf_dir)
    return sized(m.where(F.size("problems") == 0).select("manifest_id", F.col("m.name").alias("name"), "m"), "valid")


def proposal_findings(spark, sf_dir, valid: DataFrame | None = None) -> DataFrame:
    """CL6: sources in order, then benchmarks in order, per valid manifest.

    A valid manifest holds at most 4 sources and 5 benchmarks inside its
    nested struct, so the check tables come from exploding those arrays —
    no second pass over the fixture tables."""
    valid = valid_manifests(spark, sf_dir) if valid is None else valid
    src = valid.select("manifest_id", F.col("m.data.sequence_length").alias("seq_len"),
                       F.inline("m.data.dataset_sources")).select(
        "manifest_id", "pos", "path", "name", "split", "weight", "text_column", "text_template", "revision",
        "seq_len", source_subject(F.col("path"), F.col("name"), F.col("split")).alias("subject"))
    bench = valid.select("manifest_id", F.inline("m.benchmarks")).select(
        "manifest_id", "pos", "name", "harness", "task", "num_fewshot", "metric", "higher_is_better",
        F.col("dataset.path").alias("ds_path"), F.col("dataset.name").alias("ds_name"),
        F.col("dataset.split").alias("ds_split"))
    src_found, bench_found = D.check(src, bench, catalog(spark, sf_dir), fixture(spark, sf_dir, "fx_loads"),
                                     fixture(spark, sf_dir, "fx_splits"), corpora(spark, sf_dir),
                                     fixture(spark, sf_dir, "fx_tasks"), TIMEOUT)
    s = src_found.select(
        "manifest_id", F.lit(0).alias("kind"), "pos", "subject", "findings", "stats_ok",
        "rows", "median_chars", "short_share", "dup_share", "long_share")
    b = bench_found.select(
        "manifest_id", F.lit(1).alias("kind"), "pos", "subject", "findings", F.lit(False).alias("stats_ok"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("rows", "bigint"), ("median_chars", "bigint"),
                                                     ("short_share", "double"), ("dup_share", "double"),
                                                     ("long_share", "double"))])
    return RP.settled(s.unionByName(b)).join(valid.select("manifest_id", "name"), "manifest_id")


def q_proposal_report(spark, sf_dir):
    return RP.dataset_reports(proposal_findings(spark, sf_dir))


def q_check_outcome(spark, sf_dir):
    """AG11 + AG12: findings per level over every checked proposal, and
    whether anything failed."""
    return RP.overall_outcome(q_proposal_report(spark, sf_dir))


def q_console_lines(spark, sf_dir):
    """RE4: the console of every manifest: problems, or well-formed and findings."""
    m = sized(_ruled(spark, sf_dir).select("manifest_id", "folder", "file_stem", "problems", F.col("m.name").alias("name"),
                                           F.when(F.size("problems") == 0, F.col("m")).alias("m")), "ruled")
    return RP.console(m, proposal_findings(spark, sf_dir, m.where("m is not null")))


def q_nontext_missing(spark, sf_dir):
    """FI3–FI5 on the documents corpus: every source is a corpus (a null
    `text` injected every 53rd document), two sources ask for a column the
    corpus lacks, and one mirror source has no rows."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "text", F.when(F.col("doc_id") % 53 == 0, F.lit(None).cast("string")).otherwise(F.col("text")))
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("path")).distinct()
    names = names.unionByName(names.where(F.col("path") == "src0").select(F.lit("src0_mirror").alias("path")))
    src = names.select(
        F.lit(0).cast("bigint").alias("manifest_id"), F.lit(1).alias("pos"), F.col("path").alias("subject"), "path",
        F.lit(None).cast("string").alias("name"), F.lit("train").alias("split"),
        F.lit(None).cast("string").alias("revision"),
        F.when(F.col("path").isin("src3", "src7"), F.lit("contents")).otherwise(F.lit("text")).alias("text_column"),
        F.lit(None).cast("string").alias("text_template"), F.lit(4096).alias("seq_len"))
    cat = names.select("path", F.lit(200).alias("http_status"), F.lit(False).alias("disabled"),
                       F.lit(None).cast("string").alias("gated"), F.array(F.lit("data.parquet")).alias("siblings"))
    loads = spark.createDataFrame([], "path string, status string, error_type string, error_msg string")
    rows = D.Corpora(docs.withColumn("dataset", F.col("source")), ["dataset"], lambda path, *_: {"dataset": path},
                     docs.schema, "doc_id")
    out = D.check_sources(src, cat, loads, None, rows, TIMEOUT)
    return out.select(F.col("path").alias("source"), F.inline("findings"))


QUERIES = {
    "corpus_scan": q_corpus_scan,
    "nontext_missing": q_nontext_missing,
    "check_outcome": q_check_outcome,
    "console_lines": q_console_lines,
    "hub_entry_findings": q_hub_entry_findings,
    "load_error_findings": q_load_error_findings,
    "source_findings": q_source_findings,
    "benchmark_verdicts": q_benchmark_verdicts,
    "benchmark_verdicts_unverified": q_benchmark_verdicts_unverified,
    "proposal_report": q_proposal_report,
}

from corpusgate.plans.datacheck_sql import ORACLES  # noqa: E402,F401
