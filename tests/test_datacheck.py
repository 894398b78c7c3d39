"""Source and benchmark verdicts with the catalog, loads and corpus as tables."""
from pyspark.sql import functions as F

from corpusgate.operators import datacheck as D
from corpusgate.plans import datacheck as plans

LONG = "x" * 300
CAT = "path string, http_status int, disabled boolean, gated string, siblings array<string>"
LOADS = "path string, status string, error_type string, error_msg string"
SPLITS = "path string, config string, split string"
SRC = ("manifest_id long, pos int, subject string, path string, name string, split string, revision string, "
       "text_column string, text_template string, seq_len int")


def corpus(spark, rows_by_path):
    data = [(p, i, t) for p, texts in rows_by_path.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "ds string, ord long, contents string")


def run(spark, sources, catalog, loads=(), splits=(), rows_by_path=None):
    src = spark.createDataFrame(sources, SRC)
    cat = spark.createDataFrame(catalog, CAT)
    ld = spark.createDataFrame(list(loads), LOADS)
    sp = spark.createDataFrame(list(splits), SPLITS)
    corp = corpus(spark, rows_by_path or {})
    out = D.check_sources(src, cat, ld, sp, D.Corpora(corp, ["ds"], lambda path, *_: {"ds": path}, corp.schema, "ord"), 60.0)
    rows = out.select("pos", F.inline("findings")).orderBy("pos", "ord").collect()
    return [(r.level, r.message) for r in rows]


def source(path, column="contents", template=None, name=None, split="train", revision=None, pos=1):
    subject = path + (f" [{name}]" if name else "") + f" / {split}"
    return (1, pos, subject, path, name, split, revision, column, template, 1024)


def good(n=50):
    return [f"{i:05d} {LONG}" for i in range(n)]


def ok_entry(path, siblings=("README.md", "data/train-0.parquet"), gated=None):
    return (path, 200, False, gated, list(siblings))


def test_good_source_passes(spark):
    out = run(spark, [source("org/a")], [ok_entry("org/a")], rows_by_path={"org/a": good()})
    assert out == [("ok", "streams, and 'contents' is usable text (50 rows sampled)")]


def test_missing_disabled_and_http_errors(spark):
    out = run(spark, [source("org/none", revision="a" * 40), source("org/off", pos=2), source("org/500", pos=3)],
              [("org/off", 200, True, None, []), ("org/500", 500, False, None, [])])
    assert out == [("error", f"revision {'a' * 40} of org/none does not exist on the Hub (or is private)"),
                   ("error", "org/off is disabled on the Hub"),
                   ("error", "the Hub answered 500 for org/500")]


def test_gated_training_data_only_warns(spark):
    out = run(spark, [source("org/a")], [ok_entry("org/a", gated="manual")], rows_by_path={"org/a": good()})
    assert len(out) == 1 and out[0][0] == "warning" and "rows were not checked" in out[0][1]


def test_single_file_json_corpus_warns(spark):
    out = run(spark, [source("org/a")], [ok_entry("org/a", ("README.md", "MetaMathQA-395K.json"))],
              rows_by_path={"org/a": good()})
    assert out[0] == ("warning", "org/a is published as 1 file(s) (MetaMathQA-395K.json) in a format a streaming "
                                 "reader cannot read a piece at a time; every miner would pull and parse the whole "
                                 "file each round. Prefer a parquet-sharded export.")
    assert out[1][0] == "ok"


def test_load_failures(spark):
    loads = [("org/a", "error", "KeyError", "'train'"), ("org/b", "timeout", None, None),
             ("org/c", "error", "RuntimeError", "Dataset scripts are no longer supported, but found x.py")]
    splits = [("org/a", "default", "validation"), ("org/a", "en", "train")]
    out = run(spark, [source("org/a"), source("org/b", pos=2), source("org/c", pos=3)],
              [ok_entry("org/a"), ok_entry("org/b"), ok_entry("org/c")], loads, splits)
    assert out[0] == ("error", "cannot be streamed: KeyError: 'train'. The Hub lists: "
                               "name='default' split='validation', name='en' split='train'")
    assert out[1] == ("error", "streaming 200 rows of org/b took longer than 60s; "
                               "a miner's dataloader would stall the same way")
    assert out[2] == ("error", "cannot be streamed: org/c uses a loading script, which current `datasets` "
                               "refuses to run. Use a parquet export.")


def test_missing_column_and_zero_rows(spark):
    out = run(spark, [source("org/a", column="text"), source("org/b", pos=2)],
              [ok_entry("org/a"), ok_entry("org/b")], rows_by_path={"org/a": good()})
    assert out == [("error", "no column 'text'; the columns are ['contents', 'ds', 'ord']"),
                   ("error", "split 'train' streamed zero rows")]


def test_template_source_is_rendered(spark):
    out = run(spark, [source("org/a", column=None, template="{ds}: {contents}")], [ok_entry("org/a")],
              rows_by_path={"org/a": good()})
    assert out == [("ok", "streams, and text_template over 'ds', 'contents' renders usable text (50 rows sampled)")]


def test_benchmark_verdicts(spark):
    bench = spark.createDataFrame(
        [(1, 1, "b1", "lm_eval", "t_known", "org/a", None, "test"), (1, 2, "b2", "lm_eval", "t_new", "org/a", None, "test"),
         (1, 3, "b3", "eval_loss", None, "org/g", None, "test"), (1, 4, "b4", "eval_loss", None, "org/t", None, "test")],
        "manifest_id long, pos int, name string, harness string, task string, ds_path string, ds_name string, "
        "ds_split string")
    cat = spark.createDataFrame([ok_entry("org/a"), ok_entry("org/g", gated="auto"), ok_entry("org/t")], CAT)
    loads = spark.createDataFrame([("org/t", "timeout", None, None)], LOADS)
    rows = corpus(spark, {"org/a": good(5), "org/g": good(1), "org/t": good(1)})
    tasks = spark.createDataFrame([("t_known",)], "task string")
    corpora = D.Corpora(rows, ["ds"], lambda path, *_: {"ds": path}, rows.schema, "ord")
    out = D.check_benchmarks(bench, cat, loads, None, corpora, tasks)
    got = [(r.pos, r.level, r.message) for r in out.select("pos", F.inline("findings")).orderBy("pos", "ord").collect()]
    assert got == [
        (1, "ok", "org/a / test is readable and lm-eval knows 't_known'"),
        (2, "error", "lm-eval has no task 't_new'. If it is a custom task, say so in the PR and include its YAML; "
                     "the owner will review it."),
        (3, "warning", "org/g is gated (auto); the owner needs access to score it"),
        (3, "ok", "org/g / test is readable for a held-out loss"),
        (4, "warning", "streaming 1 rows of org/t took longer than 60s; could not confirm the split is readable"),
        (4, "ok", "org/t / test is readable for a held-out loss"),
    ]


FULL_CAT = "path string, revision string, http_status int, detail string, disabled boolean, gated string, siblings array<string>"
FULL_LOADS = "path string, config string, split string, revision string, status string, error_type string, error_msg string"
PIN = "0a" * 20


def run_full(spark, sources, catalog, loads, rows):
    """`rows`: (path, config, split, text); what a source reads is its own config and split."""
    corp = spark.createDataFrame([(p, c, s, i, t) for i, (p, c, s, t) in enumerate(rows)],
                                 "ds string, cfg string, part string, ord long, contents string")
    out = D.check_sources(
        spark.createDataFrame(sources, SRC), spark.createDataFrame(catalog, FULL_CAT), spark.createDataFrame(loads, FULL_LOADS),
        None, D.Corpora(corp, ["ds", "cfg", "part"],
                        lambda path, name, split, _: {"ds": path, "cfg": F.coalesce(name, F.lit("default")), "part": split},
                        corp.schema, "ord"), 60.0)
    return {r.pos: [f.message for f in r.findings] for r in out.collect()}


def test_config_and_split_choose_the_rows_and_the_outcome(spark):
    data = ["README.md", "data/a.parquet"]
    rows = ([("org/a", "default", "train", t) for t in good(40)] + [("org/a", "x", "train", t) for t in good(7)]
            + [("org/a", "default", "test", "short")] * 5)
    got = run_full(spark, [source("org/a"), source("org/a", name="x", pos=2), source("org/a", split="test", pos=3),
                           source("org/a", split="dev", pos=4), source("org/a", name="y", pos=5)],
                   [("org/a", None, 200, None, False, None, data)],
                   [("org/a", "y", "train", None, "error", "KeyError", "'y'")], rows)
    assert got[1] == ["streams, and 'contents' is usable text (40 rows sampled)"]
    assert got[2] == ["streams, and 'contents' is usable text (7 rows sampled)"]
    assert got[3] == ["100% of sampled rows are under 200 characters; the validator's eval drops those, so there would be "
                      "too little to score on"]
    assert got[4] == ["split 'dev' streamed zero rows"]
    assert got[5] == ["cannot be streamed: KeyError: 'y'"]


def test_a_revision_must_be_known_and_the_host_in_reach(spark):
    rows = [(p, "default", "train", t) for p in ("org/a", "org/b") for t in good(3)]
    data = ["README.md", "data/a.parquet"]
    got = run_full(spark, [source("org/a", revision=PIN), source("org/b", revision=PIN, pos=2), source("org/c", pos=3)],
                   [("org/a", None, 200, None, False, None, data), ("org/a", PIN, 200, None, False, None, data),
                    ("org/b", None, 200, None, False, None, data), ("org/c", None, None, "timed out", False, None, [])],
                   [], rows)
    assert got == {1: ["streams, and 'contents' is usable text (3 rows sampled)"],
                   2: [f"revision {PIN} of org/b does not exist on the Hub (or is private)"],
                   3: ["could not reach the Hub: timed out"]}


def test_a_subject_with_an_earlier_error_is_not_ok(spark):
    from corpusgate.operators.report import settled

    rows = [(1, 0, 1, "org/a / train", [(4, "error", "no")]), (1, 0, 2, "org/a / train", [(5, "warning", "w"), (7, "ok", "yes")]),
            (1, 0, 3, "org/b / train", [(7, "ok", "yes")]), (2, 0, 1, "org/a / train", [(7, "ok", "yes")])]
    df = spark.createDataFrame(rows, "manifest_id long, kind int, pos int, subject string, "
                                     "findings array<struct<ord:int,level:string,message:string>>")
    got = {(r.manifest_id, r.pos): [f.level for f in r.findings] for r in settled(df).collect()}
    assert got == {(1, 1): ["error"], (1, 2): ["warning"], (1, 3): ["ok"], (2, 1): ["ok"]}


def test_a_hot_corpus_is_dealt_over_all_tasks(spark, monkeypatch):
    rows = spark.range(10_000).selectExpr("case when id % 10 = 0 then concat('c', id % 70) else 'hot' end as ds", "id as ord")
    wanted = spark.createDataFrame([("hot", 1), ("hot", 2), ("c0", 3), ("nowhere", 4), (None, 5)], "k_ds string, rid long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = D.salted(rows, wanted, ["ds"], "ord", most=0)
        spread = {r.p: r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
        counts = {r.rid: r.n for r in got.groupBy("rid").agg(F.countDistinct("ord").alias("n"), F.count("*").alias("m"))
                  .where("n = m").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert counts == {1: 9000, 2: 9000, 3: 143}
    assert max(spread.values()) < 0.5 * sum(spread.values()) and len(spread) >= 4
    monkeypatch.setattr(D, "SALT_ABOVE", 0)
    assert D.salted(rows, wanted, ["ds"], "ord").where("rid < 4").count() == 18_143


def test_salting_changes_no_verdict(spark, monkeypatch):
    monkeypatch.setattr(D.salted, "__defaults__", (0,))
    out = run(spark, [source("org/a"), source("org/b", pos=2)], [ok_entry("org/a"), ok_entry("org/b")],
              rows_by_path={"org/a": good(400), "org/b": good(3)})
    assert out == [("ok", "streams, and 'contents' is usable text (400 rows sampled)"),
                   ("ok", "streams, and 'contents' is usable text (3 rows sampled)")]


def test_every_document_belongs_to_a_corpus_that_can_be_named(spark, tmp_path):
    from corpusgate.plans import datacheck as plan

    text = "y" * 250
    langs = [None, "es", "en", "de", "fr", "", "xx"]
    docs = spark.createDataFrame([(i, f"{i} {text}", langs[i % 7], None if i % 5 == 0 else "src0", 250) for i in range(140)]
                                 + [(None, text, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    corpora = plan.corpora(spark, str(tmp_path))
    asked = [(f"org/corpus-{k}", c, s, r) for k in (0, 20) for c in (None, "", "a", "r", "zzz") for s in ("train", "validation")
             for r in (None, "0a" * 20, "main")] + [("no/such", None, "train", None)]
    req = corpora.named(spark.createDataFrame(asked, "path string, name string, split string, revision string")
                        .selectExpr("*", "'text' as text_column", "cast(null as string) as text_template", "1024 as seq_len"),
                        "path", "name", "split", F.col("revision")).drop("path", "name", "split", "revision")
    got = {(r.k_dataset, r.k_config, r.k_split, r.k_added): r for r in D.profile(req, corpora).collect()}
    rows = {k: r.rows or 0 for k, r in got.items()}
    assert sum(n for (d, *_, a), n in rows.items() if a == "head") == 141  # each document once
    assert rows["src0", "default", "train", "0a" * 20] + rows["src0", "default", "validation", "0a" * 20] \
        == sum(1 for i in range(140) if langs[i % 7] not in ("de", "fr") and i % 4 != 3) + 1
    assert all(n == 0 for (d, c, s, a), n in rows.items() if c == "zzz" or a == "main" or d is None)


def test_only_named_partitions_are_opened(spark, tmp_path):
    from corpusgate.sources import store

    docs = spark.range(300).selectExpr("id as ord", "concat('d', id % 3) as ds", "concat('c', id % 5) as config", "'x' as contents")
    rows = store.opened(spark, "t", str(tmp_path), lambda: docs, ["config"])
    assert rows.count() == 300 and store.opened(spark, "t", str(tmp_path), lambda: None, ["config"]).count() == 300
    pinned = rows.where("config = 'c1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(config" in pinned
    spark.createDataFrame([("c2", 0)], "k_config string, rid long").write.parquet(str(tmp_path / "req"))
    wanted = spark.read.parquet(str(tmp_path / "req")).where("rid >= 0")
    joined = D.salted(rows, wanted, ["config"], "ord")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 60


def test_histograms_serve_every_window_from_one_table(spark):
    texts = spark.createDataFrame([(0, c * n, False) for c, n in (("x", 5000), ("y", 300), ("", 0), ("", 0))] + [(1, None, True), (1, "ab", False)],
                                  "rid long, text string, bad boolean")
    windows = spark.createDataFrame([(0, 1024), (0, 2048), (0, 64), (1, None), (2, 1024)], "rid long, seq_len int")
    got = {(r.rid, r.seq_len): tuple(r)[2:] for r in D.histograms(texts, windows).collect()}
    assert got == {(0, 1024): (4, 0, 150, 0.5, 0.0, 0.25), (0, 2048): (4, 0, 150, 0.5, 0.0, 0.0),
                   (0, 64): (4, 0, 150, 0.5, 0.0, 0.5), (1, None): (2, 1, 1, 1.0, 0.0, 0.0)}


def test_statistics_are_written_so_that_their_bytes_decide_the_join(spark):
    src, cat = spark.createDataFrame([source("org/a")], SRC), spark.createDataFrame([ok_entry("org/a")], CAT)
    corp = corpus(spark, {"org/a": good()})
    out = D.check_sources(src, cat, spark.createDataFrame([], LOADS), None,
                          D.Corpora(corp, ["ds"], lambda path, *_: {"ds": path}, corp.schema, "ord"))
    assert any("/stats-" in f for f in out.inputFiles())


def test_sources_are_written_once_for_specs_and_verdicts(spark, tmp_path):
    tables = {
        "lineitem": ([(1, 5, 1, 1, 2.0, 3.0, "N", "O", "1997-01-01")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                     "l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate string"),
        "orders": ([(1, 1, "O", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "part": ([(5, 1)], "p_partkey long, p_size int"),
        "documents": ([(1, LONG, "en", "src5", 300)], "doc_id long, text string, lang string, source string, n_chars long")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = plans.checked_sources(spark, str(tmp_path))
    assert any("/sources-" in f for f in out.inputFiles()) and not any("lineitem" in f for f in out.inputFiles())
    assert [(r.manifest_id, r.pos, r.subject) for r in out.collect()] == [(1, 1, "org/corpus-5 / train")]


def test_findings_stand_in_the_plan_once(spark):
    """A filter on their list, put before its rows are made, would compute them a second time."""
    one = F.array(F.struct(F.lit(1).alias("ord"), F.lit("error").alias("level"),
                           F.concat(F.lit("marker "), F.col("id").cast("string")).alias("message")))
    findings = F.when(F.col("id") == 0, F.slice(one, 1, 0)).when(F.col("id") > 1, one)  # empty, null, one
    out = plans._explode(spark.range(4).select("id", findings.alias("findings")), ["id"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(2, 1, "error", "marker 2"), (3, 1, "error", "marker 3")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
