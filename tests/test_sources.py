"""File scan, decode and the sinks."""
import json

import pytest

from corpusgate.sources.listing import scan_manifest_files, write_files
from corpusgate.sources.manifests import manifest_problems
from corpusgate.sources.sinks import append_batch, committed, read_batches, write_reports

from tests.test_rules import manifest


def test_scan_lists_manifests_two_levels_down(spark, tmp_path):
    root = tmp_path / "proposals"
    for place in ("marta/exp_tide_tables.yaml", "marta/exp_draft.yaml", "_bente/exp_tide_tables.yaml", "marta/notes.md",
                  "marta/deep/exp_x.yaml", ".marta/exp_x.yaml", "exp_x.yaml", "marta/.yaml", "marta/.x.yaml",
                  "marta/_b.yaml", "marta/no_suffix"):
        file = root / place
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(manifest()))
    files = scan_manifest_files(spark, [str(root), str(tmp_path / "missing")])
    listed = {f"{r.folder}/{r.file}" for r in files.select("folder", "file").collect()}
    assert listed == {"marta/exp_tide_tables.yaml", "marta/exp_draft.yaml", "_bente/exp_tide_tables.yaml", "marta/.x.yaml",
                      "marta/_b.yaml"}
    found = {f"{r.folder}/{r.file}": r.problems for r in manifest_problems(files).collect()}
    assert found["marta/exp_tide_tables.yaml"] == []
    assert all(found[x] for x in listed - {"marta/exp_tide_tables.yaml"})


def test_many_folders_are_listed_by_many_tasks(spark, tmp_path):
    names = [f"u{i % 40}/exp_{i}.yaml" for i in range(200)] + [".hid/exp_1.yaml"]
    write_files(spark.createDataFrame([(n, f"name: {n}") for n in names], "path string, text string"), str(tmp_path / "p"))
    files = scan_manifest_files(spark, [f"file://{tmp_path}/p"], folders=3)
    assert files.rdd.getNumPartitions() == 14
    assert {(f"{r.folder}/{r.file}", bytes(r.content).decode()) for r in files.collect()} == {(n, f"name: {n}") for n in names[:-1]}
    assert scan_manifest_files(spark, [str(tmp_path / "missing")]).collect() == []


def test_reports_are_few_files_and_append(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"# report {i}\n") for i in range(50)], "pr_id long, markdown string")
    write_reports(df, out, "pr_id")
    write_reports(df.limit(2), out, "pr_id", mode="append")
    assert spark.read.json(out).count() == 52
    assert len(list((tmp_path / "out").glob("*.json"))) < 20


def test_nothing_to_report_says_so(spark, tmp_path):
    df = spark.createDataFrame([], "pr_id long, markdown string")
    write_reports(df, str(tmp_path / "out"), "pr_id")
    [row] = spark.read.json(str(tmp_path / "out")).collect()
    assert row.markdown == "✅ Nothing to report.\n"


def test_one_text_file_per_key_on_request(spark, tmp_path):
    df = spark.createDataFrame([(1, "# a\n"), (2, "# b\n")], "pr_id long, markdown string")
    write_reports(df, str(tmp_path / "out"), "pr_id", per_key=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["pr_id=1", "pr_id=2"]


def test_a_batch_appended_again_adds_nothing(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "pr_id long, markdown string"
    df = spark.createDataFrame([(i, f"# {i}\n") for i in range(30)], schema)
    assert committed(spark, out).collect() == []
    assert append_batch(df.limit(10), out, "one") and append_batch(df, out, "two") and append_batch(df.limit(0), out, "none")
    assert not append_batch(df, out, "one") and not append_batch(df, out, "two") and not append_batch(df, out, "none")
    df.write.json(f"{out}/data/batch=broken")  # a run that broke off before its record
    got = read_batches(spark, out, schema)
    assert {r.batch: r["count"] for r in got.groupBy("batch").count().collect()} == {"one": 10, "two": 30}
    assert append_batch(df.limit(3), out, "broken")  # written anew, in whole
    assert read_batches(spark, out, schema).where("batch = 'broken'").count() == 3
    assert {(r.batch, r.rows) for r in committed(spark, out).collect()} == {("one", 10), ("two", 30), ("none", 0), ("broken", 3)}
    for bad in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            append_batch(df, out, bad)
