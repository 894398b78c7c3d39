"""Opening a corpus by config, split and revision, and a stable order for files without an id."""
from corpusgate.operators.profile import first_n
from corpusgate.sources.tables import corpus, with_file_ordinal


def test_a_corpus_is_chosen_by_its_partitions(spark, tmp_path):
    rows = [(f"text {c} {s} {r} {i}", c, s, r) for c in ("default", "x") for s in ("train", "test") for r in ("a1", "b2") for i in range(3)]
    spark.createDataFrame(rows, "text string, config string, split string, revision string").write.partitionBy(
        "config", "split", "revision").parquet(str(tmp_path / "corpus"))
    df = corpus(spark, str(tmp_path / "corpus"), partition_filters={"config": "x", "split": "test", "revision": None})
    assert sorted(r.text for r in df.collect()) == sorted(t for t, c, s, _ in rows if (c, s) == ("x", "test"))
    one = corpus(spark, str(tmp_path / "corpus"), partition_filters={"config": "x", "split": "test", "revision": "b2"})
    assert one.count() == 3


def test_first_rows_of_files_do_not_depend_on_how_they_are_split(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(1000).selectExpr("cast(id as string) as text", "id % 2 as source").repartition(4).write.parquet(path)

    def first(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = with_file_ordinal(corpus(spark, path))
            return sorted(r.text for r in first_n(df, ["source"], ["ord"], 5).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    assert first("128m") == first("1k") and len(first("128m")) == 10
