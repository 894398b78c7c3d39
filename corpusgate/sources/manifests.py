"""Manifests as one nested struct per file (SC5, SC6 and the fixture adapter).

Every rule in `operators.rules` reads this shape, whatever the manifests
were read from:

    manifest_id BIGINT, folder STRING, file_stem STRING,
    name, title STRING, proposer STRUCT<github, contact>, description STRING,
    data STRUCT<dataset_sources ARRAY<source>, sequence_length INT>,
    n_sources INT, benchmarks ARRAY<benchmark>, n_benchmarks INT,
    hypothesis, evidence STRING, suggested_training STRUCT<steps, batch_size>, contamination STRING

Whole numbers are DECIMAL(38,0), so no value that a manifest names is altered.

`n_sources` / `n_benchmarks` are the list lengths as written. A list longer
than its limit is only ever reported by its length, so the adapter collects
the items of a manifest only when the list is within the limit: no group
larger than the rule allows is gathered into one row.
"""
from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.sources.fixtures import fixture
from corpusgate.sources.yaml_decode import read_batches

SOURCE_TYPE = ("struct<pos:int,path:string,name:string,split:string,weight:double,text_column:string,"
               "text_template:string,revision:string,license:string>")
DATASET_TYPE = "struct<path:string,name:string,split:string>"
BENCHMARK_TYPE = (f"struct<pos:int,name:string,harness:string,task:string,num_fewshot:decimal(38,0),metric:string,"
                  f"higher_is_better:boolean,dataset:{DATASET_TYPE},why:string>")
MANIFEST_FIELDS = (
    "name:string,title:string,proposer:struct<github:string,contact:string>,description:string,"
    f"data:struct<dataset_sources:array<{SOURCE_TYPE}>,sequence_length:int>,"
    f"benchmarks:array<{BENCHMARK_TYPE}>,hypothesis:string,evidence:string,"
    "suggested_training:struct<steps:decimal(38,0),batch_size:decimal(38,0)>,contamination:string"
)
ERROR_LIST = "array<struct<sec:int,item:int,sub:int,loc:string,msg:string>>"


def _bounded_items(items: DataFrame, key: str, limit: int, struct_cols) -> DataFrame:
    """(key, n, items) with items sorted by pos, present only when n <= limit.

    One exchange: rows past the limit are never collected. `pos` counts a
    manifest's rows from 1, so they are just the rows with pos > limit.
    """
    item = F.when(F.col("pos") <= limit, F.struct(*struct_cols))
    found = items.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_list(item).alias("items"))
    return found.withColumn("items", F.when(F.col("n") <= limit, F.array_sort("items")))


def nest_fixture(manifests: DataFrame, sources: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Flat fixture rows → one nested manifest row per manifest_id."""
    src = _bounded_items(sources, "manifest_id", K.MAX_SOURCES, [
        "pos", "path", "name", F.coalesce("split", F.lit(K.DEFAULT_SPLIT)).alias("split"), "weight",
        "text_column", "text_template", "revision", F.lit(None).cast("string").alias("license")])
    bench = _bounded_items(benchmarks, "manifest_id", K.MAX_BENCHMARKS, [
        "pos", "name", "harness", "task", F.col("num_fewshot").cast("decimal(38,0)").alias("num_fewshot"), "metric",
        "higher_is_better", F.struct(F.col("ds_path").alias("path"), F.col("ds_name").alias("name"),
                 F.col("ds_split").alias("split")).alias("dataset"),
        F.lit(None).cast("string").alias("why")])
    src = src.select("manifest_id", F.col("n").alias("n_sources"), F.col("items").alias("sources"))
    bench = bench.select("manifest_id", F.col("n").alias("n_benchmarks"), F.col("items").alias("benchmarks"))
    m = manifests.join(src, "manifest_id", "left").join(bench, "manifest_id", "left")
    suggested = F.when(F.col("steps").isNotNull() | F.col("batch_size").isNotNull(),
                       F.struct(*[F.col(c).cast("decimal(38,0)").alias(c) for c in ("steps", "batch_size")]))
    return m.select(
        "manifest_id", "folder", "file_stem", "name", "title",
        F.struct(F.col("github"), F.lit(None).cast("string").alias("contact")).alias("proposer"),
        "description",
        F.struct(F.coalesce(F.col("sources"), F.array().cast(f"array<{SOURCE_TYPE}>"))
                 .alias("dataset_sources"),
                 F.coalesce(F.col("sequence_length"), F.lit(K.DEFAULT_SEQUENCE_LENGTH)).alias("sequence_length"))
        .alias("data"),
        F.coalesce(F.col("n_sources"), F.lit(0)).alias("n_sources"),
        F.coalesce(F.col("benchmarks"), F.array().cast(f"array<{BENCHMARK_TYPE}>"))
        .alias("benchmarks"),
        F.coalesce(F.col("n_benchmarks"), F.lit(0)).alias("n_benchmarks"),
        "hypothesis", "evidence", suggested.alias("suggested_training"), "contamination",
    )


def fixture_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest_fixture(fixture(spark, sf_dir, "fx_manifests"), fixture(spark, sf_dir, "fx_sources"),
                        fixture(spark, sf_dir, "fx_benchmarks"))


# ---------------------------------------------------------------------------
# Manifest files (SC6; `sources.listing` lists them, SC5)

def decode_manifests(files: DataFrame, deal: bool = True) -> DataFrame:
    """SC6, MV1, MV2: files(path, folder, file_stem, content or text) → the nested
    manifest `m`, list lengths, `type_errors` and `load_problems`.

    The helper reads each file once; its typed struct is what every rule sees.
    Decoding is Python work, so a small file table is dealt over all cores; `deal=False` spares the shuffle
    of all contents where `files` lies in as many parts already."""
    if "content" not in files.columns:
        files = files.withColumn("content", F.encode("text", "UTF-8")).drop("text")
    keep = [c for c in files.columns if c != "content"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    typed = (f"load_problem string, n_sources int, n_benchmarks int, type_errors {ERROR_LIST}, "
             f"m struct<{MANIFEST_FIELDS}>")
    dealt = files.repartition(files.sparkSession.sparkContext.defaultParallelism) if deal else files
    decoded = dealt.mapInArrow(read_batches, f"{kept}, {typed}")
    label = F.concat(F.col("folder"), F.lit("/"), F.col("file_stem"), F.lit(".yaml: "))
    mid = [] if "manifest_id" in keep else [F.xxhash64("path").alias("manifest_id")]
    none = F.array().cast("array<string>")
    return decoded.select(
        *keep, *mid, F.when(F.col("load_problem").isNotNull(), F.array(F.concat(label, F.col("load_problem"))))
        .otherwise(none).alias("load_problems"),
        F.coalesce("type_errors", F.array().cast(ERROR_LIST)).alias("type_errors"), "n_sources", "n_benchmarks", "m")


def manifest_problems(files: DataFrame, deal: bool = True) -> DataFrame:
    """MV28 for files: decode, evaluate every rule, and label the problems.
    A file that does not load reports only its load problem."""
    from corpusgate.operators.rules import with_rule_columns

    d = with_rule_columns(decode_manifests(files, deal), extra="type_errors")
    return d.withColumn("problems", F.when(F.size("load_problems") > 0, F.col("load_problems"))
                        .otherwise(F.col("problems")))


def files_from_texts(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(folder, file_stem, text) triples as a files table (tests, fixtures)."""
    df = spark.createDataFrame(rows, "folder string, file_stem string, text string")
    return df.withColumn("path", F.concat(F.col("folder"), F.lit("/"), F.col("file_stem"), F.lit(".yaml")))


def fixture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture manifests as manifest documents (JSON, which is YAML):
    one row per manifest with every source and benchmark it names."""
    src = fixture(spark, sf_dir, "fx_sources")
    bench = fixture(spark, sf_dir, "fx_benchmarks")
    s = src.groupBy("manifest_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "path", "name", "split", "weight", "text_column", "text_template", "revision"))).alias("s"))
    b = bench.groupBy("manifest_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "name", "harness", "task", "num_fewshot", "metric", "higher_is_better", "ds_path", "ds_name",
        "ds_split"))).alias("b"))
    m = fixture(spark, sf_dir, "fx_manifests").join(s, "manifest_id", "left").join(b, "manifest_id", "left")
    doc = F.struct(
        "name", "title", F.struct("github").alias("proposer"), "description",
        F.struct(F.transform(F.coalesce("s", F.array()), lambda x: x.dropFields("pos")).alias("dataset_sources"),
                 "sequence_length").alias("data"),
        F.transform(F.coalesce("b", F.array()), lambda x: F.struct(
            x["name"].alias("name"), x["harness"].alias("harness"), x["task"].alias("task"),
            x["num_fewshot"].alias("num_fewshot"), x["metric"].alias("metric"),
            x["higher_is_better"].alias("higher_is_better"),
            F.struct(x["ds_path"].alias("path"), x["ds_name"].alias("name"), x["ds_split"].alias("split"))
            .alias("dataset"))).alias("benchmarks"),
        "hypothesis", "evidence",
        F.when(F.col("steps").isNotNull() | F.col("batch_size").isNotNull(),
               F.struct("steps", "batch_size")).alias("suggested_training"),
        "contamination")
    return m.select("manifest_id", "folder", "file_stem",
                    F.concat("folder", F.lit("/"), "file_stem", F.lit(".yaml")).alias("path"),
                    F.to_json(doc).alias("text"))
