"""Task-name rules across manifests (MV21, MV27, JO6)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate import constants as K
from corpusgate.functions.ordered import joined
from corpusgate.functions.text import message
from corpusgate.operators.rules import name_ok, name_taken


def taken_names(manifests: DataFrame, id_col: str = "manifest_id") -> DataFrame:
    """MV21: a well-formed name that is already a task. The taken list is a
    six-name literal, so this is an `InSet` filter, not a join."""
    name = F.col("name")
    return manifests.where(name_ok(name) & name_taken(name)).select(
        F.lit("taken").alias("kind"), F.col(id_col).cast("string").alias("key"),
        F.concat(F.lit(K.VALUE_ERROR), message(K.MSG_TAKEN, name=name)).alias("message"))


def find_manifests(names: DataFrame, files: DataFrame, name: str = "name") -> DataFrame:
    """SO3: names(name) → (name, path). A path given directly wins; else the
    first file of that stem in path order, compared part by part (so
    `bob/x.yaml` comes before `bob-x/x.yaml`). `files` has root, folder,
    file_stem. A name without a file is not listed."""
    whole = F.concat_ws("/", "root", "folder", F.concat("file_stem", F.lit(K.PROPOSAL_SUFFIX)))
    listed = files.select("root", "folder", "file_stem", whole.alias("path")).distinct()
    first = listed.groupBy(F.col("file_stem").alias("stem")).agg(
        F.min_by("path", F.struct("root", "folder", "file_stem")).alias("by_stem"))
    asked = names.select(name).distinct()
    direct = listed.select(F.col("path").alias("by_path"))
    found = asked.join(direct, asked[name] == direct["by_path"], "left").join(first, asked[name] == first["stem"], "left")
    return found.select(name, F.coalesce("by_path", "by_stem").alias("path")).where(F.col("path").isNotNull())


def duplicate_names(manifests: DataFrame, folder: str = "folder", stem: str = "file_stem") -> DataFrame:
    """MV27: a file stem used by more than one file, owners listed in path
    order. Files are distinct (folder, stem) paths; the count runs first as a
    plain aggregate. The owners of stems that repeat are put in order by ranges
    of (stem, folder): a range's owners are joined into one piece, and a stem's
    pieces into the line that the message prints."""
    files = manifests.select(F.col(folder).alias("folder"), F.col(stem).alias("stem")).distinct()
    repeated = files.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("stem")
    ranged = files.join(repeated, "stem", "left_semi").repartitionByRange("stem", "folder")
    owners = joined(ranged.withColumn("range", F.spark_partition_id()), ["stem"], F.col("range"), ["folder"], "folder", ", ",
                    "owners")
    return owners.select(
        F.lit("duplicate").alias("kind"), F.col("stem").alias("key"),
        message(K.MSG_TWO_OWNERS, name=F.col("stem"), owners=F.col("owners")).alias("message"))
