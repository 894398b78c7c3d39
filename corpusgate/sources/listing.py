"""Manifest trees listed as they are (SC5): a Python data source with its own listing.

Spark's readers never show files whose name starts with `_` or `.`; the tree's
rule is another one: every `<login>/<name>.yaml` directly two levels under a root,
folders starting with `.` left out, files starting with `.` or `_` kept, in name
order. The driver lists the roots' folders; each partition is a group of folders,
which a task lists and reads, so neither names nor contents meet in one place.
Any store that Arrow reads will do (local and mounted folders, hdfs://, s3://, gs://).
"""
from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusgate.functions import workers  # noqa: F401  (task code travels with the job)

FOLDERS = 64  # folders that one task lists and reads
SCHEMA = "root string, folder string, file string, file_stem string, path string, content binary"


def opened(uri: str):
    """(filesystem, path) of a path or URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def listed(filesystem, path: str) -> list:
    """What lies directly in a folder, by name; nothing if there is none."""
    from pyarrow import fs

    found = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(found, key=lambda f: f.base_name)


class Folders(InputPartition):
    def __init__(self, root: str, folders: list[str]):
        self.root, self.folders = root, folders


class ManifestReader(DataSourceReader):
    def __init__(self, roots: list[str], folders: int):
        self.roots, self.size = roots, folders

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        out: list[InputPartition] = []
        for root in self.roots:
            filesystem, path = opened(root)
            names = [f.base_name for f in listed(filesystem, path)
                     if f.type == fs.FileType.Directory and not f.base_name.startswith(".")]
            out += [Folders(root, names[a:a + self.size]) for a in range(0, len(names), self.size)]
        return out or [Folders("", [])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.folders:
            return
        filesystem, path = opened(partition.root)
        name = path.rstrip("/").rsplit("/", 1)[-1]
        for folder in partition.folders:
            for found in listed(filesystem, f"{path.rstrip('/')}/{folder}"):
                file = found.base_name
                stem, dot, suffix = file.rpartition(".")
                if found.type != fs.FileType.File or suffix != "yaml" or not stem:  # `.yaml` alone has no suffix
                    continue
                with filesystem.open_input_stream(found.path) as stream:
                    yield name, folder, file, stem, found.path, stream.read()


class ManifestFiles(DataSource):
    """`spark.read.format("manifest_files").option("roots", json)`."""

    @classmethod
    def name(cls) -> str:
        return "manifest_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ManifestReader(json.loads(self.options["roots"]), int(self.options.get("folders", FOLDERS)))


def write_files(files: DataFrame, root: str, path: str = "path", text: str = "text") -> None:
    """Each row as one file `root`/`path`, written by the tasks; a row written again replaces itself."""
    root = root.rstrip("/")

    def write(batches):
        import pyarrow

        for batch in batches:
            for name, content in zip(batch.column(path).to_pylist(), batch.column(text).to_pylist()):
                filesystem, full = opened(f"{root}/{name}")
                filesystem.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with filesystem.open_output_stream(full) as stream:
                    stream.write((content or "").encode("utf-8"))
            yield pyarrow.RecordBatch.from_pydict({"n": [len(batch)]})

    files.select(path, text).mapInArrow(write, "n bigint").agg({"n": "sum"}).collect()


def scan_manifest_files(spark: SparkSession, roots: list[str], folders: int = FOLDERS) -> DataFrame:
    """SC5: root, folder, file, file_stem, path, content of every manifest under `roots`; a missing root has none."""
    spark.dataSource.register(ManifestFiles)
    return (spark.read.format("manifest_files").option("roots", json.dumps([r.rstrip("/") for r in roots]))
            .option("folders", folders).load())
