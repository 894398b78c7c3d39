"""Spark session settings that the operators assume."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusgate") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in `spark.checkpoint.dir`.

    Where the session names none, a local master (tests) gets a scratch folder
    and a cluster an error: a folder of one machine is none that executors share."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return spark.sparkContext.getCheckpointDir() or current
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="corpusgate-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """This session's own folder in the checkpoint folder; it goes when the session's JVM ends."""
    path = f"{checkpoint_dir(spark)}/corpusgate-{spark.sparkContext.applicationId}"
    if path not in _KNOWN:
        _KNOWN.add(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = place.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(place)
        system.deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below `scratch_dir`."""
    if not path.startswith(f"{scratch_dir(spark)}/"):
        raise ValueError(f"{path} is not this session's")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_KNOWN: set[str] = set()
