"""What every plan needs from the session: shared storage and sizes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_SWEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only an in-process ``local[...]`` master may go without it; a temporary folder stands in then.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        made = _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, made, True)
    return _LOCAL_DIRS[context.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for an intermediate table of this application.

    It stays while results may still read it and goes with ``release``, at the latest when the driver ends.
    """
    context = spark.sparkContext
    base = f"{shared_dir(spark)}/tidemark/{context.applicationId}"
    if context.applicationId not in _SWEPT:
        _SWEPT.add(context.applicationId)
        atexit.register(_delete, context._jvm, context._jsc.hadoopConfiguration(), base)
    return f"{base}/{uuid.uuid4().hex}-{label}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors.

    This runs ``df`` at once, while a plan is built.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is read in fewer tasks than there are cores: for costly work on small tables in one file.

    A choice by size that changes no result: a table of many files or row groups is left as it is, so nothing is
    shuffled at scale. ``df`` must be rows of a table as read: counting the tasks of a shuffled one would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _delete(jvm, configuration, path: str) -> None:
    try:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)
    except Exception:  # noqa: BLE001 - at the end of a driver its JVM may be gone
        pass


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that still read them must have been consumed."""
    context = spark.sparkContext
    _delete(context._jvm, context._jsc.hadoopConfiguration(), f"{shared_dir(spark)}/tidemark/{context.applicationId}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-src-')}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
