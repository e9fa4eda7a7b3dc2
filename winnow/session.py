"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the plans rely on. The time zone is fixed so that report times are UTC; the others
# let Spark re-plan joins whose key (a file, a fingerprint) turns out to be hot.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A repeated key in scan JSON is not an error: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app_name: str = "winnow", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Shuffle files of an execution go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables written meanwhile leave no shuffle files behind: nothing reads those but the execution that made them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a table that several branches of a plan read, and go on from the written copy.

    It goes below the shared folder the cluster names in ``spark.checkpoint.dir``, so it outlives
    executors; being Parquet, each branch reads only the columns it needs and joins know its size.
    Tables of whole texts are written with ``codec`` ``TEXTS``. :func:`clear_stage` removes what a session has
    written, :func:`unstage` one table.
    """
    path = f"{staging_folder(df.sparkSession)}/winnow-stage-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Texts take about half the room of Spark's default.
TEXTS = "zstd"


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            remove(table.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder that a query has written below the staging folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(keys: DataFrame, rows: int = 500_000) -> DataFrame:
    """Distinct keys, written once, and sent to every task where they are at most ``rows`` rows.

    Beyond that they are joined as any table is, by a shuffle of both sides.
    """
    keys = stage(keys.distinct())
    return F.broadcast(keys) if keys.count() <= rows else keys


def tasks_for(spark: SparkSession, rows: int, each: int = 200_000) -> int:
    """In how many partitions to deal ``rows`` rows so that a task sorts about ``each`` of them, however many there are."""
    return max(rows // each + 1, min(spark.sparkContext.defaultParallelism, rows // 10_000 + 1))


def staging_folder(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``.

    A cluster has to name that folder, because one on a single machine is not shared. A session
    within one process that names none gets a scratch folder that goes when the process ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="winnow-stage-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def clear_stage(spark: SparkSession) -> None:
    """Remove this session's staged tables; results that still read them must be written before."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "winnow-stage-*")) or []:
            files.delete(found.getPath(), True)
