"""Working tables in the folder that driver and executors share, and the package's place for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset on a single machine, as in tests, a new local folder is taken. On a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """For writes: the shuffle files of each go when it is done, so that those of one step aren't on disk beside those of the next."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a task of wide sorts and of lists, about.
TASK_ROWS = 400_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """The number of tasks that have some TASK_ROWS rows each, however many rows there are."""
    return max(rows // TASK_ROWS + 1, spark.sparkContext.defaultParallelism)


def let_workers_import(spark: SparkSession | None = None) -> None:
    """Put the package's folder on the path of Python workers, of this session or the active one and of those to come.

    For checkouts; on a cluster, install the package or pass it with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

    def extended(path: str) -> str:
        parts = [p for p in path.split(os.pathsep) if p]
        return os.pathsep.join(parts if root in parts else [root, *parts])

    os.environ["PYTHONPATH"] = extended(os.environ.get("PYTHONPATH", ""))
    if spark := spark or SparkSession.getActiveSession():
        environment = spark.sparkContext.environment
        environment["PYTHONPATH"] = extended(environment.get("PYTHONPATH", ""))
