"""Computing an intermediate result once when several branches read it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def job_folder(spark: SparkSession, job: str) -> str:
    """A folder of its own for one job, below the shared one."""
    return f"{_shared_folder(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"


# by default a join deals both sides anew unless they are dealt by all of its keys
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
# A task that joins and sorts what it holds needs many times the bytes it reads, so
# that partitions are cut small: many at first, then merged up to a size.
SMALL_PARTITIONS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # a scan that sorts what it counts holds many times what the file takes, too
    "spark.sql.files.maxPartitionBytes": "32m",
}
# nobody reads the shuffle files of a table's job once the table stands; otherwise they
# stay on the executors' disks until the driver happens to collect its garbage
FILES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs inside; the former ones come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def computed_once(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Write `df` as a table in the shared checkpoint folder and read it back.

    The lineage ends there, so a lost executor costs nothing upstream, and the
    readers prune columns and know the table's size.
    Without a shared folder this is an error.

    ``dealt`` says that the plan deals its tables by keys that all its joins
    share, such as the account: joins on more keys then stay in these
    partitions, so that each table is moved once.
    """
    spark = df.sparkSession
    path = job_folder(spark, "paylens")
    values = {**SMALL_PARTITIONS, **FILES_GO}
    if dealt:
        values[ALL_KEYS] = "false"
    with settings(spark, values):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
