"""Shared folder for intermediate tables, row ids, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A local session without the setting gets a folder of its own; a cluster
    without it is an error, because a machine-local folder loses data there.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set(CHECKPOINT_DIR, made)
    return made


class Scratch:
    """Intermediate tables of one job, under the shared folder.

    Every table is written once and read back, which cuts the lineage: an
    executor that is lost afterwards costs no recomputation. The returned
    frames are lazy, so that the caller drops the folder after its last action.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def uri(self, name: str) -> str:
        """Full address of a folder here, also for readers outside the JVM."""
        path = self._hadoop_path(f"{self.root}/{name}")
        full = path.getFileSystem(self._conf()).makeQualified(path).toString()
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full

    def drop(self) -> None:
        path = self._hadoop_path(self.root)
        path.getFileSystem(self._conf()).delete(path, True)

    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows per Arrow batch: texts vary a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty one."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def leading(df: DataFrame, columns: list[str], keep: Column | None = None) -> DataFrame:
    """The first columns of `df` under the names `columns`, whatever the others are called.

    `keep` is a condition on a column of `df` named by its place: c0, c1 and so on.
    """
    places = [f"c{i}" for i in range(len(df.columns))]
    placed = df.toDF(*places)
    placed = placed if keep is None else placed.filter(keep)
    return placed.select(*places[: len(columns)]).toDF(*columns)


def seeded_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
