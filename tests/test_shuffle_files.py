"""Stored tables leave no shuffle files behind."""

import re
import time

from pyspark.sql import functions as F

from paylens import reuse


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" ")))


def test_shuffle_files_go_with_the_job_of_a_table(spark):
    before, kept = _shuffle_files(spark), spark.conf.get(next(iter(reuse.FILES_GO)), None)
    dealt = spark.range(50_000).repartition("id").withColumn("n", F.col("id") + 1)
    table = reuse.computed_once(dealt, dealt=True)
    until = time.time() + 20
    # executors remove their files a moment after the job
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(next(iter(reuse.FILES_GO)), None) == kept
    # the plan itself can be read again
    assert table.count() == 50_000 and dealt.exceptAll(table).isEmpty()
