"""Streaming form of the hourly check.

Attempts are de-duplicated by transaction id within the watermark and counted
in tumbling hours; closed hours are compared with a static same-weekday,
same-hour baseline. Late rows beyond the watermark are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.sources.transactions import txn_scope

# tolerated lag of the near-real-time feed is 5 to 15 minutes
WATERMARK = "15 minutes"
KEYS = ("src_system_id", "cc_first_6_nbr")


def distinct_attempts(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One row per transaction id as long as its copies arrive in time."""
    return stream.withWatermark("trans_dt_ut", watermark).dropDuplicatesWithinWatermark(
        ["transaction_guid"]
    )


def hourly_counts(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Transactions and successes per source, BIN and hour.

    Duplicates are removed first, so plain counts are distinct counts.
    """
    scoped = txn_scope(stream, None, None)
    won = sem.succeeded(F.col("trans_status_desc"))
    return (
        distinct_attempts(scoped, watermark)
        .groupBy(F.window("trans_dt_ut", "1 hour"), *KEYS)
        .agg(
            F.count(F.lit(1)).alias("hourly_ct"),
            F.sum(F.when(won, 1).otherwise(0)).cast("long").alias("hourly_success_ct"),
        )
        .select(F.col("window.start").alias("hour_ut"), *KEYS, "hourly_ct", "hourly_success_ct")
    )


def batch_counts(txn: DataFrame) -> DataFrame:
    """`hourly_counts` of a finished set of scoped attempts."""
    won = sem.succeeded(F.col("trans_status_desc"))
    return (
        txn.dropDuplicates(["transaction_guid"])
        .groupBy(F.date_trunc("hour", "trans_dt_ut").alias("hour_ut"), *KEYS)
        .agg(
            F.count(F.lit(1)).alias("hourly_ct"),
            F.sum(F.when(won, 1).otherwise(0)).cast("long").alias("hourly_success_ct"),
        )
    )


def hour_of_week(c: Column) -> dict[str, Column]:
    local = sem.in_zone(c, fv.REPORT_ZONE)
    return {"dow": F.dayofweek(local), "trans_hr": F.hour(local)}


def hourly_baseline(counts: DataFrame) -> DataFrame:
    """Mean and deviation per source, BIN, weekday and hour of past hours."""
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    ct = F.col("hourly_ct")
    moments = (
        counts.withColumns(hour_of_week(F.col("hour_ut")))
        .groupBy(*KEYS, "dow", "trans_hr")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(ct).alias("s"),
            F.sum(ct.cast("decimal(19,0)") * ct.cast("decimal(19,0)")).alias("ss"),
        )
    )
    return moments.select(
        *KEYS,
        "dow",
        "trans_hr",
        sem.mean_half_up(s, n).alias("baseline_avg_ct"),
        sem.round_to_long(sem.sample_stddev(n, s, ss)).alias("baseline_stddev_ct"),
    )


def flag_hours(
    counts: DataFrame, baseline: DataFrame, z: float = 3.0, min_baseline: int = 20
) -> DataFrame:
    """Hours that deviate from the baseline; works on batches and streams."""
    keyed = counts.withColumns(hour_of_week(F.col("hour_ut")))
    joined = keyed.join(baseline, [*KEYS, "dow", "trans_hr"]).where(
        F.col("baseline_avg_ct") >= min_baseline
    )
    diff = F.col("hourly_ct") - F.col("baseline_avg_ct")
    std = F.col("baseline_stddev_ct")
    flagged = joined.withColumns(
        {
            "vol_diff": diff,
            "vol_z_score": sem.round_ratio(diff, std, 2),
            "chg_flag": sem.flag_by_score(sem.ratio(diff, std), z),
        }
    )
    return flagged.where(F.col("chg_flag").isNotNull())


def start_hourly_check(
    stream: DataFrame,
    baseline: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    watermark: str = WATERMARK,
    z: float = 3.0,
    min_baseline: int = 20,
    available_now: bool = False,
) -> StreamingQuery:
    """Emit flagged hours once they are closed.

    ``sink`` gets each micro-batch's flagged rows and its id, and should be
    idempotent per id. ``checkpoint`` must lie in shared storage.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(flag_hours(batch, baseline, z, min_baseline), batch_id)

    writer = (
        hourly_counts(stream, watermark)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def arrived(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The files of `folder`, also those yet to come, as a stream with the columns of `like`."""
    return spark.readStream.schema(like.schema).parquet(folder)


def append_arrived(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over what has arrived since the last call and append its rows to parquet.

    State, watermark and the files read so far lie in `checkpoint`: a call after a
    failure, or the next day's, goes on where the last whole batch ended, and the
    sink shows every batch once.
    """
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
