"""The stream, drained once, equals the batch result."""

import datetime as dt
import random

from pyspark.sql import functions as F

from paylens.streaming import hourly as hr

T0 = dt.datetime(2024, 1, 1)
SCHEMA = (
    "src_system_id long, account_cd string, transaction_guid string, trans_dt date, trans_dt_ut timestamp, "
    "cc_first_6_nbr string, trans_status_desc string, origin_desc string, trans_type_desc string, "
    "payment_method_desc string"
)


def rows(n=4000, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 21))
        row = (115, f"a{rng.randrange(50)}", f"T{i}", at.date(), at, rng.choice(["400000", "400000", "400001"]),
               rng.choice(["success", "declined"]), "api", "purchase", "Credit Card")
        out += [row] * rng.choice([1, 1, 2])
    return sorted(out, key=lambda r: r[4])


def batch_counts(df):
    won = F.col("trans_status_desc") == "success"
    return (
        df.dropDuplicates(["transaction_guid"])
        .groupBy(F.date_trunc("hour", "trans_dt_ut").alias("hour_ut"), *hr.KEYS)
        .agg(
            F.count(F.lit(1)).alias("hourly_ct"),
            F.sum(F.when(won, 1).otherwise(0)).cast("long").alias("hourly_success_ct"),
        )
    )


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    src = str(tmp_path / "in")
    df.coalesce(1).sortWithinPartitions("trans_dt_ut").write.parquet(src)
    cut = F.lit("2024-01-15").cast("timestamp")
    counts = batch_counts(df)
    baseline = hr.hourly_baseline(counts.where(F.col("hour_ut") < cut)).cache()
    # the watermark leaves the last hours open; a far-off row closes them
    closing = spark.createDataFrame(
        [(115, "a", "END", dt.date(2024, 3, 1), dt.datetime(2024, 3, 1), "400009", "success", "api", "purchase", "Credit Card")],
        SCHEMA,
    )
    closing.write.mode("append").parquet(src)
    seen = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = hr.start_hourly_check(
        stream, baseline, lambda b, i: seen.extend(b.collect()), str(tmp_path / "cp"),
        z=1.0, min_baseline=1, available_now=True,
    )
    query.awaitTermination()
    want = hr.flag_hours(counts, baseline, 1.0, 1).collect()
    cols = ["hour_ut", *hr.KEYS, "hourly_ct", "hourly_success_ct", "vol_z_score", "chg_flag"]

    def plain(rs):
        return sorted(tuple(str(r[c]) for c in cols) for r in rs)

    assert want and plain(seen) == plain(want)
