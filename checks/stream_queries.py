"""The hourly check as a stream over event files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import oracle_anomaly as orc
from checks.feed_queries import _EV, _history
from checks.lifecycle_queries import plain
from checks.oracle_anomaly import half_up, round_ratio
from checks.registry import register
from paylens.reuse import job_folder
from paylens.sources.transactions import txn_scope
from paylens.streaming import hourly as hr

#: The stream begins here; what is older makes the baseline.
START = datetime(2024, 1, 25)
#: The first delivery ends here.
CUT = datetime(2024, 1, 28, 12)
#: Rows of this source and these hours come after the watermark has passed them.
LOST_SOURCE, LOST_FROM, LOST_TO = 139, CUT - timedelta(hours=5), CUT - timedelta(hours=4)


def _deliveries(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sets of files: the second repeats half an hour of the first, brings its last ten
    minutes, which are late but within the watermark, and some rows that are too late."""
    at = F.col("trans_dt_ut")
    lost = (F.col("src_system_id") == LOST_SOURCE) & (at >= F.lit(LOST_FROM)) & (at < F.lit(LOST_TO))
    first = live.where((at < F.lit(CUT - timedelta(minutes=10))) & ~lost)
    second = live.where((at >= F.lit(CUT - timedelta(minutes=40))) | lost)
    return first, second


def _streamed(spark, sf_dir, transform):
    """`transform` of the stream, appended to parquet in two runs from one checkpoint."""
    history = _history(spark, sf_dir)
    folder = job_folder(spark, "hourly")
    source, out, state = f"{folder}/events", f"{folder}/rows", f"{folder}/state"
    for delivery in _deliveries(history.where(F.col("trans_dt_ut") >= F.lit(START))):
        delivery.write.mode("append").parquet(source)
        rows = transform(hr.arrived(spark, source, history), history)
        hr.append_arrived(rows, out, state)
    return plain(spark.read.schema(rows.schema).parquet(out))


def _counts(stream, _):
    return hr.hourly_counts(stream)


def _flags(stream, history):
    past = txn_scope(history.where(F.col("trans_dt_ut") < F.lit(START)))
    baseline = hr.hourly_baseline(hr.batch_counts(past))
    return hr.flag_hours(hr.hourly_counts(stream), baseline, 1.0, 1)


_KEY = "date_trunc('hour', trans_dt_ut) AS hour_ut, src_system_id, cc_first_6_nbr"
_COUNT = """count(DISTINCT transaction_guid) AS hourly_ct
     , count(DISTINCT transaction_guid) FILTER (WHERE trans_status_desc IN ('success', 'void')) AS hourly_success_ct"""
#: What had come in time, in hours that the last watermark has closed.
_CLOSED = f"""{_EV}
, intime AS (
    SELECT * FROM txn WHERE trans_dt_ut >= TIMESTAMP '{START}'
      AND NOT (src_system_id = {LOST_SOURCE} AND trans_dt_ut >= TIMESTAMP '{LOST_FROM}' AND trans_dt_ut < TIMESTAMP '{LOST_TO}'))
, hours AS (SELECT {_KEY}, {_COUNT} FROM intime GROUP BY ALL)
, closed AS (
    SELECT * FROM hours WHERE hour_ut + INTERVAL 1 HOUR <= (SELECT max(trans_dt_ut) FROM intime) - INTERVAL 15 MINUTE)"""
_TEXT = "REPLACE (strftime(hour_ut, '%Y-%m-%d %H:%M:%S') AS hour_ut)"
register(
    "stream_hourly_counts",
    lambda s, d: _streamed(s, d, _counts),
    f"{_CLOSED} SELECT * {_TEXT} FROM closed",
)

_LOCAL = "timezone('America/Los_Angeles', timezone('UTC', hour_ut))"
_WEEKHOUR = f"CAST(dayofweek({_LOCAL}) + 1 AS INTEGER) AS dow, CAST(extract(hour FROM {_LOCAL}) AS INTEGER) AS trans_hr"
_RATIO = "CAST(vol_diff AS DOUBLE) / nullif(baseline_stddev_ct, 0)"
register(
    "stream_hourly_flags",
    lambda s, d: _streamed(s, d, _flags),
    f"""{_CLOSED}
, past AS (SELECT {_KEY}, {_COUNT} FROM txn WHERE trans_dt_ut < TIMESTAMP '{START}' GROUP BY ALL)
, usual AS (
    SELECT src_system_id, cc_first_6_nbr, {_WEEKHOUR}, count(*) AS n, sum(hourly_ct) AS s, sum(hourly_ct * hourly_ct) AS ss FROM past GROUP BY ALL)
, baseline AS (
    SELECT src_system_id, cc_first_6_nbr, dow, trans_hr, {half_up("s", "n")} AS baseline_avg_ct
         , {orc.to_long(orc.stddev("n", "s", "ss"))} AS baseline_stddev_ct FROM usual)
, compared AS (
    SELECT c.*, baseline_avg_ct, baseline_stddev_ct, hourly_ct - baseline_avg_ct AS vol_diff
    FROM (SELECT *, {_WEEKHOUR} FROM closed) c JOIN baseline USING (src_system_id, cc_first_6_nbr, dow, trans_hr)
    WHERE baseline_avg_ct >= 1)
SELECT * {_TEXT}, {round_ratio("vol_diff", "baseline_stddev_ct", 2)} AS vol_z_score
     , CASE WHEN {_RATIO} >= 1 THEN 'large_increase' ELSE 'large_decrease' END AS chg_flag
FROM compared WHERE abs({_RATIO}) >= 1""",
)
