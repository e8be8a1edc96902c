"""Distinct accounts or transactions per key and day, for several outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import semantics as sem

TOTAL, SUCCESS, DECLINE, AVS_FAIL = "total", "success", "decline", "success_avs_fail"
METRICS = (TOTAL, SUCCESS, DECLINE, AVS_FAIL)

# example column stem per outcome
EXAMPLE_STEMS = {SUCCESS: "success_acct", DECLINE: "decline_acct", AVS_FAIL: "success_avs_fail"}


def outcome(metric: str) -> Column:
    """Does an attempt count towards the metric? NULL counts as no."""
    status = F.col("trans_status_desc")
    if metric == TOTAL:
        return F.lit(True)
    if metric == SUCCESS:
        return sem.succeeded(status)
    if metric == DECLINE:
        return sem.declined(status)
    if metric == AVS_FAIL:
        return sem.succeeded(status) & sem.avs_failed(F.col("avs_result_cd"))
    raise ValueError(f"unknown metric {metric!r}")


def example_columns(metrics: Sequence[str]) -> list[str]:
    return [f"{EXAMPLE_STEMS[m]}_ex{i}" for m in metrics for i in (1, 2)]


def activity(
    txn: DataFrame,
    keys: Sequence[str],
    unit: str,
    metrics: Sequence[str] = METRICS,
    segment: Sequence[str] = (),
    examples: Sequence[str] = (),
) -> DataFrame:
    """One row per (keys, trans_dt) with ``<metric>_ct`` distinct-unit counts.

    The rows are first reduced to one per (keys, day, unit) carrying a 0/1 flag
    per metric; summing the flags is then the exact distinct count of every
    metric at once. Both steps combine map-side and the first is keyed by the
    unit, so a hot BIN or source is spread over all tasks.

    With ``segment`` (a subset of ``keys``) each row also gets ``<metric>_tot``,
    the distinct units of the whole segment that day. A unit seen under several
    keys is credited to the first of them only, which avoids a second pass over
    the attempts.
    """
    counted = F.col(unit).isNotNull()
    flags = [
        F.max(F.when(outcome(m) & counted, 1).otherwise(0)).alias(f"_f_{m}") for m in metrics
    ]
    picks = [
        agg(F.when(outcome(m), F.col("account_cd"))).alias(f"{EXAMPLE_STEMS[m]}_ex{i}")
        for m in examples
        for i, agg in ((1, F.min), (2, F.max))
    ]
    per_unit = txn.groupBy(*keys, "trans_dt", unit).agg(*flags, *picks)

    sums = [F.sum(f"_f_{m}").alias(f"{m}_ct") for m in metrics]
    if segment:
        same_unit = Window.partitionBy(*segment, "trans_dt", unit)
        others = [k for k in keys if k not in segment]
        per_unit = per_unit.withColumn(
            "_first", F.row_number().over(same_unit.orderBy(*others)) == 1
        ).withColumns(
            {
                f"_t_{m}": F.when(F.col("_first"), F.max(f"_f_{m}").over(same_unit)).otherwise(0)
                for m in metrics
            }
        )
        sums += [F.sum(f"_t_{m}").alias(f"_t_{m}") for m in metrics]
    picks = [
        (F.min if c.endswith("1") else F.max)(c).alias(c) for c in example_columns(examples)
    ]
    daily = per_unit.groupBy(*keys, "trans_dt").agg(*sums, *picks)
    if segment:
        whole = Window.partitionBy(*segment, "trans_dt")
        daily = daily.withColumns(
            {f"{m}_tot": F.sum(f"_t_{m}").over(whole) for m in metrics}
        ).drop(*[f"_t_{m}" for m in metrics])
    return daily
