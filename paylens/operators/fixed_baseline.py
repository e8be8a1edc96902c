"""Volumes after a fixed baseline period, compared with that period.

Both reports mark each attempt as baseline or monitored and aggregate once; the
baseline then reaches the monitored days through a window over the key, whose
groups hold at most one row per day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import semantics as sem
from paylens.operators import activity as act
from paylens.operators.anomaly import SOURCE
from paylens.sources.transactions import txn_scope

KEYS = (SOURCE, "cc_first_6_nbr")
METRICS = (act.TOTAL, act.SUCCESS)


@dataclass(frozen=True)
class FixedPeriod:
    baseline_start: dt.date
    baseline_end: dt.date
    end: dt.date  # last monitored day

    @property
    def baseline_days(self) -> int:
        return (self.baseline_end - self.baseline_start).days + 1


def _scoped(txn: DataFrame, period: FixedPeriod, bins: Sequence[str]) -> DataFrame:
    scoped = txn_scope(txn, period.baseline_start, period.end, method=None, bins=bins)
    return scoped.where(F.col("cc_first_6_nbr").isNotNull())


def _over_key(value: Column, agg) -> Column:
    return agg(F.when(F.col("is_baseline"), value)).over(Window.partitionBy(*KEYS))


def percent_change_report(
    txn: DataFrame, period: FixedPeriod, bins: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Daily transactions against the period's distinct total per calendar day."""
    before = F.col("trans_dt") <= F.lit(period.baseline_end)
    # the whole baseline is one bucket, so a transaction counts once in it
    bucketed = _scoped(txn, period, bins).withColumn(
        "trans_dt", F.when(~before, F.col("trans_dt"))
    )
    volumes = act.activity(bucketed, KEYS, "transaction_guid", METRICS).withColumn(
        "is_baseline", F.col("trans_dt").isNull()
    )
    days = F.lit(period.baseline_days).cast("long")
    volumes = volumes.withColumns(
        {f"{m}_base": _over_key(F.col(f"{m}_ct"), F.max) for m in METRICS}
    ).where(~F.col("is_baseline") & F.col("total_base").isNotNull())
    volumes = volumes.withColumns(
        {f"{m}_avg": sem.mean_half_up(F.col(f"{m}_base"), days) for m in METRICS}
    )

    exprs = [F.col(c) for c in (*KEYS, "trans_dt")]
    for m, p, pct in ((act.TOTAL, "", "pct_change"), (act.SUCCESS, "success_", "success_pct_chg")):
        diff = F.col(f"{m}_ct") - F.col(f"{m}_avg")
        exprs += [
            F.col(f"{m}_avg").alias(f"baseline_{p}avg_ct"),
            F.col(f"{m}_ct").alias(f"daily_{p}ct"),
            diff.alias(f"{p or 'vol_'}diff"),
            sem.round_ratio(diff * 100, F.col(f"{m}_avg"), 2).alias(pct),
            sem.flag_by_score(sem.ratio(diff, F.col(f"{m}_avg")), threshold).alias(f"{p}chg_flag"),
        ]
    exprs.append(F.col("total_base").alias("baseline_tot_ct"))
    out = volumes.select(*exprs)
    return out.where(F.col("chg_flag").isNotNull() | F.col("success_chg_flag").isNotNull())


def fixed_zscore_report(
    txn: DataFrame,
    period: FixedPeriod,
    bins: Sequence[str] = (),
    z: float = 2.0,
    excluded: Sequence[dt.date] = (),
) -> DataFrame:
    """Daily transactions against the period's mean and unrounded deviation."""
    scoped = _scoped(txn, period, bins)
    before = F.col("trans_dt") <= F.lit(period.baseline_end)
    if excluded:
        scoped = scoped.where(~before | ~F.col("trans_dt").isin(*excluded))
    volumes = act.activity(scoped, KEYS, "transaction_guid", METRICS).withColumn(
        "is_baseline", before
    )
    moments = {}
    for m in METRICS:
        ct = F.col(f"{m}_ct")
        moments[f"{m}_n"] = _over_key(ct, F.count)
        moments[f"{m}_s"] = _over_key(ct, F.sum)
        moments[f"{m}_ss"] = _over_key(ct.cast("decimal(19,0)") * ct.cast("decimal(19,0)"), F.sum)
    volumes = volumes.withColumns(moments).where(~F.col("is_baseline") & (F.col("total_n") > 0))
    stats = {}
    for m in METRICS:
        n, s, ss = (F.col(f"{m}_{x}") for x in ("n", "s", "ss"))
        stats[f"{m}_avg"] = sem.mean_half_up(s, n)
        stats[f"{m}_std"] = sem.sample_stddev(n, s, ss)
    volumes = volumes.withColumns(stats)

    exprs = [F.col(c) for c in (*KEYS, "trans_dt")]
    for m, p in ((act.TOTAL, ""), (act.SUCCESS, "success_")):
        diff = F.col(f"{m}_ct") - F.col(f"{m}_avg")
        score = F.try_divide(diff.cast("double"), F.col(f"{m}_std"))
        exprs += [
            F.col(f"{m}_avg").alias(f"baseline_{p}avg_ct"),
            F.col(f"{m}_std").alias(f"baseline_{p}stddev_ct"),
            F.col(f"{m}_ct").alias(f"daily_{p}ct"),
            diff.alias(f"{p or 'vol_'}diff"),
            F.round(score, 2).alias(f"{p or 'vol_'}z_score"),
            sem.flag_by_score(score, z).alias(f"{p}chg_flag"),
        ]
    out = volumes.select(*exprs)
    return out.where(F.col("chg_flag").isNotNull() | F.col("success_chg_flag").isNotNull())
