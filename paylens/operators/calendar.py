"""Run dates and the baseline days each of them looks back on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def add_months(d: dt.date, months: int) -> dt.date:
    """Calendar month step, clamped to the month end like the SQL function."""
    index = d.year * 12 + d.month - 1 + months
    year, month = divmod(index, 12)
    next_first = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (next_first - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(d.day, last))


@dataclass(frozen=True)
class RunWindow:
    """Inclusive range of run dates."""

    start: dt.date
    end: dt.date

    @classmethod
    def days_ending(cls, end: dt.date, days: int) -> RunWindow:
        return cls(end - dt.timedelta(days=days - 1), end)

    @classmethod
    def months_ending(cls, end: dt.date, months: int) -> RunWindow:
        return cls(add_months(end, -months), end)

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


def run_dates(spark: SparkSession, window: RunWindow) -> DataFrame:
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(window.start), F.lit(window.end))).alias("run_dt")
    )


def lookback_start(run_dt: Column, months: int | None, days: int | None) -> Column:
    return F.date_sub(run_dt, days) if days else F.add_months(run_dt, -(months or 0))


def baseline_dates(
    spark: SparkSession,
    window: RunWindow,
    months: int | None = 3,
    days: int | None = None,
    same_weekday: bool = False,
    excluded: Sequence[dt.date] = (),
) -> DataFrame:
    """(run_dt, baseline_dt): the days of the lookback, run date left out."""
    run = F.col("run_dt")
    out = run_dates(spark, window).select(
        "run_dt",
        F.explode(
            F.sequence(lookback_start(run, months, days), F.date_sub(run, 1))
        ).alias("baseline_dt"),
    )
    if same_weekday:
        out = out.where(F.dayofweek("baseline_dt") == F.dayofweek("run_dt"))
    if excluded:
        out = out.where(~F.col("baseline_dt").isin(*excluded))
    return out
