"""Sums over each run date's lookback as differences of running sums.

A key's daily rows are put in order of time. Every run date adds two readings to
that order: one where its lookback begins, one where it ends. The running sums
there differ by what lies between, so that each daily row is added up once,
however many run dates look back on it. With `same_weekday` each weekday has an
order of its own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylens.operators.calendar import RunWindow, lookback_start, run_dates

# place within a day: the end of a lookback is read before the day's row, its beginning after
END, ROW, BEGIN = 0, 1, 2


@dataclass(frozen=True)
class Lookback:
    """The days before a run date that make its baseline."""

    months: int | None = 3
    days: int | None = None
    same_weekday: bool = False
    excluded: tuple[dt.date, ...] = ()

    def start(self, run_dt: Column) -> Column:
        return lookback_start(run_dt, self.months, self.days)

    def covers(self, run_dt: Column, day: Column) -> Column:
        inside = (day >= self.start(run_dt)) & (day < run_dt)
        if self.same_weekday:
            inside &= F.dayofweek(day) == F.dayofweek(run_dt)
        if self.excluded:
            inside &= ~day.isin(*self.excluded)
        return inside

    def spans(self, spark: SparkSession, window: RunWindow) -> DataFrame:
        """(run_dt, span): how many calendar days each run date looks back on."""
        run = F.col("run_dt")
        days = F.sequence(self.start(run), F.date_sub(run, 1))
        return run_dates(spark, window).select(
            "run_dt", F.size(F.filter(days, lambda d: self.covers(run, d))).alias("span")
        )


def _mark(day: Column, at: int, run_dt: Column) -> Column:
    return F.struct(day.alias("day"), F.lit(at).alias("at"), run_dt.alias("run_dt"))


def between_readings(
    daily: DataFrame,
    keys: Sequence[str],
    summed: Mapping[str, Column],
    current: Mapping[str, Column],
    window: RunWindow,
    lookback: Lookback,
    dense: bool = False,
) -> DataFrame:
    """Per (keys, run date): `summed` over the lookback and `current` of the day itself.

    `daily` has one row per (keys, trans_dt) and is best partitioned by the keys,
    which holds to the end; `summed` are never NULL. Without `dense` only run dates
    with a row of their own and a row in the lookback are given; with it all that
    have either, and what is missing is zero in the sums and NULL in the rest.
    """
    day = F.col("trans_dt")
    inside = day.between(F.lit(window.start), F.lit(window.end))
    own = _mark(day, ROW, F.when(inside, day))
    if dense:
        # the key's first row brings the readings of all run dates from then on
        first = F.min("trans_dt").over(Window.partitionBy(*keys))
        begin = F.greatest(F.lit(window.start), first)
        runs = F.when(begin <= F.lit(window.end), F.sequence(begin, F.lit(window.end)))
        ends = F.transform(runs, lambda r: _mark(r, END, r))
        begins = F.transform(runs, lambda r: _mark(F.date_sub(lookback.start(r), 1), BEGIN, r))
        daily = daily.withColumn("readings", F.when(day == first, F.concat(ends, begins)))
        marks = F.concat(F.array(own), F.coalesce(F.col("readings"), F.array().cast(_MARKS)))
    else:
        begins = _mark(F.date_sub(lookback.start(day), 1), BEGIN, day)
        marks = F.when(inside, F.array(own, begins)).otherwise(F.array(own))
    points = daily.select(
        *keys,
        F.explode(marks).alias("mark"),
        *[v.alias(n) for n, v in summed.items()],
        *[v.alias(n) for n, v in current.items()],
    ).select(*keys, "mark.*", *summed, *current)
    is_row = F.col("at") == ROW
    points = points.withColumns({n: F.when(is_row, F.col(n)).otherwise(0) for n in summed})
    along = list(keys)
    if lookback.same_weekday:
        points = points.withColumn("weekday", F.dayofweek(F.coalesce("run_dt", "day")))
        along.append("weekday")
    order = Window.partitionBy(*along).orderBy("day", "at").rowsBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({f"{n}_run": F.sum(n).over(order) for n in summed})
    points = points.where(F.col("run_dt").isNotNull())

    def reading(name: str) -> Column:
        run = F.col(f"{name}_run")
        end = F.when(F.col("at") == END, run) if dense else F.when(is_row, run - F.col(name))
        return F.max(end) - F.max(F.when(F.col("at") == BEGIN, run))

    out = points.groupBy(*keys, "run_dt").agg(
        *[reading(n).alias(n) for n in summed],
        F.max(is_row.cast("int")).alias("has_current"),
        *[F.max(F.when(is_row, F.col(n))).alias(n) for n in current],
    )
    seen = F.col(next(iter(summed))) > 0
    return out.where(seen | (F.col("has_current") == 1) if dense else seen)


_MARKS = "array<struct<day:date,at:int,run_dt:date>>"
