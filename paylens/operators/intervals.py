"""Joining points in time to intervals of the same account."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.operators.subscriptions import ACCOUNT


def _month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    at: Column,
    start: str,
    end: str,
    floor: dt.date,
    ceiling: dt.date,
    when: Column | None = None,
    how: str = "left",
    keys=ACCOUNT,
) -> DataFrame:
    """Match ``at`` (of `points`) with ``start <= at <= end``, both inclusive.

    Intervals are spread over the months they cover, so the join key is
    (keys, month): a hot account is split over its months and a point only
    meets the intervals of its own month. Times outside [floor, ceiling] share
    the outermost months, which bounds the spread. ``when`` adds a condition on
    the pair; interval columns must not repeat point columns, save the keys.
    """
    lo, hi = (d.year * 12 + d.month for d in (floor, ceiling))

    def clip(c: Column) -> Column:
        return F.least(F.greatest(_month(c), F.lit(lo)), F.lit(hi))

    first, last = clip(F.col(start)), clip(F.col(end))
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn(
        "_month", F.explode(F.sequence(first, last))
    )
    left = points.withColumns({"_at": at, "_month": clip(at)})
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in (*keys, "_month")]
    on.append(F.col("p._at").between(F.col(f"i.{start}"), F.col(f"i.{end}")))
    if when is not None:
        on.append(when)
    joined = left.alias("p").join(spread.alias("i"), on, how)
    return joined.select(
        *[F.col(f"p.{c}") for c in points.columns],
        *[F.col(f"i.{c}") for c in intervals.columns if c not in keys],
    )
