"""Assigning an attempt to the activation window it falls into.

The window of a subscription runs from the account's prior expiration to just
after the activation; an attempt belongs to the earliest activation whose
window contains it. A join on the account alone would look at every
(attempt, subscription) pair of an account, which a hot account cannot afford.

Here attempts and subscriptions are dealt by account and merged by time inside
(account, month) groups, so one pass finds the next activation for every attempt:

* the window's end grows with the activation, hence the next activation is the
  answer whenever its window has already begun;
* if no later window has begun either (a running minimum tells), there is none;
* only attempts in between, which exist where subscriptions of one account
  overlap, still search the account's windows of their own month.

A subscription that is not yet active has an open window and comes before all
others. It is no event in any month: one running minimum per account that has
such subscriptions finds the first of those that had begun.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import semantics as sem
from paylens.operators.intervals import interval_join
from paylens.operators.subscriptions import ACCOUNT

WINDOW_COLUMNS = (
    "subscription_guid", "activate_dt_ut", "prior_expiration", "trial_end_dt_ut",
    "pre_activate", "post_activate",
)
PREFIX = "sub_win_"


def _month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def _clipped(c: Column, first: int, last: int) -> Column:
    return F.least(F.greatest(_month(c), F.lit(first)), F.lit(last))


def _windows(history: DataFrame) -> DataFrame:
    """One struct per subscription; fields order by activation, then id."""
    fields = [
        F.col("activate_dt_ut"),
        *[F.col(c) for c in WINDOW_COLUMNS if c != "activate_dt_ut"],
    ]
    return history.select(
        *ACCOUNT,
        F.coalesce("prior_expiration", sem.ts(sem.NO_PRIOR)).alias("opens"),
        F.coalesce("post_activate", sem.ts(sem.OPEN_ENDED)).alias("closes"),
        F.struct(*fields).alias("win"),
    )


def _events(windows: DataFrame, floor_month: int, last_month: int) -> DataFrame:
    """Window ends, repeated into every month in which they come next."""
    later = Window.partitionBy(*ACCOUNT).orderBy(F.desc("closes"), F.desc("win"))
    month = _clipped(F.col("closes"), floor_month, last_month)
    previous = F.lead(month).over(later)
    marked = windows.withColumns(
        {
            "earliest_open": F.min("opens").over(later),
            "own": month,
            "from_month": F.coalesce(previous, F.lit(floor_month)),
        }
    )
    spread = marked.withColumn("month", F.explode(F.sequence("from_month", "own")))
    return spread.select(
        *ACCOUNT,
        "month",
        # in an earlier month the window end lies after everything else
        F.when(F.col("month") == F.col("own"), F.col("closes"))
        .otherwise(sem.ts(sem.OPEN_ENDED))
        .alias("at"),
        F.lit(1).alias("is_window"),
        F.struct("opens", "earliest_open", "win").alias("next"),
    )


def _pending(named: Column) -> Column:
    """The first subscription not yet active that had begun at an attempt."""
    # a window that begins at the attempt's instant has begun
    late = F.when(F.col("waiting").isNull(), 1).otherwise(0)
    so_far = Window.partitionBy(*ACCOUNT).orderBy("at", late)
    return F.when(named, F.min("waiting").over(so_far))


def in_activation_window(
    attempts: DataFrame,
    history: DataFrame,
    floor: dt.date = dt.date(2015, 1, 1),
    ceiling: dt.date = dt.date(2050, 1, 1),
    dealt: bool = False,
) -> DataFrame:
    """Left-join each attempt to its activation window (`sub_win_*` columns).

    The histories are dealt by account here, unless they are ``dealt`` so
    already. Everything before ``floor`` shares one month group, everything after
    ``ceiling`` another, which bounds the months a window is repeated into.
    """
    floor_month, last_month = (d.year * 12 + d.month for d in (floor, ceiling))
    every = _windows(history if dealt else history.repartition(*ACCOUNT))
    active = F.col("win.activate_dt_ut").isNotNull()
    windows = every.where(active)
    when = F.col("trans_dt_ut")
    # all three parts are dealt by account before window ends are repeated
    merged = attempts.repartition(*ACCOUNT).withColumns(
        {
            "month": _clipped(when, floor_month, last_month),
            "at": when,
            "is_window": F.lit(0),
        }
    ).unionByName(_events(windows, floor_month, last_month), allowMissingColumns=True)
    begins = every.where(~active).select(
        *ACCOUNT, F.col("opens").alias("at"), F.lit(1).alias("is_window"), F.col("win").alias("waiting")
    )
    merged = merged.unionByName(begins, allowMissingColumns=True)
    # newest first; a window ending at the attempt's instant contains it
    backwards = (
        Window.partitionBy(*ACCOUNT, "month")
        .orderBy(F.desc("at"), F.desc("is_window"), F.desc("next.win"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    named = [*ACCOUNT, "transaction_guid", "trans_dt_ut"]
    complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in named))
    found = (
        merged.withColumns(
            {
                "next": F.last("next", ignorenulls=True).over(backwards),
                "pending": _pending(complete),
            }
        )
        .where(F.col("is_window") == 0)
        .drop("month", "at", "is_window", "waiting")
    )
    begun = F.col("next.opens") <= when
    search = F.col("next").isNotNull() & ~begun & (F.col("next.earliest_open") <= when)
    search = F.coalesce(search, F.lit(False))

    # the rows of one attempt are counted, so that equal ones stay apart
    copy = F.row_number().over(Window.partitionBy(*named).orderBy(F.lit(1)))
    found = found.withColumns({"_search": search & complete, "_copy": copy})
    overlapping = windows.select(*ACCOUNT, "opens", "closes", F.col("win").alias("hit"))
    searched = interval_join(
        found, overlapping, when, "opens", "closes", floor, ceiling, when=F.col("p._search")
    )
    hits = searched.groupBy(*found.columns).agg(F.min("hit").alias("hit"))
    own = F.when(search, F.col("hit")).when(begun, F.col("next.win"))
    both = hits.withColumn("win", F.coalesce("pending", own))
    return both.select(
        *[c for c in attempts.columns],
        *[F.col(f"win.{c}").alias(f"{PREFIX}{c}") for c in WINDOW_COLUMNS],
    )
