"""One filter contract for every report.

`Filters` holds the dashboard's dimensions. `apply_filters` turns them into
predicates over one table, `filtered_tables` into predicates over the raw tables
of a report, each table by the columns it has: attempts carry all dimensions but
the plan, which they take from their subscription; subscriptions and invoice
lines carry the source and the plan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions import semantics as sem
from paylens.operators.subscriptions import SUBSCRIPTION, plan_parts


@dataclass(frozen=True)
class Filters:
    """Dashboard dimensions; an empty one does not restrict. Ranges inclusive."""

    date_start: dt.date | None = None
    date_end: dt.date | None = None
    src_system_id: tuple[int, ...] = ()
    country_cd: tuple[str, ...] = ()
    gateway_cd: tuple[str, ...] = ()
    gateway_region: tuple[str, ...] = ()
    payment_method_desc: tuple[str, ...] = ()
    card_brand_nm: tuple[str, ...] = ()
    plan_cd: tuple[str, ...] = ()
    plan_tier: tuple[str, ...] = ()
    trans_type_desc: tuple[str, ...] = ()
    trans_status_desc: tuple[str, ...] = ()
    failure_type: tuple[str, ...] = ()
    origin_desc: tuple[str, ...] = ()
    dow: tuple[int, ...] = ()  # 1 = Sunday
    hour: tuple[int, ...] = ()

    def predicates(self, date_col: str = "trans_dt", ts_col: str = "trans_dt_ut") -> list[Column]:
        derived = {
            "gateway_region": lambda: sem.market(F.col("gateway_cd")),
            "plan_tier": lambda: plan_parts(F.col("plan_cd"), F.col("plan_cd"))["plan_dur"],
            "dow": lambda: F.dayofweek(date_col),
            "hour": lambda: F.hour(ts_col),
        }
        out = []
        if self.date_start:
            out.append(F.col(date_col) >= F.lit(self.date_start))
        if self.date_end:
            out.append(F.col(date_col) <= F.lit(self.date_end))
        for f in fields(self):
            values = getattr(self, f.name)
            if f.name.startswith("date_") or not values:
                continue
            column = derived[f.name]() if f.name in derived else F.col(f.name)
            out.append(column.isin(*values))
        return out


def apply_filters(df: DataFrame, filters: Filters, **columns: str) -> DataFrame:
    """Each dimension is a predicate of its own, so raw ones reach the scan."""
    for predicate in filters.predicates(**columns):
        df = df.where(predicate)
    return df


PLAN = ("plan_cd", "plan_tier")


def _only(filters: Filters, names: tuple[str, ...]) -> Filters:
    empty = Filters()
    return replace(filters, **{f.name: getattr(empty, f.name) for f in fields(filters) if f.name not in names})


def _without(filters: Filters, names: tuple[str, ...]) -> Filters:
    return _only(filters, tuple(f.name for f in fields(filters) if f.name not in names))


def of_plans(df: DataFrame, subs: DataFrame, filters: Filters) -> DataFrame:
    """Rows whose subscription has a plan that the filters let through."""
    plans = _only(filters, PLAN)
    if plans == Filters():
        return df
    kept = apply_filters(subs, plans).select(*SUBSCRIPTION).distinct()
    return df.join(kept, list(SUBSCRIPTION), "left_semi")


def filtered_attempts(txn: DataFrame, filters: Filters, subs: DataFrame | None = None) -> DataFrame:
    """Attempts under all dimensions; the plan needs `subs`."""
    if subs is None and _only(filters, PLAN) != Filters():
        raise ValueError("plan filters on attempts need the subscriptions")
    kept = apply_filters(txn, _without(filters, PLAN))
    return kept if subs is None else of_plans(kept, subs, filters)


def filtered_tables(tables, filters: Filters):
    """Raw tables of a report (`gateway_reports.Tables`) under the filters.

    Dates restrict attempts only: the history that classifies an attempt reaches
    back behind them.
    """
    source = _only(filters, ("src_system_id",))
    subs = apply_filters(tables.subs, source)
    lines = apply_filters(tables.lines, source)
    return replace(
        tables,
        txn=filtered_attempts(tables.txn, filters, subs),
        subs=apply_filters(subs, _only(filters, PLAN)),
        lines=of_plans(lines, subs, filters),
    )


def filtered_history(history: DataFrame, filters: Filters) -> DataFrame:
    """Subscriptions with their history under source, plan and range of activation days.

    The history is read over the whole account before, so that sequence numbers
    and neighbours stay what they are without filters.
    """
    kept = apply_filters(history, _only(filters, ("src_system_id", *PLAN)))
    return apply_filters(
        kept.withColumn("_day", F.to_date("activate_dt_ut")),
        _only(filters, ("date_start", "date_end")),
        date_col="_day",
    ).drop("_day")


def filtered_disputes(disputes: DataFrame, filters: Filters) -> DataFrame:
    """Disputes under the range of purchase days."""
    return apply_filters(disputes, _only(filters, ("date_start", "date_end")), date_col="txn_date")


def by_dimension(txn: DataFrame, chosen: Mapping[str, tuple], subs: DataFrame | None = None) -> DataFrame:
    """Attempts and amount per day under some dimensions."""
    kept = filtered_attempts(txn, Filters(**chosen), subs)
    return kept.groupBy("trans_dt").agg(F.count(F.lit(1)).alias("txn_ct"), F.sum("trans_amt").alias("trans_amt"))
