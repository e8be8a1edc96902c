"""Gateway reports from the raw tables.

Each report reads attempts once; the subscription history and the invoice
roll-up, which several joins need, are computed once and kept as narrow tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.operators import classify as cl
from paylens.operators import gateway as gw
from paylens.operators import invoices as inv
from paylens.operators import orders as od
from paylens.operators import subscriptions as sub
from paylens.operators.calendar import add_months
from paylens.reuse import computed_once

# what the joins of the reports read from a subscription's history
HISTORY_COLUMNS = (
    "src_system_id", "account_cd", "subscription_guid", "plan_cd", "plan_nm", "plan_dur",
    "creation_dt_ut", "activate_dt_ut", "activate_dt_et", "trial_start_dt_ut", "trial_end_dt_ut",
    "expiration_dt_ut", "pre_activate", "post_activate", "pre_trial_end", "post_trial_end",
    "prior_activation", "prior_expiration", "next_activation", "original_activation",
    "overall_sub_start_type_desc",
)


@dataclass(frozen=True)
class Tables:
    """Raw inputs."""

    txn: DataFrame
    lines: DataFrame
    subs: DataFrame
    start_types: DataFrame | None = None
    requests: DataFrame | None = None
    response_texts: DataFrame | None = None


def _stored_history(tables: Tables, as_of: dt.date, sources: Sequence[int] = ()) -> DataFrame:
    """The histories as a table, without the columns that follow from others."""
    out = sub.sub_history(tables.subs, as_of, sources=sources)
    kept = [c for c in HISTORY_COLUMNS if c in out.columns and c not in sub.derived_times()]
    out = out.select(*kept)
    if tables.start_types is not None:
        out = cl.with_start_type_dealt(out, tables.subs, tables.start_types)
    return computed_once(out, dealt=True)


def _with_times(stored: DataFrame) -> DataFrame:
    out = stored.withColumns(sub.derived_times())
    return out.select(*[c for c in HISTORY_COLUMNS if c in out.columns])


def history(tables: Tables, as_of: dt.date, sources: Sequence[int] = ()) -> DataFrame:
    return _with_times(_stored_history(tables, as_of, sources))


def dealt_history(tables: Tables, as_of: dt.date) -> DataFrame:
    """The histories dealt by account; times that follow from others are computed after that."""
    return _with_times(_stored_history(tables, as_of).repartition(*sub.ACCOUNT))


def invoices(tables: Tables, since: dt.date) -> DataFrame:
    """Invoices from a month before the first attempt on."""
    return computed_once(inv.invoice_rollup(tables.lines, add_months(since, -1)))


def category_history(tables: Tables, as_of: dt.date) -> DataFrame:
    """What the categories read from the histories, with the rows of `history`."""
    out = sub.sub_history(tables.subs, as_of).select(*gw.HISTORY_COLUMNS)
    if tables.start_types is not None:
        # a subscription of several start types has a row for each
        out = cl.with_start_type_dealt(out, tables.subs, tables.start_types)
    return computed_once(out.select(*gw.HISTORY_COLUMNS), dealt=True)


def comparison(tables: Tables, since: dt.date, as_of: dt.date) -> DataFrame:
    return gw.gateway_comparison(tables.txn, tables.lines, category_history(tables, as_of), since)


def grains(tables: Tables, since: dt.date, as_of: dt.date, top: int = 100) -> DataFrame:
    return gw.gateway_grains(tables.txn, tables.lines, category_history(tables, as_of), since, top)


def by_bin(tables: Tables, since: dt.date, as_of: dt.date, top: int = 100) -> DataFrame:
    return gw.gateway_by_bin(tables.txn, tables.lines, category_history(tables, as_of), since, top)


def _read_columns(attempts: DataFrame, read: Sequence[str]) -> DataFrame:
    """The columns `read`, and one hash of all others.

    The classes drop equal rows. Rows that differ only where nobody reads stay
    apart by the hash, which also tells a missing value from a shifted one.
    """
    others = [c for c in attempts.columns if c not in read]
    marks = [x for c in others for x in (F.col(c), F.col(c).isNull())]
    return attempts.select(
        *[c for c in attempts.columns if c in read], F.xxhash64(*marks).alias("_others")
    )


def _classes(
    tables: Tables, since: dt.date, as_of: dt.date, columns: Sequence[str] | None
) -> DataFrame:
    """The classes before they are stored, dealt by account."""
    hist = dealt_history(tables, as_of)
    inv_table = invoices(tables, since).repartition(*sub.ACCOUNT)
    attempts = inv.clean_attempts(tables.txn, since)
    if columns is not None:
        attempts = _read_columns(attempts, [*cl.ATTEMPT_COLUMNS, *columns])
    assigned = cl.assign_invoices(
        attempts.repartition(*sub.ACCOUNT), inv_table, hist, since, as_of
    )
    classes = cl.classify(cl.with_invoice_state(assigned, inv_table), hist, since, as_of)
    return classes.select(*(columns or classes.columns))


def detailed_classes(
    tables: Tables, since: dt.date, as_of: dt.date, columns: Sequence[str] | None = None
) -> DataFrame:
    """Every attempt with its assigned invoice and detailed class.

    ``columns`` limits the result to what the caller reads, without changing
    its rows. Every join and window is inside an account, so that attempts,
    subscriptions and invoices are dealt by account and moved no more.
    """
    return computed_once(_classes(tables, since, as_of, columns), dealt=True)


def detailed_attempts(
    tables: Tables,
    since: dt.date,
    as_of: dt.date,
    columns: Sequence[str] | None = None,
    next_rows: bool = True,
) -> DataFrame:
    """`detailed_classes` with their details, found in the same partitions and stored with them."""
    classes = _classes(tables, since, as_of, columns)
    return computed_once(cl.with_details(classes, next_rows, dealt=True), dealt=True)


def latest_attempts(tables: Tables, since: dt.date) -> DataFrame:
    """Attempts that reached a gateway, ranked from the newest."""
    return od.with_latest(od.reached_gateway(inv.clean_attempts(tables.txn, since)))


def orders(
    tables: Tables,
    since: dt.date,
    as_of: dt.date,
    subs_since: dt.date,
    orders_since: dt.date,
    requests_since: dt.date,
    merchants: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Order rows of the attempts that reached a gateway.

    ``columns`` limits the result to what the caller reads, without changing
    its rows. Attempts are dealt by account, and again by reference for the
    decline texts; nothing else moves them.
    """
    hist = dealt_history(tables, as_of)
    inv_table = inv.invoice_rollup(tables.lines, add_months(since, -1))
    declines = od.decline_texts(
        tables.requests, tables.response_texts, requests_since, merchants
    )
    attempts = od.reached_gateway(inv.clean_attempts(tables.txn, since))
    if columns is not None:
        attempts = _read_columns(attempts, [*od.ATTEMPT_COLUMNS, *columns])
    attempts = od.with_latest(attempts.repartition(*sub.ACCOUNT))
    context = computed_once(od.with_context(attempts, inv_table, hist, declines), dealt=True)
    rows = od.order_rows(
        context.repartition(*sub.ACCOUNT), hist, since, as_of, subs_since, orders_since
    )
    return computed_once(rows.select(*(columns or rows.columns)), dealt=True)
