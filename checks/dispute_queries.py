"""Dispute matching and summaries."""

from __future__ import annotations

import datetime as dt

from checks import oracle_disputes as orc
from checks.fixtures import spark_view
from checks.lifecycle_queries import plain
from checks.registry import register
from paylens.operators import disputes as dp

SINCE, B_SINCE = dt.date(2022, 1, 1), dt.date(2022, 6, 1)


def _invoices(s, d):
    return dp.dispute_invoices(spark_view(s, d, "isum"), spark_view(s, d, "adj"), SINCE)


def _signups(s, d):
    return dp.attempt_signups(spark_view(s, d, "att"), _invoices(s, d), SINCE)


def _first(s, d):
    return dp.first_disputes(spark_view(s, d, "disp_a"), SINCE)


def _requests(s, d):
    return dp.clean_requests(
        spark_view(s, d, "creq"), spark_view(s, d, "cbatch"), spark_view(s, d, "recov"), SINCE
    )


def _all(s, d):
    invoices, recov = _invoices(s, d), spark_view(s, d, "recov")
    a = dp.processor_a(dp.match_requests(_first(s, d), _requests(s, d), invoices), recov, invoices, spark_view(s, d, "sites"))
    b = dp.processor_b(spark_view(s, d, "disp_b"), _signups(s, d), recov, invoices, spark_view(s, d, "merchants"), B_SINCE)
    return a.unionByName(b)


register("dispute_invoices", lambda s, d: plain(_invoices(s, d)), orc.invoices_sql())
register("dispute_attempt_signups", _signups, orc.signups_sql())
register("dispute_first", lambda s, d: plain(_first(s, d)), orc.first_sql())
register("dispute_requests", lambda s, d: plain(_requests(s, d)), orc.requests_sql())
register("disputes_all", lambda s, d: plain(_all(s, d)), orc.all_sql())
register("dispute_summary", lambda s, d: plain(dp.dispute_summary(_all(s, d))), orc.summary_sql())
register(
    "dispute_rate",
    lambda s, d: dp.dispute_rate(_all(s, d), spark_view(s, d, "att")),
    orc.rate_sql(),
)
