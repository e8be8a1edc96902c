"""Order reports on attempts that reached a gateway."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import oracle_orders as orc
from checks.classify_queries import SINCE, tables
from checks.oracle_lifecycle import AS_OF
from checks.registry import register
from paylens.operators import orders as od
from paylens.plans import gateway_reports as gr

BINS, CODES = 5, 3


_COUNT_COLUMNS = (
    "dt_first_attempt", "trans_gateway_type_desc", "txn_classify", "trans_status_desc_2",
    "account_count", "attempts", "attempts_no_fraud",
)


def _rows(spark, sf_dir, *columns):
    return gr.orders(
        tables(spark, sf_dir),
        SINCE,
        AS_OF,
        subs_since=dt.date(2024, 1, 1),
        orders_since=dt.date(2024, 6, 15),
        requests_since=dt.date(1996, 1, 1),
        columns=columns,
    )


register(
    "order_latest_attempts",
    lambda s, d: gr.latest_attempts(tables(s, d), SINCE).select(
        "transaction_guid", "txn_type", "trans_status_desc_2",
        F.col("latest_txn").cast("long").alias("latest_txn"),
        F.col("verify_latest_txn").cast("long").alias("verify_latest_txn"),
    ),
    orc.latest_sql(),
)
register(
    "order_attempts",
    lambda s, d: _rows(
        s, d,
        "transaction_guid", "txn_classify", "trans_status_desc_2", "decline_cd", "decline_desc",
        "dt_first_attempt", "attempts", "attempts_no_fraud", "has_success", "account_count",
    ),
    orc.rows_sql(),
)
register("order_summary", lambda s, d: od.order_summary(_rows(s, d, *_COUNT_COLUMNS, "origin_desc", "reference_cd")), orc.summary_sql())
register("order_top_bins", lambda s, d: od.top_order_bins(_rows(s, d, *_COUNT_COLUMNS, "cc_first_6_nbr"), BINS), orc.bins_sql(BINS))
register(
    "order_decline_codes",
    lambda s, d: od.top_decline_codes(
        _rows(s, d, *_COUNT_COLUMNS, "decline_cd", "decline_desc", "transaction_guid"), CODES
    ),
    orc.declines_sql(CODES),
)
