"""Detailed classes and the reports built on them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import oracle_classify as orc
from checks.fixtures import spark_view
from checks.lifecycle_queries import plain
from checks.oracle_lifecycle import AS_OF
from checks.registry import register
from paylens.operators import classify as cl
from paylens.plans import gateway_reports as gr

SINCE = dt.date(2024, 6, 1)


def tables(spark, sf_dir):
    names = {
        "txn": "att",
        "lines": "adj",
        "subs": "sub",
        "start_types": "starts",
        "requests": "req",
        "response_texts": "codes",
    }
    return gr.Tables(**{k: spark_view(spark, sf_dir, v) for k, v in names.items()})


def classified(spark, sf_dir, columns):
    return gr.detailed_classes(tables(spark, sf_dir), SINCE, AS_OF, columns)


def detailed(spark, sf_dir, columns, next_rows=True):
    return gr.detailed_attempts(tables(spark, sf_dir), SINCE, AS_OF, columns, next_rows)


_CLASS_COLUMNS = (
    "transaction_guid", "invoice_nbr", "sub_guid", "success_ind", "invoice_state_desc",
    "invoice_type_cd", "txn_classify", "sub_subscription_guid", "sub_overall_sub_start_type_desc",
    "sub_activate_dt_ut", "invoice_billed_dt_ut", "win_prior_expiration",
)

_DETAIL_COLUMNS = (
    "src_system_id", "account_cd", "transaction_guid", "invoice_nbr", "txn_classify", "failure_type",
)
_NEXT_COLUMNS = (
    *_DETAIL_COLUMNS, "sub_guid", "trans_dt_ut", "success_ind", "win_prior_expiration",
    "invoice_billed_dt_ut",
)


_DAY_COLUMNS = ("src_system_id", "account_cd", "trans_dt_ut", "invoice_billed_dt_ut", "txn_classify")


def _report_details(spark, sf_dir):
    columns = [c for c in cl._REPORT_COLUMNS if c != "fraud_chk"]
    return detailed(spark, sf_dir, columns, next_rows=False)


def _numbers_as_text(df, *cols):
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


register(
    "attempt_classes",
    lambda s, d: plain(
        _numbers_as_text(classified(s, d, _CLASS_COLUMNS), "invoice_nbr")
    ),
    orc.classes_sql(),
)
register(
    "attempt_next_invoice",
    lambda s, d: _numbers_as_text(
        detailed(s, d, _NEXT_COLUMNS).select(
            "transaction_guid", "txn_classify", "sub_guid", "next_txn_classify", "next_inv_nbr"
        ),
        "next_inv_nbr",
    ),
    orc.next_sql(),
)
register(
    "attempt_details",
    lambda s, d: _numbers_as_text(
        detailed(s, d, _DETAIL_COLUMNS, next_rows=False).select(
            "transaction_guid", "invoice_nbr", "txn_classify", "fraud_chk"
        ),
        "invoice_nbr",
    ),
    orc.details_sql(),
)
register(
    "gateway_classes_mixed",
    lambda s, d: _numbers_as_text(
        cl.mixed_report(_report_details(s, d), stored=True),
        "inv_success_ex1", "inv_success_ex2", "inv_decline_ex1", "inv_decline_ex2",
    ),
    orc.mixed_sql(),
)
register(
    "gateway_classes_by_level",
    lambda s, d: cl.level_report(_report_details(s, d), stored=True),
    orc.level_sql(),
)
register(
    "one_class_per_account_day",
    lambda s, d: cl.one_class_per_account_day(classified(s, d, _DAY_COLUMNS)),
    orc.per_day_sql(),
)
register(
    "repeated_transactions",
    lambda s, d: cl.repeated_transactions(classified(s, d, _DETAIL_COLUMNS[:5])),
    orc.repeated_sql(),
)
