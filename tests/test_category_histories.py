"""Gateway histories move only what cannot be computed."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from checks.classify_queries import SINCE
from checks.oracle_lifecycle import AS_OF
from paylens import reuse
from paylens.operators import gateway as gw
from paylens.plans import gateway_reports as gr

DAY = dt.datetime(2024, 7, 1)
SUBS = (
    "src_system_id long, account_cd string, subscription_guid string, plan_cd string, plan_nm string, status_desc string, "
    "creation_dt_ut timestamp, activate_dt_ut timestamp, trial_start_dt_ut timestamp, trial_end_dt_ut timestamp, "
    "curr_period_start_dt_ut timestamp, curr_period_end_dt_ut timestamp, cancel_dt_ut timestamp, expiration_dt_ut timestamp"
)


def _sub(src, account, guid, n, trial=None):
    at = DAY + dt.timedelta(days=n)
    ends = at + dt.timedelta(days=20)
    end = trial and at + dt.timedelta(days=trial)
    return (src, account, guid, "plan-monthly", "Basic", "future", at, None if n > 90 else at, None, end, at, ends, None, ends)


@pytest.fixture
def told(spark):
    rows = [_sub(134, "a", "S1", 0, 7), _sub(134, "a", "S2", 30), _sub(134, "a", "S2", 30), _sub(115, "b", "S3", 5),
            _sub(115, None, "S4", 6, 3), _sub(115, "b", None, 8), _sub(None, "c", "S5", 9), _sub(139, "d", "S6", 99)]
    types = [(134, "S2", "promo"), (134, "S2", "gift"), (115, "S3", "promo"), (115, "S4", "x"), (115, "S4", "x"), (None, "S5", "y"), (7, "S9", "z")]
    starts = spark.createDataFrame(types, "src_system_id long, subscription_guid string, overall_sub_start_type_desc string")
    txn = spark.createDataFrame(
        [(134, "a", "S1", "I1", "T1", DAY.date(), DAY, "purchase", "success", "api", "g", "4")] * 2,
        "src_system_id long, account_cd string, subscription_guid string, invoice_guid string, transaction_guid string, trans_dt date, "
        "trans_dt_ut timestamp, trans_type_desc string, trans_status_desc string, origin_desc string, trans_gateway_type_desc string, cc_first_6_nbr string",
    ).withColumn("payment_method_desc", F.lit("Credit Card"))
    lines = spark.createDataFrame(
        [(134, "a", "S1", "I1", 1, DAY, DAY, DAY, "renewal", "paid", DAY, None, "charge", "Plan", 1, 1, DAY.date())],
        "src_system_id long, account_cd string, subscription_guid string, invoice_guid string, invoice_nbr long, invoice_billed_dt_ut timestamp, "
        "start_dt_ut timestamp, end_dt_ut timestamp, invoice_type_cd string, invoice_state_desc string, invoice_closed_dt_ut timestamp, "
        "coupon_cd string, type_desc string, adj_desc string, adj_amt int, adj_total_amt int, creation_dt date",
    )
    return gr.Tables(txn, lines, spark.createDataFrame(rows, SUBS), starts)


def test_category_histories_have_the_rows_of_the_full_ones(told):
    want = gr.history(told, AS_OF).select(*gw.HISTORY_COLUMNS)
    found = gr.category_history(told, AS_OF)
    assert found.columns == want.columns
    assert found.count() == want.count() > told.subs.count()
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


@pytest.mark.parametrize("report", [gr.comparison, gr.grains, gr.by_bin])
def test_gateway_reports_move_no_times_that_follow_from_others(spark, told, monkeypatch, report):
    seen, kept = [], reuse.computed_once

    def watched(df, dealt=False):
        seen.append(df)
        return kept(df, dealt)

    monkeypatch.setattr(gr, "computed_once", watched)
    monkeypatch.setattr(gw, "computed_once", watched)
    with reuse.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", reuse.ALL_KEYS: "false"}):
        report(told, SINCE, AS_OF)
        plans = [df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines() for df in seen]
    assert seen[0].columns == list(gw.HISTORY_COLUMNS)
    moved = [below for plan in plans for line, below in zip(plan, plan[1:], strict=False) if "Exchange hashpartitioning" in line]
    assert len(moved) > 5
    assert not any(re.search(r"\b(s_pre|s_post\w*|sub_p\w+_activate|win|closes)#", line) for line in moved)
