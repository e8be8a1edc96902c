"""Small cases the derived fixture does not contain."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from paylens.functions import semantics as sem
from paylens.operators import kpi, orders
from paylens.operators.windows import in_activation_window

WIN = (
    "src_system_id long, account_cd string, subscription_guid string, activate_dt_ut timestamp, prior_expiration timestamp, "
    "trial_end_dt_ut timestamp, pre_activate timestamp, post_activate timestamp"
)


def at(day, hour=0):
    return dt.datetime(2025, 2, day, hour)


def test_verifications_push_older_purchases_down(spark):
    rows = [
        (115, "a", "i", "s", "t1", "purchase", "success", at(1).date(), at(1, 11)),
        (115, "a", "i", None, "t2", "verify", "success", at(1).date(), at(1, 12)),
        (115, "a", None, "s", "t3", "purchase", "declined", at(1).date(), at(1, 9)),
        (115, "a", None, None, "t4", "verify", "declined", at(1).date(), at(1, 10)),
    ]
    df = spark.createDataFrame(
        rows,
        "src_system_id long, account_cd string, invoice_guid string, subscription_guid string, transaction_guid string, "
        "trans_type_desc string, trans_status_desc string, trans_dt date, trans_dt_ut timestamp",
    )
    got = {r["transaction_guid"]: r["latest_txn"] for r in orders.with_latest(df).collect()}
    assert got == {"t1": 2, "t2": 1, "t3": 2, "t4": 1}


def test_pending_subscriptions_come_first(spark):
    history = spark.createDataFrame(
        [
            (115, "a", "A", dt.datetime(2025, 3, 1), None, None, None, dt.datetime(2025, 3, 1, 1)),
            (115, "a", "B", None, dt.datetime(2025, 2, 1), None, None, None),
            (115, "b", "C", dt.datetime(2025, 3, 1), None, None, None, dt.datetime(2025, 3, 1, 1)),
        ],
        WIN,
    )
    attempts = spark.createDataFrame(
        [(115, "a", "t1", at(15)), (115, "a", "t2", dt.datetime(2025, 1, 15)), (115, "b", "t3", at(15)), (115, None, "t4", at(15))],
        "src_system_id long, account_cd string, transaction_guid string, trans_dt_ut timestamp",
    )
    found = in_activation_window(attempts, history)
    got = {r["transaction_guid"]: r["sub_win_subscription_guid"] for r in found.collect()}
    assert got == {"t1": "B", "t2": "A", "t3": "C", "t4": None}


@pytest.mark.parametrize("level", [100, 10**8, 2 * 10**9])
def test_deviation_of_large_counts(spark, level):
    values = [level + d for d in (0, 3, 9, 1, 12, 5, 7, 2, 8, 4, 11, 6)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    exact = F.col("v").cast("decimal(19,0)")
    stats = df.agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(exact * exact).alias("ss"))
    got = stats.select(sem.sample_stddev(F.col("n"), F.col("s"), F.col("ss"))).first()[0]
    assert got == pytest.approx(statistics.stdev(values))


def test_kpis_leave_out_test_rows_and_other_types(spark):
    rows = [
        (115, "purchase", "success", False, "visa", 1.0),
        (115, "purchase", "success", None, "visa", 2.0),
        (115, "purchase", "success", True, "visa", 4.0),
        (115, "refund", "success", False, "visa", 8.0),
        (115, "verify", "declined", False, "amex", 16.0),
    ]
    names = "src_system_id long, trans_type_desc string, trans_status_desc string, test_transaction_ind boolean, card_brand_nm string, trans_amt double"
    df = spark.createDataFrame(rows, names).withColumn("trans_dt", F.lit(at(1).date()))
    assert [(r.txn_ct, r.txn_amt) for r in kpi.volume(df).collect()] == [(3, 19.0)]
    shares = {r.card_brand_nm: (r.txn_ct, float(r.share)) for r in kpi.shares(df, ["card_brand_nm"]).collect()}
    assert shares == {"visa": (2, 0.66667), "amex": (1, 0.33333)}
    only = kpi.volume(df, filters=kpi.Filters(card_brand_nm=("amex",), trans_type_desc=("verify",)))
    assert [r.txn_ct for r in only.collect()] == [1]


def test_overlapping_subscriptions_of_one_account(spark):
    history = spark.createDataFrame(
        [(115, "a", f"s{i:03}", at(1 + i % 27), at(1) if i % 2 else None, None, None, at(1 + i % 27, 1)) for i in range(300)], WIN
    )
    days = [(115, "a", f"t{k:03}", at(1 + k % 28, k % 24)) for k in range(200)]
    attempts = spark.createDataFrame(days, "src_system_id long, account_cd string, transaction_guid string, trans_dt_ut timestamp")
    found = {r.transaction_guid: r.sub_win_subscription_guid for r in in_activation_window(attempts, history).collect()}
    subs = [(r.activate_dt_ut, r.prior_expiration or dt.datetime(1900, 1, 1), r.subscription_guid, r.post_activate) for r in history.collect()]
    assert len(found) == 200
    for _, _, guid, when in days:
        fit = [s[:1] + s[2:3] for s in subs if s[1] <= when <= s[3]]
        first = min(fit)[0] if fit else None
        got = next((s[0] for s in subs if s[2] == found[guid]), None)
        assert got == first
