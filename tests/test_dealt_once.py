"""The attempt reports move each table once: joins and windows stay in the accounts' partitions."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from checks.classify_queries import _CLASS_COLUMNS, SINCE, tables
from checks.oracle_lifecycle import AS_OF
from paylens import reuse
from paylens.operators import classify as cl
from paylens.operators import gateway as gw
from paylens.plans import gateway_reports as gr


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    day = dt.date(1999, 10, 1)
    orders = [
        (k, k % 7, day + dt.timedelta(days=k * 3), "FPO"[k % 3], f"{k % 5 + 1}-X", float(100 + k)) for k in range(1, 91)
    ]
    lines = [
        (k, k * 7 + n, k + n, n, float(10 * n), 0.1, day, "ANR"[(k + n) % 3]) for k in range(1, 91) for n in range(1, 8)
    ]
    schemas = {
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string, o_totalprice double"),
        "lineitem": (
            lines,
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_tax double, l_shipdate date, l_returnflag string",
        ),
        "nation": ([(i, f"N{i}") for i in range(10)], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in schemas.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return at


def _dealt_by(spark, monkeypatch, build, module):
    """Keys of all shuffles below the last table that `build` computes."""
    seen = []
    kept = reuse.computed_once

    def watched(df, dealt=False):
        seen.append((df, dealt))
        return kept(df, dealt)

    monkeypatch.setattr(module, "computed_once", watched)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert build().count() > 0
        df, dealt = seen[-1]
        spark.conf.set(reuse.ALL_KEYS, str(not dealt).lower())
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        spark.conf.set(reuse.ALL_KEYS, "true")
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\(([^)]*?), \d+\)", plan)]


ACCOUNT = "src_system_id, account_cd"
TABLE_JOIN = {"l_orderkey", "o_orderkey"}


def test_detailed_classes_deal_by_account_only(spark, folder, monkeypatch):
    t = tables(spark, folder)
    keys = _dealt_by(spark, monkeypatch, lambda: gr.detailed_classes(t, SINCE, AS_OF), gr)
    assert set(keys) - TABLE_JOIN == {ACCOUNT}


def test_order_rows_deal_by_account_only(spark, folder, monkeypatch):
    t = tables(spark, folder)
    early = dt.date(1990, 1, 1)
    keys = _dealt_by(spark, monkeypatch, lambda: gr.orders(t, SINCE, AS_OF, early, early, early), gr)
    assert set(keys) - TABLE_JOIN == {ACCOUNT}


def test_categories_deal_by_account_only(spark, folder, monkeypatch):
    t = tables(spark, folder)
    history = gr.history(t, AS_OF)
    keys = _dealt_by(
        spark, monkeypatch, lambda: gw._parts(t.txn, t.lines, history, SINCE, gw.BY_WINDOW, True, None)[0], gw
    )
    assert set(keys) - TABLE_JOIN == {ACCOUNT}


def test_rows_that_differ_where_nobody_reads_stay_apart(spark, folder):
    t = tables(spark, folder)
    moved = t.txn.withColumns({"gateway_error_cd": F.lit("x"), "failure_type": F.lit(None).cast("string")})
    swapped = t.txn.withColumns({"gateway_error_cd": F.lit(None).cast("string"), "failure_type": F.lit("x")})
    thrice = gr.Tables(moved.unionByName(swapped).unionByName(swapped), t.lines, t.subs, t.start_types)
    few = gr.detailed_classes(thrice, SINCE, AS_OF, _CLASS_COLUMNS)
    every = gr.detailed_classes(thrice, SINCE, AS_OF).select(*_CLASS_COLUMNS)
    assert few.count() == every.count() and few.exceptAll(every).isEmpty()
    once = gr.detailed_classes(gr.Tables(swapped, t.lines, t.subs, t.start_types), SINCE, AS_OF, _CLASS_COLUMNS)
    assert few.count() == 2 * once.count()


def test_an_invoice_of_two_subscriptions_gives_a_row_per_outcome(spark):
    at = dt.datetime(2024, 7, 1)
    assigned = spark.createDataFrame(
        [(115, "a", 7, "S1", "success", at), (115, "a", 7, "S2", "declined", at), (115, "a", -1, "S1", "declined", at),
         (115, "a", None, "S1", "success", at), (115, None, 7, "S1", "success", at)],
        "src_system_id long, account_cd string, invoice_nbr long, sub_guid string, trans_status_desc string, trans_dt_ut timestamp",
    )
    invoices = spark.createDataFrame(
        [], "src_system_id long, account_cd string, invoice_nbr decimal(38,0), adj_amt double, invoice_billed_dt_ut timestamp, "
        "invoice_state_desc string, invoice_closed_dt_ut timestamp, invoice_type_cd string"
    )
    found = sorted(
        (str(r.account_cd), str(r.invoice_nbr), r.sub_guid, str(r.success_ind), str(r.invoice_billed_dt_ut), str(r.invoice_state_desc))
        for r in cl.with_invoice_state(assigned, invoices).collect()
    )
    assert found == [
        ("None", "7", "S1", "None", "None", "None"),
        ("a", "-1", "S1", "0", str(at), "not_paid"),
        ("a", "7", "S1", "0", "None", "None"),
        ("a", "7", "S1", "1", "None", "None"),
        ("a", "7", "S2", "0", "None", "None"),
        ("a", "7", "S2", "1", "None", "None"),
        ("a", "None", "S1", "None", "None", "None"),
    ]
