"""Details, flags and metrics are counted where the rows already are, and move narrow."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.classify_queries import _DETAIL_COLUMNS, SINCE, tables
from checks.oracle_lifecycle import AS_OF
from paylens import reuse
from paylens.operators import classify as cl
from paylens.plans import gateway_reports as gr

ORDERS = "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string, o_totalprice double"
LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_tax double, "
    "l_shipdate date, l_returnflag string"
)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    at, day = str(tmp_path_factory.mktemp("moved")), dt.date(1999, 10, 1)
    orders = [(k, k % 7, day + dt.timedelta(days=k * 3), "FPO"[k % 3], f"{k % 5 + 1}-X", 100.0 + k) for k in range(1, 91)]
    lines = [(k, k * 7 + n, k + n, n, 10.0 * n, 0.1, day, "ANR"[(k + n) % 3]) for k in range(1, 91) for n in range(1, 8)]
    nations = [(i, f"N{i}") for i in range(10)]
    for name, rows, schema in (("orders", orders, ORDERS), ("lineitem", lines, LINES), ("nation", nations, "n_nationkey int, n_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return tables(spark, at)


def _sorted(df):
    return sorted(map(str, df.collect()))


def _stored(monkeypatch, *modules):
    """The tables `modules` store from now on, as given."""
    seen, kept = [], reuse.computed_once
    for m in modules:
        monkeypatch.setattr(m, "computed_once", lambda df, dealt=False: seen.append(df) or kept(df, dealt))
    return seen


@pytest.mark.parametrize("columns", [None, _DETAIL_COLUMNS])
def test_details_are_stored_with_the_classes(raw, monkeypatch, columns):
    want = cl.with_details(gr.detailed_classes(raw, SINCE, AS_OF, columns), next_rows=False)
    seen = _stored(monkeypatch, gr)
    found = gr.detailed_attempts(raw, SINCE, AS_OF, columns, next_rows=False)
    assert "fraud_chk" in seen[-1].columns and found.columns == want.columns
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and _sorted(found) == _sorted(want)


@pytest.mark.parametrize("report", [cl.mixed_report, cl.level_report])
def test_reports_of_stored_details_write_counts_only(raw, monkeypatch, report):
    columns = [c for c in cl._REPORT_COLUMNS if c != "fraud_chk"]
    details = gr.detailed_attempts(raw, SINCE, AS_OF, columns, next_rows=False)
    want = _sorted(report(details))
    seen = _stored(monkeypatch, cl)
    assert _sorted(report(details, stored=True)) == want
    assert len(seen) == 2 and not any({"transaction_guid", "invoice_nbr"} & set(df.columns) for df in seen)


def test_flags_count_each_unit_once(spark, monkeypatch):
    rows = [("u", True, None), ("u", False, True), ("u", True, False), ("v", None, None), (None, True, True), ("w", False, True)]
    group = [F.lit(1).alias("src_system_id"), *[F.lit("x").alias(c) for c in cl.GROUP[1:]]]
    df = spark.createDataFrame(rows, "unit string, a boolean, b boolean").select("*", *group)
    out = cl._distinct_counts(df, "unit", {"a": F.col("a"), "b": F.col("b"), "any": F.lit(True)}, {"b": F.col("b"), "never": F.lit(False)})
    r = out.first()
    assert (r.a, r.b, r["any"]) == (1, 2, 3) and dict(out.dtypes)["a"] == "bigint"
    assert (r.b_ex1, r.b_ex2, r.never_ex1, r.never_ex2) == ("u", "w", None, None)
