import datetime as dt

import pytest
from pyspark.sql import functions as F

from paylens.operators import refunds as rf
from paylens.sources import files
from paylens.sources.transactions import norm_bin


def test_report_csv(spark, tmp_path):
    p = tmp_path / "report.csv"
    p.write_text(
        "Report generated today,,\nMerchant ID, Request ID ,Amount\nm1,00123,10.5\nm2,456,20.25\n"
        '"m,3",789,\n'
    )
    df = files.read_report_csv(spark, str(p))
    assert df.columns == ["merchant_id", "request_id", "amount"]
    rows = {r.merchant_id: (r.request_id, r.amount) for r in df.collect()}
    assert rows == {"m1": ("00123", 10.5), "m2": ("456", 20.25), "m,3": ("789", None)}
    assert dict(df.dtypes)["amount"] == "double" and dict(df.dtypes)["request_id"] == "string"


def test_report_csv_needs_two_lines(spark, tmp_path):
    p = tmp_path / "short.csv"
    p.write_text("only junk\n")
    with pytest.raises(ValueError):
        files.read_report_csv(spark, str(p))


def frame(spark, rows):
    return spark.createDataFrame(rows, "merchant_id string, request_id long, v string")


def values(df):
    return sorted((r.merchant_id or "", r.request_id, r.v) for r in df.collect())


def test_upsert_updates_inserts_and_is_idempotent(spark):
    target = frame(spark, [("m", 1, "old"), ("m", 2, "keep"), (None, 3, "null key")])
    staging = frame(spark, [("m", 1, "new"), ("m", 9, "insert"), (None, 3, "null key 2")])
    once = files.upsert(target, staging.where("merchant_id is not null"), ["merchant_id", "request_id"])
    want = [("", 3, "null key"), ("m", 1, "new"), ("m", 2, "keep"), ("m", 9, "insert")]
    assert values(once) == want
    again = files.upsert(once, staging.where("merchant_id is not null"), ["merchant_id", "request_id"])
    assert values(again) == want
    # a NULL key matches nothing: both rows stay
    assert len(values(files.upsert(target, staging, ["merchant_id", "request_id"]))) == 5
    assert values(files.upsert(None, staging, ["merchant_id", "request_id"])) == values(staging)


def test_upsert_rejects_ambiguous_matches(spark):
    target = frame(spark, [("m", 1, "old")])
    twice = frame(spark, [("m", 1, "a"), ("m", 1, "b")])
    with pytest.raises(Exception, match="several staging rows"):
        files.upsert(target, twice, ["merchant_id", "request_id"]).collect()
    fresh = frame(spark, [("n", 1, "a"), ("n", 1, "b")])  # no match: a merge inserts both
    assert files.upsert(target, fresh, ["merchant_id", "request_id"]).count() == 3


def test_write_upsert_creates_and_replaces(spark, tmp_path):
    a, b = str(tmp_path / "v1"), str(tmp_path / "v2")
    files.write_upsert(spark, None, frame(spark, [("m", 1, "x")]), ["merchant_id"], a)
    files.write_upsert(spark, a, frame(spark, [("m", 2, "y")]), ["merchant_id"], b)
    assert values(spark.read.parquet(b)) == [("m", 2, "y")]


def test_row_range_keeps_order_and_columns(spark):
    df = spark.range(0, 100, 1, 7).toDF("n")
    assert [r.n for r in files.row_range(df, 11, 5).collect()] == [10, 11, 12, 13, 14]
    assert [r.n for r in files.row_range(df, 0, 2).collect()] == [0, 1]
    assert files.row_range(df, 99, 50).count() == 2
    assert files.row_range(df, 101, 5).count() == 0
    assert [r.n for r in files.row_range(df.where("n >= 40"), 1, 3).collect()] == [40, 41, 42]
    assert files.row_range(df, 15, 60).columns == ["n"]


def test_row_range_over_files(spark, tmp_path):
    out = str(tmp_path / "t")
    spark.range(0, 5000, 1, 9).selectExpr("id as n", "id * 2 as m").write.parquet(out)
    df = spark.read.parquet(out)
    every = [tuple(r) for r in df.collect()]
    for start, n in ((1, 5000), (556, 2), (1000, 1700), (4999, 10)):
        assert [tuple(r) for r in files.row_range(df, start, n).collect()] == every[start - 1 : start - 1 + n]


def test_refund_csv_tolerates_marks_and_blanks(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes("﻿account_cd , subscription_guid,refund_dt,account_note\n a1 ,S1,,\n".encode())
    r = files.read_refund_csv(spark, str(p)).first()
    assert (r.account_cd, r.subscription_guid, r.refund_dt, r.account_note) == ("a1", "S1", "", "")
    bad = tmp_path / "bad.csv"
    bad.write_text("account_cd,refund_dt\n1,2\n")
    with pytest.raises(ValueError, match="subscription_guid"):
        files.read_refund_csv(spark, str(bad))


def test_log_and_alert(spark, tmp_path):
    entries = spark.createDataFrame(
        [("a", "S", "", True, False, ["1", "", "2"], True, "")],
        "account_cd string, subscription_guid string, subscription_state string, note_added boolean, "
        "billing_cleared boolean, refunded_invoice_numbers array<string>, dry_run boolean, error string",
    )
    row = files.log_rows(entries).first()
    assert (row.note_added, row.billing_cleared, row.refunded_invoice_numbers) == ("yes", "no", "1;2")
    files.write_log(entries, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).columns == list(files.LOG_COLUMNS)

    alerts = spark.range(30).toDF("n")
    report = files.alert_report(alerts, 25, ["n"])
    assert report["total"] == 30 and len(report["rows"]) == 25
    assert report["message"] == "Rows: 30 (first 25 of 30 rows)"
    assert files.alert_report(alerts.where("n < 0"))["message"] == "No anomalies."


def test_norm_bin(spark):
    df = spark.createDataFrame([("400001.0",), ("400001.6",), (None,)], "b string")
    assert [r[0] for r in df.select(norm_bin(F.col("b"))).collect()] == ["400001", "400002", None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1/5/2026", dt.date(2026, 1, 5)),
        ("01/05/2026", dt.date(2026, 1, 5)),
        ("1/5/26", dt.date(2026, 1, 5)),
        ("1/5/50", dt.date(1950, 1, 5)),
        ("2026-01-05", dt.date(2026, 1, 5)),
        ("2026-01-05 10:00", dt.date(2026, 1, 5)),
        ("2/30/2026", None),
        ("2026-13-01", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_refund_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(rf.refund_date(F.col("s"))).first()[0] == want


def test_ids(spark):
    guid = "0123456789abcdef0123456789ABCDEF"
    df = spark.createDataFrame([(guid,), ("S1",), (f"uuid-{guid}",), (None,)], "s string")
    assert [r[0] for r in df.select(rf.subscription_id(F.col("s"))).collect()] == [
        f"uuid-{guid}", "S1", f"uuid-{guid}", "",
    ]
    assert [r[0] for r in df.select(rf.account_id(F.col("s"))).collect()][1:] == ["code-S1", f"code-uuid-{guid}", ""]
