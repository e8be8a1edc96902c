"""Attempts move narrow while they are gathered by day."""

import datetime as dt

from paylens.sources import partitions as pt


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_days_hold_every_text_as_it_was(spark, tmp_path):
    odd = [None, "", " ", "\x01", "\x02", "\x02n", "\x02s", "\x02e", "\x01\x02\x01", "a\x01b", "n", "é\n\"", "\\N"]
    day = dt.date(2025, 8, 1)
    rows = [(i, a, day if i % 5 else None, b, None if i % 3 else 1.5) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    txn = spark.createDataFrame(rows + rows[:20], "n long, a string, trans_dt date, b string, x double")
    pt.write_days(txn, str(tmp_path / "days"))
    days = pt.read_days(spark, str(tmp_path / "days"), txn.schema).select(*txn.columns)
    assert _sorted(days) == _sorted(txn)


def test_a_day_is_gathered_with_one_text_a_row(spark, tmp_path, monkeypatch):
    moved, unpacked = [], pt._unpacked
    monkeypatch.setattr(pt, "_unpacked", lambda df, like: moved.append(df) or unpacked(df, like))
    txn = spark.createDataFrame([(1, "a", "b", "c", dt.date(2025, 8, 1))], "n long, a string, b string, c string, trans_dt date")
    pt.write_days(txn, str(tmp_path / "days"))
    assert [f.dataType.simpleString() for f in moved[0].schema].count("string") == 1
