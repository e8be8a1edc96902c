import datetime as dt

from pyspark.sql import functions as F

from paylens.functions import semantics as sem
from paylens.operators.calendar import RunWindow, add_months, baseline_dates


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lng(x):
    return F.lit(x).cast("long")


def test_half_values_round_away_from_zero(spark):
    r = one(spark, *[sem.round_to_long(F.lit(x)) for x in (2.5, 3.5, -2.5, 2.4999)])
    assert list(r) == [3, 4, -3, 2]
    r = one(spark, *[sem.div_half_up(lng(a), lng(b)) for a, b in ((5, 2), (-5, 2), (7, 3), (1, 0))])
    assert list(r) == [3, -3, 2, None]
    assert one(spark, sem.mean_half_up(lng(7), lng(2)))[0] == 4
    assert one(spark, sem.mean_half_up(lng(7), lng(0)))[0] is None


def test_round_ratio_is_exact_on_ties(spark):
    # 3 / 200000 = 0.000015 lies on the tie of five digits
    assert one(spark, sem.round_ratio(lng(3), lng(200000), 5))[0] == 0.00002
    assert one(spark, sem.round_ratio(lng(-1), lng(64), 5))[0] == -0.01563


def test_flag_threshold_is_inclusive(spark):
    r = one(spark, *[sem.flag_by_score(F.lit(x), 3.0) for x in (3.0, 2.99, -3.0)])
    assert list(r) == ["large_increase", None, "large_decrease"]


def test_weeks_months_and_zones(spark):
    r = one(
        spark,
        sem.week_start_sunday(F.lit(dt.date(2026, 1, 3))),
        sem.week_start_sunday(F.lit(dt.date(2026, 1, 4))),
        sem.month_boundaries(F.lit(dt.date(2026, 1, 1)), F.lit(dt.date(2025, 12, 31))),
        sem.zone_date(sem.ts("2026-01-01 03:00:00"), "America/Los_Angeles"),
        sem.zone_hour(sem.ts("2026-07-01 03:00:00"), "America/Los_Angeles"),
    )
    assert list(r) == [dt.date(2025, 12, 28), dt.date(2026, 1, 4), 1, dt.date(2025, 12, 31), 20]


def test_whole_days_versus_calendar_days(spark):
    a, b = sem.ts("2025-01-01 12:00:00"), sem.ts("2025-01-29 11:00:00")
    assert list(one(spark, sem.whole_days(b, a), F.date_diff(b, a))) == [27, 28]


def test_month_step_clamps_like_the_sql_function(spark):
    for d, n in ((dt.date(2025, 5, 31), -3), (dt.date(2024, 3, 31), -1), (dt.date(2025, 11, 30), 3)):
        assert add_months(d, n) == one(spark, F.add_months(F.lit(d), n))[0]


def test_baseline_leaves_the_run_date_out(spark):
    w = RunWindow(dt.date(2025, 5, 31), dt.date(2025, 5, 31))
    rows = [r.baseline_dt for r in baseline_dates(spark, w, 3).collect()]
    assert min(rows) == dt.date(2025, 2, 28) and max(rows) == dt.date(2025, 5, 30)
    same = [r.baseline_dt for r in baseline_dates(spark, w, 3, same_weekday=True).collect()]
    assert {d.weekday() for d in same} == {5} and len(same) == 13


def test_unknown_gateway_falls_through(spark):
    r = one(spark, sem.market(F.lit("inkqcylsbc8b")), sem.market(F.lit("other")), sem.market(F.lit(None).cast("string")))
    assert list(r) == ["CA", "other", None]


def test_extract_miss_is_null(spark):
    assert one(spark, sem.extract_or_null(F.lit("plain"), r"\((.*?)\)"))[0] is None
