import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from paylens.operators import activity as act
from paylens.operators import anomaly as an
from paylens.operators.calendar import RunWindow
from paylens.plans.presets import PRESETS

RUN = dt.date(2025, 6, 30)
WINDOW = RunWindow(RUN, RUN)


def attempts(spark, rows):
    """rows: (account, day, bin, status, avs)"""
    data = [
        (115, a, f"T{i}", d, b, s, v, "inkqcylsbc8b", "api", "purchase", "Credit Card")
        for i, (a, d, b, s, v) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "src_system_id long, account_cd string, transaction_guid string, trans_dt date, "
        "cc_first_6_nbr string, trans_status_desc string, avs_result_cd string, gateway_cd string, "
        "origin_desc string, trans_type_desc string, payment_method_desc string",
    )


def noisy(spark, seed=7, n=3000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rng.random() < 0.35
        rows.append(
            (
                None if rng.random() < 0.02 else f"a{rng.randrange(60)}",
                RUN - dt.timedelta(days=rng.randrange(60)),
                "400000" if hot else rng.choice(["400001", "400002", None]),
                rng.choice(["success", "void", "declined"]),
                rng.choice(["Y", "N", None]),
            )
        )
    return attempts(spark, rows)


def daily_counts(spark, counts, bin_="400001"):
    rows = [
        (f"a{i}", RUN - dt.timedelta(days=d), bin_, "success", "Y")
        for d, n in counts.items()
        for i in range(n)
    ]
    return attempts(spark, rows)


def test_activity_equals_naive_distinct_counts(spark):
    txn = noisy(spark)
    keys = ["src_system_id", "cc_first_6_nbr"]
    got = act.activity(txn, keys, "account_cd", segment=["src_system_id"])
    naive = txn.groupBy(*keys, "trans_dt").agg(
        *[
            F.count_distinct(F.when(act.outcome(m), F.col("account_cd"))).alias(f"{m}_ct")
            for m in act.METRICS
        ]
    )
    cols = [*keys, "trans_dt", *[f"{m}_ct" for m in act.METRICS]]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, naive.select(*cols).collect()))
    totals = txn.groupBy("src_system_id", "trans_dt").agg(
        *[
            F.count_distinct(F.when(act.outcome(m), F.col("account_cd"))).alias(f"{m}_tot")
            for m in act.METRICS
        ]
    )
    tcols = ["src_system_id", "trans_dt", *[f"{m}_tot" for m in act.METRICS]]
    assert sorted(map(str, got.select(*tcols).distinct().collect())) == sorted(
        map(str, totals.select(*tcols).collect())
    )


def score_one(spark, counts, **kw):
    spec = an.AnomalySpec(same_weekday=False, lookback_months=1, **kw)
    return an.score(daily_counts(spark, counts), spec, WINDOW).collect()


def test_baseline_matches_the_definition(spark):
    counts = {0: 9, 1: 2, 2: 4, 3: 7}
    row = score_one(spark, counts)[0]
    past = [2, 4, 7]
    assert row.total_ct == 9 and row.total_avg == 4
    assert row.total_std == round(statistics.stdev(past))
    assert row.total_score == 1.67 and row.total_flag is None  # (9 - 4) / 3


def test_threshold_is_inclusive_on_the_unrounded_score(spark):
    counts = {0: 10, 1: 2, 2: 4, 3: 6}  # mean 4, deviation 2, z exactly 3
    assert score_one(spark, counts, z=3.0)[0].total_flag == "large_increase"
    assert score_one(spark, counts, z=3.0001)[0].total_flag is None
    assert score_one(spark, {0: 1, 1: 4, 2: 7}, z=1.0)[0].total_flag == "large_decrease"


def test_no_spread_gives_no_score(spark):
    flat = score_one(spark, {0: 9, 1: 4, 2: 4})[0]
    assert flat.total_std == 0 and flat.total_score is None and flat.total_flag is None
    single = score_one(spark, {0: 9, 1: 4})[0]
    assert single.total_std is None and single.total_score is None


def test_missing_current_day_or_baseline_gives_no_row(spark):
    assert score_one(spark, {1: 4, 2: 5}) == []
    assert score_one(spark, {0: 4}) == []


def test_null_bins_are_left_out_and_null_safe_keys_are_kept(spark):
    txn = noisy(spark)
    spec = an.AnomalySpec(same_weekday=False, lookback_months=1)
    assert {r.cc_first_6_nbr for r in an.score(txn, spec, WINDOW).collect()} == {
        "400000", "400001", "400002",
    }
    safe = spec.with_(null_safe_keys=frozenset({"cc_first_6_nbr"}))
    assert None in {r.cc_first_6_nbr for r in an.score(txn, safe, WINDOW).collect()}


def test_excluded_days_leave_volume_and_baseline(spark):
    gone = (RUN - dt.timedelta(days=1),)
    row = score_one(spark, {0: 5, 1: 90, 2: 4, 3: 6}, excluded=gone)[0]
    assert row.total_avg == 5
    assert score_one(spark, {0: 5, 1: 3}, excluded=(RUN,)) == []


def test_dense_counts_days_without_volume_as_zero(spark):
    counts = {0: 3, 1: 6}
    sparse = score_one(spark, counts)[0]
    dense = score_one(spark, counts, dense=True)[0]
    days = 31  # May 30 to June 29
    assert sparse.total_avg == 6 and dense.total_avg == 0
    assert dense.total_std == round(statistics.stdev([6] + [0] * (days - 1)))


def test_sparse_keys_are_a_subset_of_dense_keys(spark):
    txn = noisy(spark)
    window = RunWindow(RUN - dt.timedelta(days=5), RUN)
    spec = an.AnomalySpec(lookback_months=1, metrics=act.METRICS)

    def keys(s):
        return {(r.cc_first_6_nbr, r.trans_dt) for r in an.score(txn, s, window).collect()}

    assert keys(spec) <= keys(spec.with_(dense=True))


def test_stacked_rows_are_the_sum_of_flags(spark):
    txn = noisy(spark)
    window = RunWindow(RUN - dt.timedelta(days=9), RUN)
    spec = an.AnomalySpec(lookback_months=1, metrics=act.METRICS, z=0.5)
    scored = an.score(txn, spec, window)
    flags = sum(
        r[f"{m}_flag"] is not None for r in scored.collect() for m in spec.metrics
    )
    assert flags > 0 and an.stacked_counts(scored, spec).count() == flags


def test_rounded_flags_follow_the_rounded_score(spark):
    txn = noisy(spark)
    window = RunWindow(RUN - dt.timedelta(days=9), RUN)
    spec = an.AnomalySpec(
        lookback_months=1, same_weekday=False, metrics=act.METRICS, z=0.57, flag_on_rounded=True
    )
    for r in an.score(txn, spec, window).collect():
        for m in spec.metrics:
            s = r[f"{m}_score"]
            want = None
            if s is not None and abs(s) >= 0.57:
                want = "large_increase" if s > 0 else "large_decrease"
            assert r[f"{m}_flag"] == want


def test_presets_are_named_configurations():
    assert len(PRESETS) == 19
    assert PRESETS["full_grid_rate"].spec.dense and PRESETS["full_grid_rate"].spec.share


def test_no_shuffle_after_the_daily_table_is_keyed(spark):
    spec = an.AnomalySpec(lookback_months=1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = an.score(noisy(spark), spec, WINDOW)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above = plan.split("REPARTITION_BY_COL")[0]
    # only the repartition itself stands between the report and the daily table
    assert above.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" not in plan
