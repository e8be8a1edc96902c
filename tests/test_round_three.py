"""Streams, partitions, filters, sparse keys and running sums, each on rows made to break them."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from checks.fixtures import spark_view
from paylens.operators import anomaly as an
from paylens.operators import filters as fl
from paylens.operators import sparse_keys as sk
from paylens.operators.calendar import RunWindow, baseline_dates
from paylens.operators.history import Lookback, between_readings
from paylens.plans.presets import PRESETS
from paylens.sources.partitions import PartitionedTable, read_days, write_days
from paylens.sources.transactions import txn_scope

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# running sums


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("lookback", [Lookback(months=1), Lookback(months=2, same_weekday=True), Lookback(None, 9, excluded=(dt.date(2025, 3, 3),))])
def test_readings_equal_sums_over_the_calendar(spark, dense, lookback):
    rng = random.Random(6)
    day0 = dt.date(2025, 1, 1)
    rows = {(k, day0 + dt.timedelta(days=rng.randrange(100))): rng.randrange(1, 50) for k in ("a", "b", None, "c") for _ in range(45)}
    rows |= {("late", dt.date(2025, 6, 1)): 3, ("only", dt.date(2025, 3, 5)): 4}
    rows = {k: v for k, v in rows.items() if k[1] not in lookback.excluded}
    daily = spark.createDataFrame([(k, d, n) for (k, d), n in rows.items()], "k string, trans_dt date, n long").repartition("k")
    window = RunWindow(dt.date(2025, 2, 20), dt.date(2025, 3, 20))
    out = between_readings(daily, ["k"], {"days": F.lit(1), "n_s": F.col("n")}, {"cur": F.col("n")}, window, lookback, dense)
    assert "BroadcastNestedLoop" not in plan_of(out) and "CartesianProduct" not in plan_of(out)
    days = [(r["run_dt"], r["baseline_dt"]) for r in baseline_dates(spark, window, lookback.months, lookback.days, lookback.same_weekday, lookback.excluded).collect()]
    want = {}
    for k in {k for k, _ in rows}:
        for run in [window.start + dt.timedelta(days=i) for i in range(window.days)]:
            past = [rows[k, b] for r, b in days if r == run and (k, b) in rows]
            cur = rows.get((k, run))
            if (past and cur is not None) or (dense and (past or cur is not None)):
                want[k, run] = (len(past), sum(past), int(cur is not None), cur)
    assert {(r["k"], r["run_dt"]): (r["days"], r["n_s"], r["has_current"], r["cur"]) for r in out.collect()} == want


def test_presets_need_no_calendar_join(spark):
    txn = spark_view(spark, SF, "txn")
    for name in ("full_grid_rate", "acct_dow_bin"):
        plan = plan_of(an.score(txn, PRESETS[name].spec, PRESETS[name].window(dt.date(2026, 1, 28))))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        if name == "acct_dow_bin":
            assert plan.count("Join") == plan_of(txn).count("Join")


# partitions


def test_scope_reads_only_its_days(spark, tmp_path):
    txn = spark_view(spark, SF, "txn")
    write_days(txn, str(tmp_path / "days"))
    days = read_days(spark, str(tmp_path / "days"), txn.schema)
    scope = txn_scope(days, dt.date(2025, 10, 1), dt.date(2025, 10, 7))
    plan = plan_of(scope)
    pushed = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "trans_dt" in pushed and "2025-10-01" in pushed and "2025-10-07" in pushed
    assert scope.count() == txn_scope(txn, dt.date(2025, 10, 1), dt.date(2025, 10, 7)).count()
    spec = PRESETS["acct_dow_bin"].spec
    window = RunWindow(dt.date(2026, 1, 20), dt.date(2026, 1, 22))
    daily = an.daily_volume(days, spec, window)
    assert str(spec.volume_start(window)) in plan_of(daily).split("PartitionFilters: [")[1].split("]")[0]


ROWS = "k long, v string, part string"


def table_of(df):
    return sorted(tuple(r) for r in df.collect()) if df is not None else []


def test_merge_rewrites_only_touched_partitions(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), "part")
    assert table.version() == 0 and table.read() is None
    first = [(k, f"v{k}", p) for k, p in enumerate(["a", "a", "b/ c%", "b/ c%", None, "d", "e"])]
    assert table.merge(spark.createDataFrame(first, ROWS), ["k"]) == 1
    assert table_of(table.read().fillna("-")) == sorted((k, v, p or "-") for k, v, p in first)
    before = table.folders()
    # key 2 moves from one partition to another, key 9 is new
    table.merge(spark.createDataFrame([(2, "new", "a"), (9, "n9", "f")], ROWS), ["k"])
    after = table.folders()
    same = {n for n in before if after.get(n) == before[n]}
    assert len(same) == 3 and len(after) == len(before) + 1
    want = [r for r in first if r[0] != 2] + [(2, "new", "a"), (9, "n9", "f")]
    assert table_of(table.read().fillna("-")) == sorted((k, v, p or "-") for k, v, p in want)
    assert table_of(table.read(version=1).fillna("-")) == sorted((k, v, p or "-") for k, v, p in first)
    # emptied partitions go, others keep their files
    table.merge(spark.createDataFrame([(5, "x", "a")], ROWS), ["k"])
    assert not any("v-d" == n for n in table.folders()) and table.folders()["v-e"] == before["v-e"]


def test_failed_and_overtaken_merges_change_nothing(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), "part")
    table.merge(spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], ROWS), ["k"])
    folders = table.folders()
    with pytest.raises(Exception, match="several staging rows"):
        table.merge(spark.createDataFrame([(1, "x", "p"), (1, "y", "p")], ROWS), ["k"])
    assert table.version() == 1 and table.folders() == folders
    with pytest.raises(RuntimeError, match="another merge"):
        table._commit(1, {}, spark.createDataFrame([], ROWS).schema)
    assert table.folders() == folders and table_of(table.read()) == [(1, "a", "p"), (2, "b", "q")]


# sparse keys


def test_left_join_spreads_rows_without_a_key(spark):
    rng = random.Random(2)
    left = [(i, None if i % 2 else rng.choice(["", "x", "hot", f"k{i % 37}"])) for i in range(4000)] + [(i, "hot") for i in range(4000, 6000)]
    right = [("hot", 1), ("hot", 2), ("", 3), ("k4", 4), (None, 5), ("unused", 6)]
    a, b = spark.createDataFrame(left, "id long, k string"), spark.createDataFrame(right, "k string, r int")
    want = sorted(map(repr, a.join(b, ["k"], "left").select("id", "k", "r").collect()))
    plainly = sk.left_join(a, b, ["k"], ["id"])
    assert sorted(map(repr, plainly.select("id", "k", "r").collect())) == want
    assert [r["k"] for r in sk.hot_keys(a, ["k"], 1000).collect()] == ["hot"]
    hot = sk.left_join(a, b, ["k"], ["id"], sk.hot_keys(a, ["k"], 1000), salts=16)
    assert sorted(map(repr, hot.select("id", "k", "r").collect())) == want
    # the shuffle deals the rows without a key over all partitions
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sk.left_join(a, b, ["k"], ["id"]).rdd.mapPartitions(lambda rows: [sum(r["k"] is None for r in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 1.3 * sum(sizes) / 4


# filters


def test_filters_by_table(spark):
    txn, subs = spark_view(spark, SF, "att"), spark_view(spark, SF, "sub")
    with pytest.raises(ValueError, match="need the subscriptions"):
        fl.filtered_attempts(txn, fl.Filters(plan_tier=("annual",)))
    assert fl.filtered_attempts(txn, fl.Filters()).count() == txn.count()
    chosen = fl.Filters(country_cd=("US",), plan_tier=("annual",))
    some = fl.filtered_attempts(txn, chosen, subs)
    annual = subs.where(F.lower("plan_cd").contains("annual")).select("src_system_id", "account_cd", "subscription_guid")
    want = txn.where("country_cd = 'US'").join(annual, ["src_system_id", "account_cd", "subscription_guid"], "left_semi")
    assert 0 < some.count() == want.count()
