"""Window and interval joins against brute force, hot accounts included."""

import datetime as dt
import random

from pyspark.sql import functions as F

from paylens.operators.intervals import interval_join
from paylens.operators.windows import in_activation_window

T0 = dt.datetime(2024, 1, 1)
NONE = dt.datetime(1900, 1, 1, 0, 0, 1)


def history_rows(rng, accounts=8, hot=40):
    rows = []
    for a in range(accounts):
        for i in range(hot if a == 0 else rng.randrange(0, 5)):
            act = T0 + dt.timedelta(hours=rng.randrange(24 * 700))
            prior = NONE if i == 0 else T0 + dt.timedelta(hours=rng.randrange(24 * 700))
            rows.append((115, f"acc{a}", f"S{a}-{i}", act, prior, act - dt.timedelta(seconds=120), act + dt.timedelta(seconds=120)))
    return rows


def attempt_rows(rng, history, n=600):
    rows = []
    for i in range(n):
        acc = "acc0" if rng.random() < 0.4 else f"acc{rng.randrange(10)}"
        own = [h for h in history if h[1] == acc]
        if own and rng.random() < 0.2:  # exactly on an edge
            h = rng.choice(own)
            at = rng.choice([h[6], h[4], h[3]])
            at = max(at, T0)
        else:
            at = T0 + dt.timedelta(hours=rng.randrange(24 * 720))
        rows.append((115, acc, f"T{i}", at))
    return rows


def frames(spark, seed):
    rng = random.Random(seed)
    h = history_rows(rng)
    a = attempt_rows(rng, h)
    hist = spark.createDataFrame(
        h,
        "src_system_id long, account_cd string, subscription_guid string, activate_dt_ut timestamp, "
        "prior_expiration timestamp, pre_activate timestamp, post_activate timestamp",
    ).withColumn("trial_end_dt_ut", F.lit(None).cast("timestamp"))
    att = spark.createDataFrame(
        a, "src_system_id long, account_cd string, transaction_guid string, trans_dt_ut timestamp"
    )
    return h, a, hist, att


def test_activation_window_equals_brute_force(spark):
    for seed in (1, 2):
        h, a, hist, att = frames(spark, seed)
        want = {}
        for _, acc, guid, at in a:
            fits = [x for x in h if x[1] == acc and x[4] <= at <= x[6]]
            want[guid] = min(fits, key=lambda x: (x[3], x[2]))[2] if fits else None
        for floor in (dt.date(2024, 1, 1), dt.date(2024, 9, 1)):
            rows = in_activation_window(att, hist, floor).collect()
            got = {r.transaction_guid: r.sub_win_subscription_guid for r in rows}
            assert len(rows) == len(a) and got == want


def test_interval_join_equals_brute_force(spark):
    h, a, hist, att = frames(spark, 3)
    intervals = hist.select("src_system_id", "account_cd", "subscription_guid", "prior_expiration", "post_activate")
    want = sorted(
        (guid, x[2])
        for _, acc, guid, at in a
        for x in h
        if x[1] == acc and x[4] <= at <= x[6]
    )
    out = interval_join(
        att, intervals, F.col("trans_dt_ut"), "prior_expiration", "post_activate",
        dt.date(2024, 3, 1), dt.date(2025, 3, 1), how="inner",
    )
    assert sorted((r.transaction_guid, r.subscription_guid) for r in out.collect()) == want
    left = interval_join(
        att, intervals, F.col("trans_dt_ut"), "prior_expiration", "post_activate",
        dt.date(2024, 3, 1), dt.date(2025, 3, 1),
    )
    alone = {g for _, _, g, _ in a} - {g for g, _ in want}
    assert {r.transaction_guid for r in left.where("subscription_guid is null").collect()} == alone
