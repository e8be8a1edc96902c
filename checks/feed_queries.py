"""Near-real-time union, hourly checks, KPIs, filters, refunds, upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import oracle_anomaly as orc
from checks.fixtures import spark_view
from checks.lifecycle_queries import plain
from checks.oracle_anomaly import half_up, round_ratio
from checks.registry import ORACLES, register
from paylens.functions import semantics as sem
from paylens.operators import anomaly as an
from paylens.operators import kpi
from paylens.operators import refunds as rf
from paylens.operators.calendar import RunWindow, baseline_dates
from paylens.plans import presets as pre
from paylens.sources import files
from paylens.sources.transactions import NRT_RENAMES, nrt_union, project_txn, txn_scope
from paylens.streaming import hourly as hr

# ------------------------------------------------------ near real time
EVENT_DAY = dt.date(2024, 1, 29)
_LA = "timezone('America/Los_Angeles', timezone('UTC', trans_dt_ut))"


def _history(spark, sf_dir):
    ev = spark_view(spark, sf_dir, "ev")
    return ev.withColumn("trans_dt", sem.zone_date(F.col("trans_dt_ut"), "America/Los_Angeles"))


def _feeds(spark, sf_dir):
    """History until Jan 28 and a near-real-time feed from Jan 25 on."""
    ev = _history(spark, sf_dir)
    back = {v: k for k, v in NRT_RENAMES.items()}
    feed = ev.where(F.col("trans_dt_ut") >= F.lit("2024-01-25").cast("timestamp")).drop("trans_dt")
    feed = feed.withColumn("cc_first_6_nbr", F.concat("cc_first_6_nbr", F.lit(".0")))
    feed = feed.withColumnsRenamed({c: back[c] for c in feed.columns if c in back})
    return feed, ev.where(F.col("trans_dt_ut") < F.lit("2024-01-28").cast("timestamp"))


_EV = f"""{fx.duck_cte('ev')}
, txn AS (SELECT *, CAST({_LA} AS DATE) AS trans_dt, CAST(extract(hour FROM {_LA}) AS INTEGER) AS trans_hr FROM ev)"""
register(
    "nrt_union",
    lambda s, d: plain(nrt_union(*_feeds(s, d))),
    f"""{_EV} SELECT DISTINCT * EXCLUDE (trans_hr) REPLACE (strftime(trans_dt_ut, '%Y-%m-%d %H:%M:%S') AS trans_dt_ut
      , CAST(trans_amt AS DOUBLE) AS trans_amt, CAST(tax_amt AS DOUBLE) AS tax_amt) FROM txn""",
)

HOURLY_TUNE = {"lookback_months": None, "lookback_days": 21, "z": 1.0, "min_baseline": 1, "excluded": ()}
_HSPEC = pre.HOURLY.with_(**HOURLY_TUNE)
_HWIN = RunWindow.days_ending(EVENT_DAY, 3)


def _hourly(spark, sf_dir):
    return pre.hourly_check(*_feeds(spark, sf_dir), EVENT_DAY, days=3, tune=HOURLY_TUNE)


_HOURLY = (
    orc.scored_sql(_HSPEC, _HWIN, source_cte=_EV)
    + f"""
, newest AS (
    SELECT src_system_id, max(trans_hr) AS max_hr FROM scoped WHERE trans_dt = DATE '{EVENT_DAY}' GROUP BY ALL)
, hours AS ({orc.wide_counts(_HSPEC, period='hourly')})
, latest AS (
    SELECT hours.* FROM hours JOIN newest ON newest.src_system_id = hours.src_system_id AND trans_hr = max_hr AND trans_dt = DATE '{EVENT_DAY}')"""
)
register("anomaly_hourly", _hourly, f"{_HOURLY} SELECT * FROM latest")
register(
    "anomaly_hourly_alert",
    lambda s, d: files.alert_projection(_hourly(s, d)),
    f"""{_HOURLY}
SELECT CASE src_system_id WHEN 115 THEN 'US' WHEN 134 THEN 'INTL' ELSE 'Legacy AU' END AS geo, trans_dt AS dt, trans_hr AS hr
     , cc_first_6_nbr AS "BIN", baseline_avg_ct AS "Average Count", baseline_stddev_ct AS "Std Deviation", hourly_ct AS "Hourly Count"
     , vol_diff AS "Diff", vol_z_score AS "Z Score" FROM latest""",
)


def _all_hours(spark, sf_dir):
    """The hourly report before the latest-hour restriction."""
    txn = pre.with_hour(nrt_union(*_feeds(spark, sf_dir), dedupe=False))
    return an.wide_counts(an.score(txn, _HSPEC, _HWIN), _HSPEC, period="hourly")


register(
    "anomaly_hourly_all_hours",
    _all_hours,
    orc.scored_sql(_HSPEC, _HWIN, source_cte=_EV) + orc.wide_counts(_HSPEC, period="hourly"),
)


def _stream_logic(spark, sf_dir):
    """The streaming check's functions on whole tables as one batch."""
    ev = txn_scope(_history(spark, sf_dir)).dropDuplicates(["transaction_guid"])
    won = sem.succeeded(F.col("trans_status_desc"))
    counts = ev.groupBy(F.date_trunc("hour", "trans_dt_ut").alias("hour_ut"), *hr.KEYS).agg(
        F.count(F.lit(1)).alias("hourly_ct"),
        F.sum(F.when(won, 1).otherwise(0)).cast("long").alias("hourly_success_ct"),
    )
    split = F.lit("2024-01-25").cast("timestamp")
    baseline = hr.hourly_baseline(counts.where(F.col("hour_ut") < split))
    return plain(hr.flag_hours(counts.where(F.col("hour_ut") >= split), baseline, 1.0, 1))


register(
    "hourly_flags",
    _stream_logic,
    f"""{_EV}
, c AS (
    SELECT date_trunc('hour', trans_dt_ut) AS hour_ut, src_system_id, cc_first_6_nbr, count(DISTINCT transaction_guid) AS hourly_ct
         , count(DISTINCT CASE WHEN trans_status_desc IN ('success', 'void') THEN transaction_guid END) AS hourly_success_ct
    FROM txn GROUP BY ALL)
, k AS (
    SELECT *, CAST(dayofweek(timezone('America/Los_Angeles', timezone('UTC', hour_ut))) + 1 AS INTEGER) AS dow
         , CAST(extract(hour FROM timezone('America/Los_Angeles', timezone('UTC', hour_ut))) AS INTEGER) AS trans_hr FROM c)
, m AS (
    SELECT src_system_id, cc_first_6_nbr, dow, trans_hr, count(*) AS n, sum(hourly_ct) AS s, sum(hourly_ct * hourly_ct) AS ss
    FROM k WHERE hour_ut < TIMESTAMP '2024-01-25' GROUP BY ALL)
, b AS (
    SELECT src_system_id, cc_first_6_nbr, dow, trans_hr, {half_up('s', 'n')} AS baseline_avg_ct, {orc.to_long(orc.stddev('n', 's', 'ss'))} AS baseline_stddev_ct FROM m)
, j AS (
    SELECT k.*, baseline_avg_ct, baseline_stddev_ct, hourly_ct - baseline_avg_ct AS vol_diff
         , {round_ratio('hourly_ct - baseline_avg_ct', 'baseline_stddev_ct', 2)} AS vol_z_score
         , CASE WHEN (hourly_ct - baseline_avg_ct) / nullif(baseline_stddev_ct, 0) >= 1 THEN 'large_increase'
                WHEN (hourly_ct - baseline_avg_ct) / nullif(baseline_stddev_ct, 0) <= -1 THEN 'large_decrease' END AS chg_flag
    FROM k JOIN b USING (src_system_id, cc_first_6_nbr, dow, trans_hr) WHERE hour_ut >= TIMESTAMP '2024-01-25' AND baseline_avg_ct >= 1)
SELECT * REPLACE (strftime(hour_ut, '%Y-%m-%d %H:%M:%S') AS hour_ut) FROM j WHERE chg_flag IS NOT NULL""",
)

# ------------------------------------------------- scope and calendar
_TXN = fx.duck_cte("txn")
_SCOPE = orc.scope_where(("api", "token_api"), "2025-10-01", "2025-12-31")
register(
    "txn_scope",
    lambda s, d: plain(
        project_txn(
            txn_scope(
                spark_view(s, d, "txn"),
                dt.date(2025, 10, 1),
                dt.date(2025, 12, 31),
                sources=(115, 134),
                bins=("400001", "400003"),
            )
        )
    ),
    f"""{_TXN} SELECT * EXCLUDE (cvv_result_desc, fraud_decision_desc, fraud_score_cd)
      REPLACE (strftime(trans_dt_ut, '%Y-%m-%d %H:%M:%S') AS trans_dt_ut, CAST(trans_amt AS DOUBLE) AS trans_amt, CAST(tax_amt AS DOUBLE) AS tax_amt)
    FROM txn WHERE {_SCOPE} AND src_system_id IN (115, 134) AND cc_first_6_nbr IN ('400001', '400003')""",
)


def _run_calendar(spark, sf_dir):
    """Attempts per run date and same-weekday baseline day."""
    txn = spark_view(spark, sf_dir, "txn")
    window = RunWindow(dt.date(2025, 12, 29), dt.date(2026, 1, 2))
    cal = baseline_dates(spark, window, months=3, same_weekday=True)
    daily = txn.groupBy("trans_dt").agg(F.count(F.lit(1)).alias("txn_ct"))
    return cal.join(F.broadcast(daily), cal.baseline_dt == daily.trans_dt).select(
        "run_dt", "baseline_dt", "txn_ct"
    )


register(
    "baseline_calendar",
    _run_calendar,
    f"""{_TXN}
, r AS (SELECT CAST(unnest(generate_series(DATE '2025-12-29', DATE '2026-01-02', INTERVAL 1 DAY)) AS DATE) AS run_dt)
, b AS (SELECT run_dt, CAST(unnest(generate_series(CAST(run_dt - INTERVAL 3 MONTH AS DATE), run_dt - 1, INTERVAL 1 DAY)) AS DATE) AS baseline_dt FROM r)
SELECT run_dt, baseline_dt, count(*) AS txn_ct FROM b JOIN txn ON trans_dt = baseline_dt
WHERE dayofweek(run_dt) = dayofweek(baseline_dt) GROUP BY ALL""",
)

# ------------------------------------------------------- attackers
_ATT_SPEC = pre.PRESETS["acct_dow_bin"].spec.with_(z=2.0, min_baseline=5)
_ATT_AS_OF = dt.date(2026, 1, 28)


def _attackers(spark, sf_dir):
    txn = spark_view(spark, sf_dir, "txn")
    window = pre.PRESETS["acct_dow_bin"].window(_ATT_AS_OF)
    flags = an.flagged(an.score(txn, _ATT_SPEC, window), _ATT_SPEC)
    scoped = txn_scope(txn, _ATT_SPEC.volume_start(window), window.end)
    return an.attackers(flags, scoped, ["cc_first_6_nbr"])


register(
    "anomaly_attackers",
    _attackers,
    orc.scored_sql(_ATT_SPEC, pre.PRESETS["acct_dow_bin"].window(_ATT_AS_OF))
    + f"""
, hit AS (SELECT DISTINCT src_system_id, trans_dt, cc_first_6_nbr FROM final WHERE {orc._any(_ATT_SPEC)})
SELECT s.src_system_id, s.trans_dt, s.cc_first_6_nbr, s.account_cd FROM scoped s JOIN hit USING (src_system_id, trans_dt, cc_first_6_nbr)""",
)

_SUBS_TUNE = {"z": 1.0, "min_baseline": 1}


def _subscriber_stacked(spark, sf_dir):
    """Attempts of known subscriptions (two thirds of the orders), or of none."""
    subs = spark_view(spark, sf_dir, "txn").where(
        F.col("subscription_guid").isNotNull()
        & (F.substring("subscription_guid", 2, 20).cast("bigint") % 3 <= 1)
    )
    txn = pre.subscriber_attempts(spark_view(spark, sf_dir, "txn"), subs)
    return pre.PRESETS["subscriber_stacked"].run(txn, _ATT_AS_OF, tune=_SUBS_TUNE)


register(
    "anomaly_subscriber_stacked",
    _subscriber_stacked,
    orc.preset_sql(
        pre.PRESETS["subscriber_stacked"],
        _ATT_AS_OF,
        _SUBS_TUNE,
        extra=" AND (subscription_guid IS NULL OR CAST(substr(subscription_guid, 2) AS BIGINT) % 3 <= 1)",
    ),
)

# ------------------------------------------------------------- KPIs
_KPI = "trans_type_desc IN ('purchase', 'verify') AND trans_status_desc IN ('success', 'void', 'declined')"
_API = "origin_desc IN ('api', 'token_api')"
_OK = "trans_status_desc IN ('success', 'void')"


def _txn_query(fn):
    return lambda s, d: plain(fn(spark_view(s, d, "txn")))


register(
    "kpi_success_rates",
    _txn_query(kpi.success_rates),
    f"""{_TXN}
, g AS (
    SELECT src_system_id, trans_dt, count(*) AS attempts, count(*) FILTER (WHERE {_OK}) AS successes
         , count(*) FILTER (WHERE trans_status_desc = 'declined') AS declines FROM txn WHERE {_KPI} AND {_API} GROUP BY ALL)
SELECT *, {round_ratio('successes', 'attempts', 5)} AS success_rate, {round_ratio('declines', 'attempts', 5)} AS decline_rate FROM g""",
)
for _grain, _start in {
    "day": "trans_dt",
    "week": "trans_dt - CAST(dayofweek(trans_dt) AS INTEGER)",
    "month": "CAST(date_trunc('month', trans_dt) AS DATE)",
}.items():
    register(
        f"kpi_volume_{_grain}",
        _txn_query(lambda t, g=_grain: kpi.volume(t, g)),
        f"{_TXN} SELECT {_start} AS period, src_system_id, count(*) AS txn_ct, CAST(sum(trans_amt) AS DOUBLE) AS txn_amt FROM txn GROUP BY 1, 2",
    )
register(
    "kpi_verification_rates",
    _txn_query(kpi.verification_rates),
    f"""{_TXN}
, g AS (
    SELECT src_system_id, count(*) AS successes, count(*) FILTER (WHERE avs_result_cd IN ('Y', 'X', 'V')) AS avs_pass
         , count(*) FILTER (WHERE cvv_result_desc = 'match') AS cvv_match FROM txn WHERE {_KPI} AND {_OK} GROUP BY ALL)
SELECT *, {round_ratio('avs_pass', 'successes', 5)} AS avs_pass_rate, {round_ratio('cvv_match', 'successes', 5)} AS cvv_match_rate FROM g""",
)
register(
    "kpi_fraud_shares",
    _txn_query(lambda t: kpi.shares(t, ["fraud_decision_desc", "fraud_score_cd"])),
    f"""{_TXN}
, g AS (SELECT fraud_decision_desc, fraud_score_cd, count(*) AS txn_ct FROM txn WHERE {_KPI} GROUP BY ALL)
SELECT *, {round_ratio('txn_ct', '(SELECT CAST(sum(txn_ct) AS BIGINT) FROM g)', 5)} AS share FROM g""",
)
register(
    "kpi_decline_breakdown",
    _txn_query(kpi.decline_breakdown),
    f"""{_TXN} SELECT failure_type, gateway_error_cd, count(*) AS declines, CAST(sum(trans_amt) AS DOUBLE) AS declined_amt
FROM txn WHERE {_KPI} AND {_API} AND trans_status_desc = 'declined' GROUP BY ALL""",
)

_FILTERS = kpi.Filters(
    date_start=dt.date(2025, 9, 1),
    date_end=dt.date(2025, 12, 31),
    src_system_id=(115, 139),
    gateway_region=("US", "UK", "unmappedgw01"),
    card_brand_nm=("visa", "discover"),
    payment_method_desc=("Credit Card",),
    dow=(2, 3, 4, 5, 6),
    hour=(8, 9, 10, 11, 12, 13, 14),
)
register(
    "filter_contract",
    _txn_query(
        lambda t: kpi.apply_filters(t, _FILTERS).select(
            "transaction_guid", "src_system_id", "trans_dt", "trans_amt"
        )
    ),
    f"""{_TXN} SELECT transaction_guid, src_system_id, trans_dt, CAST(trans_amt AS DOUBLE) AS trans_amt FROM txn
WHERE trans_dt BETWEEN DATE '2025-09-01' AND DATE '2025-12-31' AND src_system_id IN (115, 139)
  AND {orc.market_case()} IN ('US', 'UK', 'unmappedgw01') AND card_brand_nm IN ('visa', 'discover') AND payment_method_desc = 'Credit Card'
  AND dayofweek(trans_dt) BETWEEN 1 AND 5 AND extract(hour FROM trans_dt_ut) BETWEEN 8 AND 14""",
)
register(
    "filter_plan_tier",
    lambda s, d: kpi.apply_filters(
        spark_view(s, d, "sub"), kpi.Filters(plan_tier=("annual", "other"))
    ).select("subscription_guid", "plan_cd"),
    f"{fx.duck_cte('sub')} SELECT subscription_guid, plan_cd FROM sub WHERE lower(plan_cd) NOT LIKE '%monthly%'",
)
register(
    "filter_values",
    _txn_query(lambda t: kpi.filter_values(t, "country_cd")),
    f"{_TXN} SELECT DISTINCT country_cd FROM txn WHERE country_cd IS NOT NULL",
)
register(
    "gateway_market",
    _txn_query(
        lambda t: an.with_market(t).groupBy("gateway_cd", "gateway_country").agg(
            F.count(F.lit(1)).alias("txn_ct")
        )
    ),
    f"{_TXN} SELECT gateway_cd, {orc.market_case()} AS gateway_country, count(*) AS txn_ct FROM txn GROUP BY ALL",
)

# ---------------------------------------------------------- refunds
_RF = fx.duck_cte("refund", "binv", "notes")
_RQ = f"""{_RF}
, rq AS (
    SELECT request_id, coalesce(trim(account_cd), '') AS account_cd, coalesce(trim(subscription_guid), '') AS subscription_guid
         , coalesce(trim(account_note), '') AS account_note, CASE WHEN coalesce(trim(currency_cd), '') = '' THEN 'USD' ELSE trim(currency_cd) END AS currency_cd
         , refund_dt
         , CASE WHEN refund_dt LIKE '____-__-__' THEN TRY_CAST(refund_dt AS DATE)
                WHEN regexp_matches(refund_dt, '^[0-9]+/[0-9]+/[0-9]{{4}}$') THEN CAST(strptime(refund_dt, '%m/%d/%Y') AS DATE)
                WHEN regexp_matches(refund_dt, '^[0-9]+/[0-9]+/[0-9]{{2}}$') THEN CAST(strptime(regexp_replace(refund_dt, '/([0-9]+)$', '/20\\1'), '%m/%d/%Y') AS DATE) END AS refund_on
    FROM refund)
, bi AS (
    SELECT subscription_guid, total, upper(currency) AS currency, coalesce(CAST(number AS VARCHAR), id) AS label
         , CAST(coalesce(billed_at, closed_at, updated_at, created_at) AS DATE) AS invoice_dt FROM binv WHERE type = 'charge' AND total > 0)
, el AS (
    SELECT request_id, list(label ORDER BY invoice_dt, label) AS found
    FROM rq JOIN bi ON bi.subscription_guid = rq.subscription_guid AND bi.currency = upper(rq.currency_cd) AND invoice_dt >= refund_on GROUP BY request_id)"""


def _refund_plan(spark, sf_dir):
    plan = rf.refund_plan(spark_view(spark, sf_dir, "refund"), spark_view(spark, sf_dir, "binv"))
    return plan.select("request_id", *[F.col(c) for c in files.LOG_COLUMNS])


register(
    "refund_plan",
    lambda s, d: _refund_plan(s, d).select(
        "request_id",
        "account_cd",
        "subscription_guid",
        "subscription_state",
        "note_added",
        "billing_cleared",
        F.array_join("refunded_invoice_numbers", ";").alias("refunded_invoice_numbers"),
        "dry_run",
        "error",
    ),
    f"""{_RQ}
SELECT rq.request_id, account_cd, subscription_guid
     , CASE WHEN account_cd = '' OR subscription_guid = '' THEN '' ELSE '(dry-run) would terminate with refund=none' END AS subscription_state
     , NOT (account_cd = '' OR subscription_guid = '') AND account_note <> '' AS note_added
     , NOT (account_cd = '' OR subscription_guid = '') AS billing_cleared
     , CASE WHEN account_cd = '' OR subscription_guid = '' THEN '' ELSE coalesce(array_to_string(found, ';'), '') END AS refunded_invoice_numbers
     , TRUE AS dry_run
     , CASE WHEN account_cd = '' OR subscription_guid = '' THEN 'missing account_cd or subscription_guid' ELSE '' END AS error
FROM rq LEFT JOIN el ON el.request_id = rq.request_id""",
)
register(
    "refund_log",
    lambda s, d: files.log_rows(_refund_plan(s, d)),
    f"""{_RQ}
SELECT account_cd, subscription_guid
     , CASE WHEN account_cd = '' OR subscription_guid = '' THEN '' ELSE '(dry-run) would terminate with refund=none' END AS subscription_state
     , CASE WHEN NOT (account_cd = '' OR subscription_guid = '') AND account_note <> '' THEN 'yes' ELSE 'no' END AS note_added
     , CASE WHEN NOT (account_cd = '' OR subscription_guid = '') THEN 'yes' ELSE 'no' END AS billing_cleared
     , CASE WHEN account_cd = '' OR subscription_guid = '' THEN '' ELSE coalesce(array_to_string(found, ';'), '') END AS refunded_invoice_numbers
     , 'yes' AS dry_run
     , CASE WHEN account_cd = '' OR subscription_guid = '' THEN 'missing account_cd or subscription_guid' ELSE '' END AS error
FROM rq LEFT JOIN el ON el.request_id = rq.request_id""",
)
register(
    "refund_notes",
    lambda s, d: rf.notes_to_add(
        spark_view(s, d, "refund"), spark_view(s, d, "notes"), dt.date(2024, 6, 3)
    ).select("request_id", "acc_id", "account_note"),
    f"""{_RQ}
SELECT request_id, CASE WHEN account_cd = '' THEN '' ELSE 'code-' || account_cd END AS acc_id, account_note FROM rq
WHERE account_note <> '' AND account_cd NOT IN (SELECT account_cd FROM notes WHERE CAST(created_at AS DATE) = DATE '2024-06-03')""",
)
register(
    "invoice_listing",
    lambda s, d: rf.invoice_listing(spark_view(s, d, "refund"), spark_view(s, d, "binv")),
    f"""{_RQ}
SELECT account_cd, rq.subscription_guid, coalesce(CAST(b.number AS VARCHAR), b.id, '') AS invoice_number
     , coalesce(printf('%.2f', CAST(total AS DOUBLE)), '') AS amount, coalesce(trim(b.currency), '') AS currency_cd
     , coalesce(strftime(coalesce(billed_at, created_at), '%Y-%m-%d'), '') AS billed_date
     , CASE WHEN rq.subscription_guid = '' THEN 'missing subscription_guid' ELSE '' END AS error
FROM rq LEFT JOIN binv b ON b.subscription_guid = rq.subscription_guid AND rq.subscription_guid <> ''""",
)

# ---------------------------------------------------------- upsert


def _upsert(spark, sf_dir):
    """Orders as target; every third one, dearer, plus new ones as staging."""
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changed = orders.where("o_orderkey % 3 = 0").withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    new = orders.where("o_orderkey % 7 = 0").withColumn(
        "o_orderkey", F.col("o_orderkey") + 1_000_000_000
    )
    return files.upsert(orders, changed.unionByName(new), ["o_orderkey", "o_custkey"])


register(
    "keyed_upsert",
    _upsert,
    """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 7 = 0""",
)


# ------------------------------------------------------------ row range
register(
    "row_range",
    lambda s, d: files.row_range(
        fx.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 5001, 1000
    ),
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders LIMIT 1000 OFFSET 5000",
)


# ------------------------------------------------- report and refund lines
REPORT_HEADER = "Merchant ID, Request ID ,Decision Note,Amount"


def _report_lines(spark, sf_dir):
    """Suppliers as report lines: quoted commas, leading zeros, blanks, and the header of a second file."""
    s = fx.table(spark, sf_dir, "supplier")
    note = F.when(F.col("s_nationkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"'), "s_name", F.lit(', checked"')))
    cents = F.format_string("%d.%02d", F.col("s_suppkey") % 977, F.col("s_nationkey"))
    request = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    lines = s.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), request, note, cents).alias("value"))
    return lines.unionByName(s.where("s_suppkey < 2").select(F.lit(REPORT_HEADER).alias("value")))


register(
    "report_csv",
    lambda s, d: files.report_from_lines(_report_lines(s, d), REPORT_HEADER),
    """
SELECT s_suppkey AS merchant_id, lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS request_id
     , CASE WHEN s_nationkey % 5 <> 0 THEN s_name || ', checked' END AS decision_note
     , CAST((s_suppkey % 977) || '.' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS DOUBLE) AS amount
FROM supplier""",
)

REFUND_HEADER = "﻿account_cd , subscription_guid,refund_dt,account_note"


def _refund_lines(spark, sf_dir):
    """Orders as refund requests: blanks around values, missing dates and notes, a repeated header."""
    o = fx.table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    note = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit(', please "')))
    account = F.concat(F.lit("  "), F.col("o_custkey").cast("string"))
    lines = o.select(F.concat_ws(",", account, F.concat(F.lit("S"), "o_orderkey"), day, note).alias("value"))
    return lines.unionByName(o.where("o_orderkey = 0").select(F.lit(REFUND_HEADER).alias("value")))


register(
    "refund_csv",
    lambda s, d: files.refunds_from_lines(_refund_lines(s, d), REFUND_HEADER),
    """
SELECT CAST(o_custkey AS VARCHAR) AS account_cd, 'S' || o_orderkey AS subscription_guid
     , CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS refund_dt
     , CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || ', please' END AS account_note
FROM orders""",
)

register(
    "alert_rows",
    lambda s, d: files.alert_rows(files.alert_projection(_hourly(s, d)), 2),
    f"""WITH alerts AS ({ORACLES["anomaly_hourly_alert"]}), n AS (SELECT count(*) AS total FROM alerts)
SELECT alerts.*, n.total FROM alerts, n
ORDER BY {", ".join(f"{k} NULLS FIRST" for k in range(1, 10))} LIMIT 2""",
)

register(
    "alert_page",
    lambda s, d: files.alert_rows(files.alert_projection(_hourly(s, d)), 25),
    f"""WITH alerts AS ({ORACLES["anomaly_hourly_alert"]}), n AS (SELECT count(*) AS total FROM alerts)
SELECT alerts.*, n.total FROM alerts, n
ORDER BY {", ".join(f"{k} NULLS FIRST" for k in range(1, 10))} LIMIT 25""",
)
