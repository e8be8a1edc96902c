"""Subscription, invoice, dunning and value reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import oracle_lifecycle as orc
from checks.fixtures import spark_view
from checks.oracle_anomaly import round_ratio
from checks.registry import register
from paylens.operators import invoices as inv
from paylens.operators import subscriptions as sub

AS_OF = orc.AS_OF


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as text (sentinels exceed nanosecond range), money as double."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        cols.append(c.alias(name))
    return df.select(*cols)


def _history(spark, sf_dir):
    return sub.sub_history(spark_view(spark, sf_dir, "sub"), AS_OF)


def _attempts(spark, sf_dir):
    return inv.clean_attempts(spark_view(spark, sf_dir, "att"))


def _invoices(spark, sf_dir):
    return inv.invoice_rollup(spark_view(spark, sf_dir, "adj"))


def _dunned(spark, sf_dir):
    return inv.invoices_with_dunning(
        _invoices(spark, sf_dir), inv.dunning(_attempts(spark, sf_dir))
    )


def _valued(spark, sf_dir, invoices=None):
    history = _history(spark, sf_dir)
    paid = inv.paid_per_subscription(
        history, invoices if invoices is not None else _dunned(spark, sf_dir)
    )
    return sub.with_value(history, paid, AS_OF)


def _cohorts(spark, sf_dir):
    sums = inv.invoice_sums(spark_view(spark, sf_dir, "adj"))
    return sub.cohort_subs(_valued(spark, sf_dir, sums))


_SUB = orc.view("sub") + orc.sub_ctes()
_MONEY = ("unit_amt", "total_recur_amt")
register(
    "subscription_history",
    lambda s, d: plain(_history(s, d)),
    orc.out(f"{_SUB} SELECT * FROM hist", orc.SUB_TS, _MONEY),
)

_ADJ = orc.view("adj") + orc.adj_ctes()
register(
    "invoice_rollup",
    lambda s, d: plain(_invoices(s, d)),
    orc.out(f"{_ADJ} SELECT * FROM inv", orc.INV_TS, ("adj_amt", "adj_total_amt")),
)
register(
    "invoice_sums",
    lambda s, d: plain(inv.invoice_sums(spark_view(s, d, "adj"))),
    orc.view("adj")
    + """
SELECT src_system_id, account_cd, subscription_guid, invoice_guid, nullif(trim(invoice_type_cd), '') AS invoice_type_cd
     , invoice_state_desc, CAST(sum(adj_amt) AS DOUBLE) AS adj_amt, CAST(sum(adj_total_amt) AS DOUBLE) AS adj_total_amt
FROM adj GROUP BY ALL""",
)

_ATT = orc.view("att") + orc.attempts_ctes()
_RANK_COLS = (
    "src_system_id, account_cd, subscription_guid, invoice_guid, transaction_guid, gateway_country, "
    "reference_cd, txn_origin, earliest_txn, latest_txn"
)
register(
    "attempt_ranks",
    lambda s, d: inv.attempt_ranks(_attempts(s, d)).select(*_RANK_COLS.split(", ")),
    f"{_ATT} SELECT {_RANK_COLS} FROM ranked",
)

_DUN = orc.view("att", "adj") + orc.adj_ctes() + orc.attempts_ctes() + orc.dunning_ctes()
register(
    "dunning_outcome",
    lambda s, d: inv.dunning(_attempts(s, d)),
    f"""{_DUN} SELECT dunt.*, dun_paid_type FROM dunt
LEFT JOIN dunp USING (src_system_id, account_cd, subscription_guid, invoice_guid)""",
)

_VAL = (
    orc.view("sub", "att", "adj")
    + orc.sub_ctes()
    + orc.adj_ctes()
    + orc.attempts_ctes()
    + orc.dunning_ctes()
    + orc.value_ctes()
)
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 12, 31)


def _rounded(df, *cols):
    return plain(df.withColumns({c: F.round(F.col(c), 4) for c in cols}))


register(
    "ltv_summary",
    lambda s, d: _rounded(
        sub.ltv_summary(_valued(s, d), FIRST, LAST), "arpu", "avg_tenure", "ltv"
    ),
    f"""{_VAL}
, t AS (
    SELECT src_system_id, count(DISTINCT subscription_guid) AS n, sum(sub_paid_total_amt) AS rev, sum(mths_active) AS m
    FROM valued WHERE CAST(activate_dt_et AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'
      AND sub_paid_amt > 0 AND plan_dur = 'monthly' GROUP BY ALL)
SELECT src_system_id, n AS sub_ct, CAST(rev AS DOUBLE) AS tot_rev, CAST(m AS BIGINT) AS tot_mths_active
     , round(CAST(rev AS DOUBLE) / n, 4) AS arpu, round(CAST(m AS DOUBLE) / n, 4) AS avg_tenure
     , round((CAST(rev AS DOUBLE) / n) * (CAST(m AS DOUBLE) / n), 4) AS ltv FROM t""",
)

_COH = (
    orc.view("sub", "adj")
    + orc.sub_ctes()
    + """
, sums AS (
    SELECT src_system_id, account_cd, subscription_guid, invoice_guid, invoice_state_desc
         , sum(adj_amt) AS adj_amt, sum(adj_total_amt) AS adj_total_amt FROM adj GROUP BY ALL)"""
    + orc.value_ctes(invoices="sums")
)
register(
    "cohort_subscriptions",
    lambda s, d: plain(_cohorts(s, d)),
    orc.out(
        f"{_COH} SELECT * FROM cohorts", ("activate_dt_et",), ("sub_paid_amt", "sub_paid_total_amt")
    ),
)
register(
    "retention_curve",
    lambda s, d: _rounded(sub.retention_curve(_cohorts(s, d)), "retained_pct"),
    f"""{_COH}
, r AS (
    SELECT cohort_dt, month_number, count(*) AS retained_count
    FROM cohorts, (SELECT CAST(unnest(generate_series(0, (SELECT max(mths_active) FROM cohorts))) AS INTEGER) AS month_number)
    WHERE mths_active >= month_number GROUP BY ALL)
SELECT *, round(retained_count / max(retained_count) OVER (PARTITION BY cohort_dt), 4) AS retained_pct FROM r""",
)
register(
    "cohort_ltv",
    lambda s, d: _rounded(sub.cohort_ltv(_cohorts(s, d)), "ltv", "avg_tenure"),
    f"""{_COH}
SELECT cohort_dt, count(DISTINCT subscription_guid) AS cohort_size, CAST(sum(sub_paid_total_amt) AS DOUBLE) AS total_rev
     , round(CAST(sum(sub_paid_total_amt) AS DOUBLE) / count(DISTINCT subscription_guid), 4) AS ltv
     , round(CAST(sum(mths_active) AS DOUBLE) / count(DISTINCT subscription_guid), 4) AS avg_tenure
FROM cohorts GROUP BY cohort_dt""",
)
register(
    "dunning_funnel",
    lambda s, d: inv.dunning_funnel(_valued(s, d), _dunned(s, d), FIRST, LAST),
    f"""{_VAL}
SELECT v.src_system_id, plan_dur, CASE WHEN sub_paid_amt > 0 THEN 'paid' WHEN sub_paid_amt = 0 THEN 'not_paid' END AS sub_paid_chk, mths_active
     , count(DISTINCT CASE WHEN dun_chk = 'entered_dunning' THEN invoice_nbr END) AS enter_dunning_ct
     , count(DISTINCT CASE WHEN dun_paid_type = 'cust_paid' THEN invoice_nbr END) AS cust_paid_ct
     , count(DISTINCT CASE WHEN dun_paid_type = 'vindicia_paid' THEN invoice_nbr END) AS vindicia_paid_ct
     , count(DISTINCT CASE WHEN dun_paid_type = 'recurly_paid' THEN invoice_nbr END) AS recurly_paid_ct
     , count(DISTINCT CASE WHEN dun_paid_type = 'paid' THEN invoice_nbr END) AS tot_paid_ct
     , count(DISTINCT v.subscription_guid) AS sub_ct, min(v.account_cd) AS min_account_cd, max(v.account_cd) AS max_account_cd
FROM valued v LEFT JOIN dinv ON dinv.src_system_id = v.src_system_id AND dinv.account_cd = v.account_cd AND dinv.subscription_guid = v.subscription_guid
WHERE CAST(activate_dt_et AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'
GROUP BY 1, 2, 3, 4""",
)
register(
    "mrr",
    lambda s, d: plain(sub.mrr(_history(s, d), dt.date(2024, 6, 30))),
    f"""{_SUB}
SELECT src_system_id, plan_dur, count(*) AS active_subs
     , round(CAST(sum(CASE WHEN plan_dur = 'annual' THEN total_recur_amt ELSE total_recur_amt * 12 END) AS DOUBLE) / 12, 2) AS mrr
FROM hist WHERE CAST(activate_dt_ut AS DATE) <= DATE '2024-06-30' AND CAST(expiration_dt_ut AS DATE) > DATE '2024-06-30'
GROUP BY ALL""",
)
register(
    "churn",
    lambda s, d: sub.churn(_history(s, d), dt.date(2024, 1, 1), dt.date(2024, 6, 30)),
    f"""{_SUB}
, c AS (
    SELECT src_system_id
         , count(*) FILTER (WHERE CAST(activate_dt_ut AS DATE) < DATE '2024-01-01' AND CAST(expiration_dt_ut AS DATE) >= DATE '2024-01-01') AS opening_subs
         , count(*) FILTER (WHERE CAST(expiration_dt_ut AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-06-30') AS churned_subs
         , count(*) FILTER (WHERE CAST(expiration_dt_ut AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-06-30' AND cancel_chk LIKE 'voluntary%') AS voluntary_churn
         , count(*) FILTER (WHERE CAST(expiration_dt_ut AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-06-30' AND cancel_chk LIKE 'involuntary%') AS involuntary_churn
    FROM hist GROUP BY ALL)
SELECT *, {round_ratio('churned_subs', 'opening_subs', 5)} AS gross_churn_rate FROM c""",
)
register(
    "recovery_rate",
    lambda s, d: inv.recovery_rate(_attempts(s, d), 7),
    f"""{_ATT}
, f AS (
    SELECT src_system_id, account_cd, invoice_guid, min(trans_dt_ut) AS failed_at FROM clean
    WHERE invoice_guid IS NOT NULL AND trans_status_desc = 'declined' GROUP BY ALL)
, r AS (
    SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM clean c WHERE c.src_system_id = f.src_system_id AND c.account_cd = f.account_cd
           AND c.invoice_guid = f.invoice_guid AND c.trans_status_desc IN ('success', 'void')
           AND c.trans_dt_ut > failed_at AND c.trans_dt_ut <= failed_at + INTERVAL 7 DAY) THEN 1 ELSE 0 END AS w FROM f)
SELECT src_system_id, count(*) AS failed_invoices, CAST(sum(w) AS BIGINT) AS recovered_invoices
     , {round_ratio('sum(w)', 'count(*)', 5)} AS recovery_rate FROM r GROUP BY ALL""",
)
