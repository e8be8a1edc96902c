"""Oracles of the order reports."""

from __future__ import annotations

from checks import oracle_classify as oc
from checks.oracle_anomaly import round_ratio

ORDERS_SINCE, SUBS_SINCE = "2024-06-15", "2024-01-01"
_ACCT = "src_system_id, account_cd"


def ctes() -> str:
    clean_id = "CASE WHEN coalesce(trim(failure_type), '') = 'fraud_gateway' THEN NULL ELSE transaction_guid END"
    keep = """trans_gateway_type_desc IN ('adyen', 'cybersource') AND coalesce(trim(failure_type), '') NOT IN ('fraud_velocity', 'gateway_timeout')
      AND (nullif(trim(reference_cd), '') IS NOT NULL OR txn_origin = 'vindicia')"""
    return (
        oc.head(("req", "codes"), keep)
        + f"""
, decl AS (
    SELECT requestid, req.issuerresponsecode
         , replace(lower(CASE WHEN req.issuerresponsecode = 'O' THEN 'No Response sent' ELSE coalesce(response_text, 'other') END), ' ', '_') AS response_desc
    FROM req LEFT JOIN codes ON codes.cardtype = req.cardtype AND codes.issuerresponsecode = req.issuerresponsecode
    WHERE overallrcode = 0 AND CAST(requestdate AS DATE) >= DATE '1996-01-01')
, ty AS (
    SELECT *, CASE WHEN trans_status_desc IN ('success', 'void') THEN 'success' ELSE trans_status_desc END AS trans_status_desc_2
         , CASE WHEN trans_type_desc <> 'verify' AND subscription_guid IS NOT NULL THEN 'purch_on_sub' ELSE 'verify_or_purch_pre_sub' END AS txn_type
    FROM txc)
, rk AS (
    SELECT *, dense_rank() OVER (PARTITION BY {_ACCT}, invoice_guid, trans_status_desc_2 ORDER BY trans_dt_ut DESC) AS latest_txn
         , dense_rank() OVER (PARTITION BY {_ACCT}, CASE WHEN trans_type_desc = 'verify' THEN 'verify' END, trans_dt, trans_status_desc_2 ORDER BY trans_dt_ut DESC) AS verify_latest_txn
    FROM ty)
, ctx AS (
    SELECT rk.*, inv.invoice_nbr, inv.invoice_billed_dt_ut, inv.invoice_state_desc, inv.invoice_type_cd
         , h.subscription_guid AS sub_guid, h.activate_dt_et AS own_activate
         , coalesce(decl.issuerresponsecode, rk.gateway_error_cd) AS decline_cd
         , coalesce(CASE WHEN rk.gateway_error_cd = '481' AND rk.trans_gateway_type_desc = 'cybersource' THEN 'fraud_gateway'
                         WHEN response_desc IS NOT NULL THEN response_desc END, rk.failure_type) AS decline_desc
    FROM rk
    LEFT JOIN inv ON inv.src_system_id = rk.src_system_id AND inv.account_cd = rk.account_cd AND inv.invoice_guid = rk.invoice_guid
    LEFT JOIN h ON h.src_system_id = rk.src_system_id AND h.account_cd = rk.account_cd AND h.subscription_guid = rk.subscription_guid
    LEFT JOIN decl ON decl.requestid = rk.reference_cd)
, ct0 AS (
    SELECT DISTINCT {_ACCT}, invoice_guid, transaction_guid, txn_type, trans_type_desc, trans_status_desc_2
         , CASE WHEN txn_type = 'purch_on_sub' THEN min(trans_dt) OVER (PARTITION BY {_ACCT}, txn_type, invoice_guid) ELSE trans_dt END AS dt_first_attempt
         , CASE WHEN txn_type = 'purch_on_sub' THEN count(transaction_guid) OVER (PARTITION BY {_ACCT}, txn_type, invoice_guid, trans_status_desc_2)
                ELSE count(transaction_guid) OVER (PARTITION BY {_ACCT}, trans_type_desc, trans_dt, trans_status_desc_2) END AS attempts
         , CASE WHEN txn_type = 'purch_on_sub' THEN count({clean_id}) OVER (PARTITION BY {_ACCT}, txn_type, invoice_guid, trans_status_desc_2)
                ELSE count({clean_id}) OVER (PARTITION BY {_ACCT}, trans_type_desc, trans_dt, trans_status_desc_2) END AS attempts_no_fraud
    FROM ctx WHERE txn_type = 'verify_or_purch_pre_sub' OR CAST(own_activate AS DATE) >= DATE '{SUBS_SINCE}' OR sub_guid IS NULL)
, ct1 AS (
    SELECT *, CASE WHEN txn_type = 'purch_on_sub' THEN max(CAST(trans_status_desc_2 = 'success' AS INTEGER)) OVER (PARTITION BY {_ACCT}, txn_type, invoice_guid)
                   ELSE max(CAST(trans_status_desc_2 = 'success' AS INTEGER)) OVER (PARTITION BY {_ACCT}, trans_type_desc, dt_first_attempt) END AS has_success
    FROM ct0 WHERE dt_first_attempt >= DATE '{ORDERS_SINCE}')"""
        + oc.class_ctes("reached", "ctx")
        + f"""
, rn AS (
    SELECT c.*, ct1.dt_first_attempt, ct1.attempts, ct1.attempts_no_fraud, ct1.has_success
         , row_number() OVER (PARTITION BY c.src_system_id, c.account_cd, c.trans_type_desc, ct1.dt_first_attempt, c.trans_status_desc_2
              ORDER BY c.trans_dt_ut DESC, c.transaction_guid, c.txn_classify, c.decline_cd NULLS FIRST, c.decline_desc NULLS FIRST) AS row_status
         , row_number() OVER (PARTITION BY c.src_system_id, c.account_cd, ct1.dt_first_attempt, c.trans_status_desc_2
              ORDER BY c.trans_dt_ut DESC, c.transaction_guid, c.txn_classify, c.decline_cd NULLS FIRST, c.decline_desc NULLS FIRST) AS row_dt_status
    FROM classed c JOIN ct1 ON ct1.src_system_id = c.src_system_id AND ct1.account_cd = c.account_cd AND ct1.transaction_guid = c.transaction_guid
    WHERE (c.txn_type = 'purch_on_sub' AND latest_txn = 1) OR (c.txn_type = 'verify_or_purch_pre_sub' AND verify_latest_txn = 1))
, o AS (
    SELECT * REPLACE ({oc.business(all_verify=True)} AS txn_classify)
         , CAST(date_trunc('month', dt_first_attempt) AS DATE) AS mth
         , CASE WHEN txn_type = 'verify_or_purch_pre_sub' AND row_status = 1 AND (trans_status_desc_2 = 'success' OR (trans_status_desc_2 = 'declined' AND has_success = 0)) THEN 1
                WHEN txn_type = 'purch_on_sub' AND row_dt_status = 1 AND (trans_status_desc_2 = 'success' OR (trans_status_desc_2 = 'declined' AND has_success = 0)) THEN 1
                ELSE 0 END AS account_count
    FROM rn)
, orders_ AS (SELECT * FROM o WHERE txn_classify IN ('trial_verify', 'direct_to_paid', 'renewals', 'trial_to_paid'))"""
    )


def latest_sql() -> str:
    return ctes() + """
SELECT transaction_guid, txn_type, trans_status_desc_2, latest_txn, verify_latest_txn FROM rk"""


def rows_sql() -> str:
    return ctes() + """
SELECT transaction_guid, txn_classify, trans_status_desc_2, decline_cd, decline_desc, dt_first_attempt, attempts, attempts_no_fraud
     , has_success, account_count FROM orders_"""


def _counts() -> str:
    out = []
    for p, c in (("order", "account_count"), ("txn", "attempts"), ("no_fraud_txn", "attempts_no_fraud")):
        out.append(f"CAST(sum({c}) AS BIGINT) AS {p}_ct")
        for s in ("success", "declined"):
            out.append(
                f"CAST(coalesce(sum(CASE WHEN trans_status_desc_2 = '{s}' THEN {c} END), 0) AS BIGINT) AS {p}_{s}_ct"
            )
    return ", ".join(out)


def _pcts() -> str:
    return ", ".join(
        f"{round_ratio(f'{p}_success_ct', f'{p}_ct', 5)} AS {p}_success_pct"
        for p in ("order", "txn", "no_fraud_txn")
    )


def summary_sql() -> str:
    rec = "origin_desc IN ('recurring', 'force_collect', 'api_sub_change')"
    picks = []
    for p, cond in (("", "TRUE"), ("contauth_", rec), ("ecomm_", f"NOT ({rec})")):
        for s in ("success", "declined"):
            v = f"CASE WHEN {cond} AND trans_status_desc_2 = '{s}' THEN reference_cd END"
            picks += [f"min({v}) AS {p}{s}_ref_ex1", f"max({v}) AS {p}{s}_ref_ex2"]
    return (
        ctes()
        + f"""
, g AS (SELECT mth, trans_gateway_type_desc, txn_classify, {_counts()}, {', '.join(picks)} FROM orders_ GROUP BY 1, 2, 3)
SELECT *, {_pcts()} FROM g"""
    )


def bins_sql(n: int) -> str:
    return (
        ctes()
        + f"""
, g AS (SELECT mth, trans_gateway_type_desc, txn_classify, cc_first_6_nbr, {_counts()} FROM orders_ GROUP BY 1, 2, 3, 4)
SELECT *, {_pcts()} FROM g
QUALIFY row_number() OVER (PARTITION BY mth, trans_gateway_type_desc, txn_classify ORDER BY txn_ct DESC, cc_first_6_nbr) <= {n}"""
    )


def declines_sql(n: int) -> str:
    return (
        ctes()
        + f"""
, g AS (
    SELECT mth, trans_gateway_type_desc, txn_classify, decline_cd, decline_desc, CAST(sum(account_count) AS BIGINT) AS order_ct
         , CAST(sum(attempts) AS BIGINT) AS txn_ct, min(transaction_guid) AS ex1, max(transaction_guid) AS ex2
    FROM orders_ WHERE trans_status_desc_2 = 'declined' GROUP BY 1, 2, 3, 4, 5)
SELECT * FROM g
QUALIFY row_number() OVER (PARTITION BY mth, trans_gateway_type_desc, txn_classify
     ORDER BY txn_ct DESC, decline_cd NULLS FIRST, decline_desc NULLS FIRST) <= {n}"""
    )
