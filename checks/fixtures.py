"""Payment-shaped views over the driver's star-schema tables.

Each view is one SELECT, rendered for Spark and for DuckDB from the same text;
only date arithmetic differs between the two dialects. All expressions are
deterministic integer or date arithmetic over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paylens.functions import fixed_values as fv
from paylens.session import configure

FOLD_START = "2025-08-01"
FOLD_DAYS = 180
SHIFT_DAYS = 9000  # moves 1995..2001 order dates to 2019-08..2026-03


class _Spark:
    @staticmethod
    def days_since(expr: str, start: str) -> str:
        return f"datediff(CAST({expr} AS DATE), DATE'{start}')"

    @staticmethod
    def plus_days(d: str, n: str) -> str:
        return f"date_add({d}, CAST({n} AS INT))"

    @staticmethod
    def ts_plus_minutes(t: str, n: str) -> str:
        return f"(CAST({t} AS TIMESTAMP) + make_dt_interval(0, 0, CAST({n} AS INT)))"

    @staticmethod
    def format_date(d: str, java: str, c: str) -> str:
        return f"date_format({d}, '{java}')"


class _Duck:
    @staticmethod
    def days_since(expr: str, start: str) -> str:
        return f"datediff('day', DATE '{start}', CAST({expr} AS DATE))"

    @staticmethod
    def plus_days(d: str, n: str) -> str:
        return f"CAST({d} + CAST({n} AS INTEGER) AS DATE)"

    @staticmethod
    def ts_plus_minutes(t: str, n: str) -> str:
        return f"(CAST({t} AS TIMESTAMP) + to_minutes(CAST({n} AS INTEGER)))"

    @staticmethod
    def format_date(d: str, java: str, c: str) -> str:
        return f"strftime({d}, '{c}')"


def _case(selector: str, values, default: str | None = None) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    tail = f" ELSE {default}" if default else ""
    return f"CASE {selector} {arms}{tail} END"


_GATEWAYS = [codes[0] for codes in fv.GATEWAYS_BY_MARKET.values()] + ["unmappedgw01"]


def txn_sql(d) -> str:
    """Payment attempts folded into a 180-day window."""
    day = d.plus_days(
        f"DATE '{FOLD_START}'", f"({d.days_since('l_shipdate', '1995-01-01')}) % {FOLD_DAYS}"
    )
    return f"""
SELECT CAST(CASE l_suppkey % 3 WHEN 0 THEN 115 WHEN 1 THEN 134 ELSE 139 END AS BIGINT) AS src_system_id
     , CAST(o_custkey AS VARCHAR(40)) AS account_cd
     , CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('S', l_orderkey) END AS subscription_guid
     , CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('I', l_orderkey) END AS invoice_guid
     , concat('T', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS transaction_guid
     , {day} AS trans_dt
     , {d.ts_plus_minutes(day, '(l_partkey % 24) * 60 + l_suppkey % 60')} AS trans_dt_ut
     , CASE WHEN l_partkey % 4 = 0 THEN 'api' WHEN l_partkey % 4 = 1 THEN 'token_api'
            WHEN l_partkey % 4 = 2 THEN 'recurring'
            WHEN l_linenumber = 2 THEN 'api_sub_change' ELSE 'api' END AS origin_desc
     , CASE WHEN l_linenumber = 1 THEN 'verify' ELSE 'purchase' END AS trans_type_desc
     , CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'void' ELSE 'declined' END AS trans_status_desc
     , CAST(l_extendedprice AS DECIMAL(18,2)) AS trans_amt
     , CAST(l_tax AS DECIMAL(18,2)) AS tax_amt
     , CASE l_suppkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'AUD' END AS currency_cd
     , {_case('l_suppkey % 5', ['US', 'CA', 'GB', 'DE', None])} AS country_cd
     , CASE WHEN l_suppkey % 2 = 0 THEN 'adyen' ELSE 'cybersource' END AS trans_gateway_type_desc
     , {_case('l_suppkey % 12', _GATEWAYS)} AS gateway_cd
     , CASE WHEN l_returnflag = 'R' THEN {_case('l_partkey % 7', ['51', '05', '14', '54', '61', '65', None])} END AS gateway_error_cd
     , CASE WHEN l_returnflag = 'R' THEN {_case('l_partkey % 4', ['soft', 'hard', 'fraud', None])} END AS failure_type
     , CASE WHEN l_partkey % 20 = 0 THEN 'Wallet' ELSE 'Credit Card' END AS payment_method_desc
     , {_case('l_suppkey % 4', ['Visa', 'MasterCard', 'Discover', 'American Express'])} AS cc_type_desc
     , CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE CAST(400000 + l_suppkey % 10 AS VARCHAR(10)) END AS cc_first_6_nbr
     , {_case('l_suppkey % 4', ['visa', 'mastercard', 'discover', 'amex'])} AS card_brand_nm
     , CASE WHEN l_partkey % 2 = 0 THEN 'credit' ELSE 'debit' END AS card_type_cd
     , 'standard' AS card_level_cd
     , concat('Bank ', l_suppkey % 8) AS card_issuer_nm
     , {_case('l_suppkey % 5', ['US', 'CA', 'GB', 'DE', 'AU'])} AS card_issuing_country_cd
     , CASE WHEN l_partkey % 11 = 0 THEN 'Collected by Vindicia' ELSE 'Approved' END AS approval_desc
     , CASE WHEN l_linenumber <= 2 THEN 'Y' WHEN l_linenumber = 3 THEN 'X' WHEN l_linenumber = 4 THEN 'V'
            WHEN l_linenumber <= 6 THEN 'N' END AS avs_result_cd
     , {_case('l_partkey % 5', ['match', 'match', 'no match', 'not processed', None])} AS cvv_result_desc
     , 'ok' AS trans_msg_desc
     , CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN concat('a;R', l_orderkey, ';c')
            ELSE concat('R', l_orderkey) END AS reference_cd
     , {_case('l_partkey % 6', ['approve', 'approve', 'approve', 'review', 'decline', None])} AS fraud_decision_desc
     , {_case('l_suppkey % 4', ['low', 'low', 'medium', 'high'])} AS fraud_score_cd
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _source_of_account(col: str) -> str:
    return f"CAST(CASE {col} % 3 WHEN 0 THEN 115 WHEN 1 THEN 134 ELSE 139 END AS BIGINT)"


def _activate(d) -> str:
    day = d.plus_days("CAST(o_orderdate AS DATE)", str(SHIFT_DAYS))
    return d.ts_plus_minutes(day, "o_orderkey % 1440")


def _has_trial() -> str:
    return "substr(o_orderpriority, 1, 1) IN ('1', '2')"


def subscription_sql(d) -> str:
    """One subscription per order; the customer is the account."""
    day = 1440
    start = "period_start_dt_ut"

    def later(days: str) -> str:
        return d.ts_plus_minutes(start, f"({days}) * {day}")

    return f"""
SELECT src_system_id, account_cd, subscription_guid, plan_cd, plan_nm, unit_amt, total_recur_amt
     , currency_cd, status_desc, creation_dt_ut, activate_dt_ut, trial_start_dt_ut, trial_end_dt_ut
     , period_start_dt_ut AS curr_period_start_dt_ut
     , {later('30')} AS curr_period_end_dt_ut
     , CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN {start}
            WHEN o_orderstatus = 'F' THEN {later('27 + o_orderkey % 2')}
            WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 2 THEN {later('-5')}
            WHEN o_orderstatus = 'P' THEN {later('10')} END AS cancel_dt_ut
     , CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN {start}
            WHEN o_orderstatus = 'F' THEN {later('27 + o_orderkey % 2')}
            WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN {later('27 + o_orderkey % 2')}
            WHEN o_orderstatus = 'P' THEN {later('30')} END AS expiration_dt_ut
FROM (
  SELECT {_source_of_account('o_custkey')} AS src_system_id
       , CAST(o_custkey AS VARCHAR(40)) AS account_cd
       , concat('S', o_orderkey) AS subscription_guid
       , {_case('o_orderkey % 5', ['plan-monthly', 'plan-annual', 'plan-MONTHLY', 'gift-annual', 'special'])} AS plan_cd
       , {_case('o_orderkey % 4', ['Essential (Promo) - Monthly', 'Premium - Annual', 'Family Plan (Gift) - Monthly', 'Basic'])} AS plan_nm
       , CAST(o_totalprice AS DECIMAL(18,2)) AS unit_amt
       , CAST(o_totalprice AS DECIMAL(18,2)) AS total_recur_amt
       , 'USD' AS currency_cd
       , 'future' AS status_desc
       , o_orderkey, o_orderstatus
       , {_activate(d)} AS creation_dt_ut
       , {_activate(d)} AS activate_dt_ut
       , CASE WHEN {_has_trial()} THEN {_activate(d)} END AS trial_start_dt_ut
       , CASE WHEN {_has_trial()} THEN {d.ts_plus_minutes(_activate(d), str(7 * day))} END AS trial_end_dt_ut
       , {d.ts_plus_minutes(_activate(d), f'(o_orderkey % 12) * 30 * {day}')} AS period_start_dt_ut
  FROM orders
) o"""


_PERIOD = "(l_linenumber % 3)"


def _billed(d) -> str:
    """Invoice billing time: a function of the order and the period only."""
    minutes = (
        f"{_PERIOD} * 43200 + CASE WHEN {_has_trial()} THEN 10080 + o_orderkey % 4 "
        "ELSE (o_orderkey % 5) * 3 END"
    )
    return d.ts_plus_minutes(_activate(d), minutes)


def adjustment_sql(d) -> str:
    """Invoice lines; three invoices (periods) per subscription."""
    kind = f"""CASE WHEN {_PERIOD} > 0 AND l_orderkey % 7 = 0 THEN ' '
            WHEN {_PERIOD} > 0 THEN 'renewal'
            WHEN l_orderkey % 5 <= 1 THEN 'renewal' WHEN l_orderkey % 5 = 2 THEN 'purchase'
            WHEN l_orderkey % 5 = 3 THEN 'immediate_change' ELSE 'gift_card' END"""
    return f"""
SELECT src_system_id, account_cd, subscription_guid, invoice_guid, invoice_nbr, invoice_billed_dt_ut
     , invoice_billed_dt_ut AS start_dt_ut
     , {d.ts_plus_minutes('invoice_billed_dt_ut', '43200')} AS end_dt_ut
     , invoice_type_cd, invoice_state_desc
     , {d.ts_plus_minutes('invoice_billed_dt_ut', '60')} AS invoice_closed_dt_ut
     , coupon_cd
     , CASE WHEN invoice_type_cd = 'gift_card' THEN 'credit' ELSE 'charge' END AS type_desc
     , CASE WHEN invoice_type_cd = 'gift_card' THEN 'Gift Card redemption' ELSE 'Plan charge' END AS adj_desc
     , CASE WHEN invoice_type_cd = 'gift_card' THEN -2 * price ELSE price END AS adj_amt
     , CASE WHEN invoice_type_cd = 'gift_card' THEN -2 * price ELSE price + tax END AS adj_total_amt
     , CAST(invoice_billed_dt_ut AS DATE) AS creation_dt
FROM (
  SELECT {_source_of_account('o_custkey')} AS src_system_id
       , CAST(o_custkey AS VARCHAR(40)) AS account_cd
       , concat('S', l_orderkey) AS subscription_guid
       , concat('I', l_orderkey, '-', {_PERIOD}) AS invoice_guid
       , l_orderkey * 10 + {_PERIOD} AS invoice_nbr
       , {_billed(d)} AS invoice_billed_dt_ut
       , {kind} AS invoice_type_cd
       , CASE WHEN (l_orderkey + {_PERIOD}) % 6 = 0 THEN 'past_due' ELSE 'paid' END AS invoice_state_desc
       , CASE WHEN l_orderkey % 9 = 0 THEN 'SAVE10' END AS coupon_cd
       , CAST(l_extendedprice AS DECIMAL(18,2)) AS price
       , CAST(l_tax AS DECIMAL(18,2)) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
) a"""


def attempt_sql(d) -> str:
    """Attempts around subscription windows and invoices."""
    loose = "(l_linenumber IN (1, 7))"
    when = f"""CASE WHEN {loose}
              THEN {d.ts_plus_minutes(_activate(d), '(l_partkey % 61 - 30) * 1440 + l_suppkey % 5')}
              ELSE {d.ts_plus_minutes(_billed(d), '(l_partkey % 4) * 1440 + l_suppkey % 5')} END"""
    return f"""
SELECT src_system_id, account_cd, subscription_guid, invoice_guid, transaction_guid
     , CAST(trans_dt_ut AS DATE) AS trans_dt, trans_dt_ut, origin_desc, trans_type_desc, trans_status_desc
     , trans_amt, tax_amt, currency_cd, country_cd, trans_gateway_type_desc, gateway_cd, gateway_error_cd
     , failure_type, payment_method_desc, cc_type_desc, cc_first_6_nbr, card_brand_nm, approval_desc
     , avs_result_cd, trans_msg_desc, reference_cd, fraud_decision_desc
FROM (
  SELECT {_source_of_account('o_custkey')} AS src_system_id
       , CAST(o_custkey AS VARCHAR(40)) AS account_cd
       , CASE WHEN {loose} THEN (CASE WHEN l_partkey % 2 = 0 THEN ' ' END) ELSE concat('S', l_orderkey) END AS subscription_guid
       , CASE WHEN {loose} THEN (CASE WHEN l_partkey % 2 = 0 THEN '' END) ELSE concat('I', l_orderkey, '-', {_PERIOD}) END AS invoice_guid
       , concat('T', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS transaction_guid
       , {when} AS trans_dt_ut
       , CASE WHEN l_linenumber = 2 AND l_partkey % 3 = 0 THEN 'api_sub_change'
              ELSE {_case('l_partkey % 5', ['api', 'token_api', 'recurring', 'force_collect', 'external_recovery'])} END AS origin_desc
       , CASE WHEN l_linenumber = 1 THEN 'verify' ELSE 'purchase' END AS trans_type_desc
       , CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'void' ELSE 'declined' END AS trans_status_desc
       , CAST(l_extendedprice AS DECIMAL(18,2)) AS trans_amt
       , CAST(l_tax AS DECIMAL(18,2)) AS tax_amt
       , 'USD' AS currency_cd
       , {_case('l_suppkey % 5', ['US', 'CA', 'GB', 'DE', None])} AS country_cd
       , {_case('l_suppkey % 5', ['adyen', 'cybersource', 'adyen', 'cybersource', None])} AS trans_gateway_type_desc
       , {_case('l_suppkey % 12', _GATEWAYS)} AS gateway_cd
       , CASE WHEN l_returnflag = 'R' THEN {_case('l_partkey % 7', ['51', '05', '14', '481', '54', '65', None])} END AS gateway_error_cd
       , CASE WHEN l_returnflag = 'R' THEN {_case('l_partkey % 5', ['soft', 'fraud_gateway', 'fraud_velocity', None, 'gateway_timeout'])} END AS failure_type
       , 'Credit Card' AS payment_method_desc
       , {_case('l_suppkey % 4', ['Visa', 'MasterCard', 'Discover', 'American Express'])} AS cc_type_desc
       , CAST(400000 + l_suppkey % 10 AS VARCHAR(10)) AS cc_first_6_nbr
       , {_case('l_suppkey % 4', ['visa', 'mastercard', 'discover', 'amex'])} AS card_brand_nm
       , CASE WHEN l_partkey % 11 = 0 THEN ' Collected by Vindicia ' ELSE 'Approved' END AS approval_desc
       , CASE WHEN l_linenumber <= 3 THEN 'Y' ELSE 'N' END AS avs_result_cd
       , CASE WHEN l_partkey % 5 = 0 THEN 'Declined by FRAUD rule' ELSE 'ok' END AS trans_msg_desc
       , CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN concat('a;R', l_orderkey, ';c')
              ELSE concat('R', l_orderkey) END AS reference_cd
       , CASE WHEN l_partkey % 6 = 0 THEN 'decline' ELSE 'approve' END AS fraud_decision_desc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
) t"""


def start_type_sql(d) -> str:
    """Start type of two thirds of the subscriptions."""
    return f"""
SELECT concat('S', o_orderkey) AS subscription_guid, {_source_of_account('o_custkey')} AS src_system_id
     , CASE WHEN o_orderkey % 3 = 0 THEN 'promo_start' ELSE 'gift_start' END AS overall_sub_start_type_desc
FROM orders WHERE o_orderkey % 3 <= 1"""


def gateway_request_sql(d) -> str:
    """Gateway responses; the request id is the attempts' reference."""
    return f"""
SELECT concat('R', o_orderkey) AS requestid, 'merchant' AS merchantid
     , {_case('o_custkey % 4', ['Visa', 'MasterCard', 'American Express', 'Discover'])} AS cardtype
     , concat('0', o_orderkey % 7) AS issuerresponsecode
     , CAST(o_orderkey % 2 AS INT) AS overallrcode
     , CAST(o_orderdate AS TIMESTAMP) AS requestdate
FROM orders"""


def response_text_sql(d) -> str:
    """Response texts by card brand and code."""
    return f"""
SELECT {_case('n_nationkey % 4', ['Visa', 'MasterCard', 'American Express', 'Discover'])} AS cardtype
     , concat('0', n_nationkey % 7) AS issuerresponsecode
     , concat('Do Not ', n_name) AS response_text
FROM nation"""


def _shifted(d) -> str:
    return d.plus_days("CAST(o_orderdate AS DATE)", str(SHIFT_DAYS))


def invoice_sum_sql(d) -> str:
    """One summary row per order's first invoice."""
    return f"""
SELECT {_source_of_account('o_custkey')} AS src_system_id, CAST(o_custkey AS VARCHAR(40)) AS account_cd
     , {_case('o_orderkey % 5', ['US', ' US ', None, 'IT', 'GB'])} AS country_cd
     , concat('I', o_orderkey, '-0') AS invoice_guid, o_orderkey * 10 AS invoice_nbr
     , 'charge' AS invoice_type_desc, 'paid' AS status_desc
     , {_activate(d)} AS billed_dt_ut, {_activate(d)} AS closed_dt_ut
     , CASE WHEN o_orderkey % 8 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total_amt
     , CASE WHEN o_orderkey % 3 = 0 THEN 'nan' ELSE 'D1' END AS dunning_campaign_id
     , CAST(date_trunc('month', {_shifted(d)}) AS DATE) AS partition_month_start_dt
FROM orders"""


def card_request_sql(d) -> str:
    return f"""
SELECT concat('Q', o_orderkey) AS requestid, concat('m', o_orderkey % 3) AS merchantid, {_activate(d)} AS requestdate
     , CASE o_orderkey % 5 WHEN 0 THEN concat('T', lpad(CAST(o_orderkey AS VARCHAR(40)), 31, '0'))
            WHEN 3 THEN concat('PAR', o_orderkey) WHEN 4 THEN concat('X-', o_orderkey)
            ELSE CAST(o_orderkey * 10 AS VARCHAR(40)) END AS merchantreferencenumber
     , CASE o_orderkey % 7 WHEN 0 THEN concat('cust', o_custkey) WHEN 1 THEN NULL ELSE CAST(o_custkey AS VARCHAR(40)) END AS customerid
     , CASE o_orderkey % 3 WHEN 0 THEN CAST(100000000 + o_orderkey AS VARCHAR(40)) WHEN 1 THEN concat('VISA', 100000000 + o_orderkey)
            ELSE concat('MC01 ', 100000000 + o_orderkey) END AS networktransactionid
     , 'unused' AS transactionrefnumber
     , CASE WHEN o_orderkey % 11 = 0 THEN CAST(1 AS DECIMAL(18,2)) WHEN o_orderkey % 13 = 0 THEN CAST(0 AS DECIMAL(18,2))
            ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount
     , CASE WHEN o_orderkey % 10 = 0 THEN 200 ELSE 100 END AS overallreasoncode
FROM orders"""


def card_batch_sql(d) -> str:
    return f"""
SELECT concat('Q', o_orderkey) AS requestid, concat('m', o_orderkey % 3) AS merchantid, {_activate(d)} AS requestdate
     , concat('TR', o_orderkey) AS transactionrefnumber
FROM orders WHERE o_orderkey % 2 = 0"""


def recovery_sql(d) -> str:
    return """
SELECT concat('PAR', o_orderkey) AS external_reference
     , CASE WHEN o_orderkey % 2 = 0 THEN concat('IT', o_orderkey * 10) ELSE CAST(o_orderkey * 10 AS VARCHAR(40)) END AS invoice_number
FROM orders WHERE o_orderkey % 5 = 3"""


_REASONS = ["Fraud - Card Absent", "No Authorization", "Chip Liability Shift", "Duplicate", "Not as described", None]


_COUNTRIES = ["US", "AU", "AT", "IT", "DE"]


def dispute_a_sql(d) -> str:
    """Two dispute events per chosen order; the earlier one is the first."""
    parts = []
    for later in (10, 25):

        def day(n):
            return d.format_date(d.plus_days(_shifted(d), n), "M/d/yyyy", "%-m/%-d/%Y")

        parts.append(
            f"""SELECT CAST(CASE o_orderkey % 4 WHEN 0 THEN 5000 WHEN 1 THEN 5001 WHEN 2 THEN 5002 ELSE 999 END AS BIGINT) AS site_id_be
     , CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(100000000 + o_orderkey AS VARCHAR(40)) END AS transaction_id
     , {day('o_orderkey % 5 - 1')} AS txn_date, {day(str(later))} AS received_date, {day('40')} AS disposition_date
     , CASE WHEN o_orderkey % 9 = 0 THEN 'Pre-Arbitration' ELSE 'First Chargeback' END AS chargeback_work_type
     , {_case('o_orderkey % 6', _REASONS)} AS dispute_reason
     , CAST(o_totalprice AS DECIMAL(18,2)) AS chargeback_amount, concat('C', o_orderkey, '-', {later}) AS case_number
FROM orders WHERE o_orderkey % 3 <= 1"""
        )
    return " UNION ALL ".join(parts)


def dispute_b_sql(d) -> str:
    return f"""
SELECT {_case('o_orderkey % 4', ['shop_0', 'shop_3', 'shop_4', 'other'])} AS merchant_account
     , concat('PSP', o_orderkey, '-', l_partkey) AS psp_reference
     , CASE WHEN o_orderkey % 5 = 3 THEN concat('PAR', o_orderkey)
            ELSE concat('T', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) END AS merchant_reference
     , CASE WHEN o_orderkey % 7 = 0 THEN concat('shop', o_custkey) ELSE CAST(o_custkey AS VARCHAR(40)) END AS shopper_reference
     , CASE WHEN l_partkey % 8 = 0 THEN 'Refund' ELSE 'Chargeback' END AS record_type
     , {_case('l_partkey % 6', _REASONS)} AS dispute_reason
     , CAST({d.plus_days(_shifted(d), '20')} AS TIMESTAMP) AS dispute_date
     , CAST({_shifted(d)} AS TIMESTAMP) AS payment_date
     , CAST(l_extendedprice AS DECIMAL(18,2)) AS dispute_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 3 AND o_custkey % 2 = 1"""


def site_sql(d) -> str:
    """Dispute sites and their countries: one per nation."""
    return f"""
SELECT CAST(5000 + n_nationkey AS BIGINT) AS site_id_be, {_case('n_nationkey % 5', _COUNTRIES)} AS country_cd FROM nation"""


def merchant_sql(d) -> str:
    """Merchant accounts and their countries: one per nation."""
    return f"""
SELECT concat('shop_', n_nationkey) AS merchant_account, {_case('n_nationkey % 5', _COUNTRIES)} AS country_cd FROM nation"""


def refund_request_sql(d) -> str:
    """Refund requests: one per order of every third customer."""
    day = d.format_date(d.plus_days(_shifted(d), "-20"), "M/d/yyyy", "%-m/%-d/%Y")
    iso = d.format_date(d.plus_days(_shifted(d), "-20"), "yyyy-MM-dd", "%Y-%m-%d")
    short = d.format_date(d.plus_days(_shifted(d), "-20"), "M/d/yy", "%-m/%-d/%y")
    return f"""
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 19 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR(40)) END AS account_cd
     , CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat(' S', o_orderkey, ' ') END AS subscription_guid
     , CASE o_orderkey % 5 WHEN 0 THEN {iso} WHEN 1 THEN {day} WHEN 2 THEN {short} WHEN 3 THEN 'soon' ELSE '' END AS refund_dt
     , CASE WHEN o_orderkey % 2 = 0 THEN 'refund note' END AS account_note
     , CASE o_orderkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN '' ELSE 'EUR' END AS currency_cd
FROM orders WHERE o_custkey % 3 = 0"""


def billing_invoice_sql(d) -> str:
    """Billing-system invoices: one per order line."""
    t = d.ts_plus_minutes(_activate(d), "(l_linenumber - 3) * 14400")
    return f"""
SELECT concat('S', l_orderkey) AS subscription_guid
     , CASE WHEN l_linenumber = 6 THEN 'credit' ELSE 'charge' END AS type
     , CASE WHEN l_linenumber = 5 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS total
     , CASE WHEN l_suppkey % 4 = 0 THEN 'EUR' WHEN l_suppkey % 4 = 1 THEN 'usd' ELSE 'USD' END AS currency
     , CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_orderkey * 100000 + l_partkey * 10 + l_linenumber END AS number
     , concat('id', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS id
     , CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {t} END AS billed_at
     , CASE WHEN l_partkey % 3 = 0 AND l_partkey % 2 = 0 THEN {t} END AS closed_at
     , CAST(NULL AS TIMESTAMP) AS updated_at
     , CASE WHEN l_partkey % 15 = 0 THEN NULL ELSE {t} END AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def note_sql(d) -> str:
    return f"""
SELECT CAST(o_custkey AS VARCHAR(40)) AS account_cd, {_activate(d)} AS created_at
FROM orders WHERE o_orderkey % 2 = 0"""


def event_txn_sql(d) -> str:
    """Hourly fixture: events as payment attempts in the historical layout."""
    return """
SELECT CAST(CASE user_id % 3 WHEN 0 THEN 115 WHEN 1 THEN 134 ELSE 139 END AS BIGINT) AS src_system_id
     , CAST(user_id AS VARCHAR(40)) AS account_cd
     , concat('S', user_id) AS subscription_guid, concat('I', event_id) AS invoice_guid
     , CAST(event_id AS VARCHAR(40)) AS transaction_guid
     , CAST(ts AS TIMESTAMP) AS trans_dt_ut
     , CASE WHEN event_type = 'signup' THEN 'token_api' ELSE 'api' END AS origin_desc
     , CASE WHEN event_type = 'view' THEN 'verify' ELSE 'purchase' END AS trans_type_desc
     , CASE event_type WHEN 'error' THEN 'declined' WHEN 'view' THEN 'void' ELSE 'success' END AS trans_status_desc
     , CAST(value AS DECIMAL(18,2)) AS trans_amt
     , CAST(0 AS DECIMAL(18,2)) AS tax_amt
     , 'Credit Card' AS payment_method_desc
     , CAST(400000 + user_id % 5 AS VARCHAR(10)) AS cc_first_6_nbr
     , CASE WHEN event_id % 2 = 0 THEN 'Y' ELSE 'N' END AS avs_result_cd
FROM events"""


_VIEWS = {
    "txn": (txn_sql, ("lineitem", "orders")),
    "sub": (subscription_sql, ("orders",)),
    "adj": (adjustment_sql, ("lineitem", "orders")),
    "att": (attempt_sql, ("lineitem", "orders")),
    "starts": (start_type_sql, ("orders",)),
    "req": (gateway_request_sql, ("orders",)),
    "codes": (response_text_sql, ("nation",)),
    "isum": (invoice_sum_sql, ("orders",)),
    "creq": (card_request_sql, ("orders",)),
    "cbatch": (card_batch_sql, ("orders",)),
    "recov": (recovery_sql, ("orders",)),
    "disp_a": (dispute_a_sql, ("orders",)),
    "disp_b": (dispute_b_sql, ("lineitem", "orders")),
    "sites": (site_sql, ("nation",)),
    "merchants": (merchant_sql, ("nation",)),
    "refund": (refund_request_sql, ("orders",)),
    "binv": (billing_invoice_sql, ("lineitem", "orders")),
    "notes": (note_sql, ("orders",)),
    "ev": (event_txn_sql, ("events",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Fixture view as a DataFrame."""
    configure(spark)
    build, tables = _VIEWS[name]
    sql = build(_Spark)
    frames = {}
    for t in tables:
        frames[t] = table(spark, sf_dir, t)
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql.replace("VARCHAR(40)", "STRING").replace("VARCHAR(10)", "STRING"), **frames)


def duck_cte(*names: str) -> str:
    """The same views as the head of a DuckDB WITH clause."""
    return "WITH " + "\n, ".join(f"{n} AS ({_VIEWS[n][0](_Duck)})" for n in names)


SPARK, DUCK = _Spark, _Duck
