"""Gateway performance oracles.

An account's subscriptions are one ordered list; an attempt finds its own
subscription and its activation window by filtering that list. Categories are
tables of rules of which the first that holds counts.
"""

from __future__ import annotations

from checks import oracle_lifecycle as life
from checks.oracle_anomaly import round_ratio

SINCE = "2024-06-01"
SINCE_LESS_MONTH = "2024-05-01"
_ACCOUNT = "src_system_id, account_cd"
_OK = "trans_status_desc IN ('success', 'void')"
_BUY, _VERIFY = "trans_type_desc = 'purchase'", "trans_type_desc = 'verify'"
_TEN = "to_minutes(10)"


def lives(rows: str) -> str:
    """Each account's subscriptions in order of activation."""
    return f"""
, lives AS (SELECT {_ACCOUNT}, list(x ORDER BY activate_dt_ut, subscription_guid) AS lived FROM {rows} x GROUP BY {_ACCOUNT})"""


def own(of: str) -> str:
    """The account's subscription that a row of `of` names."""
    return f"list_filter(lived, lambda x: x.subscription_guid = {of}.subscription_guid)[1]"


def invoice_rules(change_first: bool) -> tuple:
    """Needs s, the invoice's subscription, and `changed`."""
    renewal, direct = "invoice_type_cd = 'renewal'", "s IS NOT NULL AND s.trial_end_dt_ut IS NULL"
    rules = (
        ("trial_to_paid", f"{renewal} AND renewal_earliest_inv = 1 AND adj_total_amt > 0 AND invoice_billed_dt_ut BETWEEN s.pre_trial_end AND s.post_trial_end"),
        ("direct_to_paid", f"{renewal} AND {direct} AND CAST(invoice_billed_dt_ut AS DATE) < {life.CHANGE} AND abs(epoch_us(invoice_billed_dt_ut) - epoch_us(s.activate_dt_ut)) <= 600000000"),
        ("direct_to_paid", f"invoice_type_cd = 'purchase' AND {direct} AND invoice_billed_dt_ut BETWEEN s.pre_activate AND s.post_activate"),
        ("recurring", f"{renewal} AND renewal_earliest_inv > 1"),
    )
    change = (("change_sub", "changed"),)
    return (*change, *rules) if change_first else (*rules, *change)


def attempt_rules(kind: str) -> tuple:
    """Needs w, the subscription whose activation window holds the attempt, s, its own, and i, its invoice."""
    api, no_trial = "origin_desc IN ('token_api', 'api')", "s.trial_end_dt_ut IS NULL"
    after = f"CAST(trans_dt_ut AS DATE) >= {life.CHANGE}"
    no_renewal = "(invoice_guid IS NULL OR i.invoice_type_cd <> 'renewal')"
    first = f"{_BUY} AND i.invoice_type_cd = 'renewal'"
    by_kind = {
        "window": (("direct_to_paid", f"{_BUY} AND {api} AND {no_trial} AND {no_renewal} AND {after} AND trans_dt_ut BETWEEN s.prior_expiration AND s.post_activate"),),
        "band": (
            ("direct_to_paid", f"{_BUY} AND {_OK} AND {no_trial} AND i.invoice_type_cd = 'purchase' AND {after} AND trans_dt_ut BETWEEN s.pre_activate AND s.post_activate"),
            ("direct_to_paid", f"{_BUY} AND trans_status_desc = 'declined' AND {api} AND {no_renewal} AND w IS NOT NULL"),
        ),
    }
    return (
        ("change_sub", f"{_BUY} AND origin_desc = 'api_sub_change'"),
        ("trial_verify", f"{_VERIFY} AND {_OK} AND w.trial_end_dt_ut IS NOT NULL AND trans_dt_ut BETWEEN w.pre_activate AND w.post_activate"),
        ("trial_verify", f"{_VERIFY} AND trans_status_desc = 'declined' AND w IS NOT NULL"),
        ("trial_to_paid", f"{first} AND i.renewal_earliest_inv = 1 AND i.invoice_billed_dt_ut BETWEEN s.pre_trial_end AND s.post_trial_end"),
        (
            "direct_to_paid",
            f"{first} AND {no_trial} AND CAST(ifnull(i.invoice_billed_dt_ut, trans_dt_ut) AS DATE) < {life.CHANGE}"
            f" AND i.invoice_billed_dt_ut >= s.activate_dt_ut - {_TEN} AND i.invoice_billed_dt_ut <= s.activate_dt_ut + {_TEN}",
        ),
        *by_kind[kind],
        ("recurring", f"{first} AND i.renewal_earliest_inv > 1"),
        ("other_verify", _VERIFY),
    )


def base_ctes(rules: str, change_first: bool, invoice_since: str) -> str:
    stamp = "'%Y-%m-%d %H:%M:%S+00'"
    return (
        life.view("sub", "att", "adj")
        + life.sub_ctes()
        + life.adj_ctes(invoice_since)
        + lives("hist")
        + f"""
, seen AS (
    SELECT * REPLACE (nullif(trim(subscription_guid), '') AS subscription_guid, nullif(trim(invoice_guid), '') AS invoice_guid)
    FROM att WHERE list_contains(['success', 'void', 'declined'], trans_status_desc))
, changed AS (
    SELECT {_ACCOUNT}, list(DISTINCT invoice_guid) AS changes FROM seen
    WHERE {_BUY} AND origin_desc = 'api_sub_change' AND invoice_guid IS NOT NULL GROUP BY ALL)
, cat AS (
    SELECT * EXCLUDE (s, changed), {life.first_rule(invoice_rules(change_first), "'other'")} AS invoice_category
    FROM (SELECT inv.*, {own("inv")} AS s, ifnull(list_contains(changes, invoice_guid), FALSE) AS changed
          FROM inv LEFT JOIN lives USING ({_ACCOUNT}) LEFT JOIN changed USING ({_ACCOUNT})))
, tx AS (SELECT * FROM seen WHERE trans_dt >= DATE '{SINCE}' AND list_contains(['purchase', 'verify'], trans_type_desc))
, found AS (
    SELECT tx.*, cat AS i, {own("tx")} AS s
         , list_filter(lived, lambda x: trans_dt_ut BETWEEN x.prior_expiration AND x.post_activate)[1] AS w
    FROM tx LEFT JOIN lives USING ({_ACCOUNT}) LEFT JOIN cat USING ({_ACCOUNT}, invoice_guid))
, base AS (
    SELECT * EXCLUDE (i, s, w), i.invoice_category AS invoice_category, i.invoice_state_desc AS invoice_state_desc, w.subscription_guid AS w_guid
         , {life.first_rule(attempt_rules(rules), "'other'")} AS transaction_category
         , ifnull(invoice_guid, concat_ws('_', 'window', src_system_id, account_cd
                , strftime(ifnull(w.prior_expiration, {life.NONE}), {stamp}), strftime(ifnull(w.activate_dt_ut, {life.OPEN}), {stamp}))) AS invoice_grouper
    FROM found)"""
    )


def metric_ctes(base: str, paid_counts: bool) -> str:
    won = f"{_OK} OR invoice_state_desc = 'paid'" if paid_counts else _OK
    place = "trans_gateway_type_desc, cc_first_6_nbr"
    examples = ", ".join(f"{f}({{0}}) AS example_{{1}}_{f}, {f}(account_cd) AS example_account_{f}" for f in ("min", "max"))
    return f"""
, tm AS (
    SELECT {place}, trans_dt AS dt, transaction_category AS category, count(*) AS total_transactions, count_if({_OK}) AS successful_transactions
         , {examples.format("transaction_guid", "transaction")}
    FROM {base} GROUP BY ALL)
, settled AS (
    SELECT {_ACCOUNT}, invoice_guid, bool_or(ifnull({won}, FALSE)) AS won, list(DISTINCT struct_pack(gateway := trans_gateway_type_desc, bin := cc_first_6_nbr)) AS places
    FROM {base} WHERE invoice_guid IS NOT NULL GROUP BY ALL)
, billed_once AS (SELECT DISTINCT {_ACCOUNT}, invoice_guid, CAST(invoice_billed_dt_ut AS DATE) AS dt, invoice_category AS category, invoice_billed_dt_ut FROM cat)
, real_facts AS (
    SELECT dt, category, won, invoice_guid AS example, account_cd, unnest(places) AS place FROM billed_once JOIN settled USING ({_ACCOUNT}, invoice_guid))
, checks AS (
    SELECT {place}, {_ACCOUNT}, invoice_grouper AS example, transaction_category AS category, min(trans_dt) AS dt, bool_or({_OK}) AS won
    FROM {base} WHERE invoice_guid IS NULL AND list_contains(['trial_verify', 'other_verify'], transaction_category) GROUP BY ALL)
, facts AS (
    SELECT place.gateway AS trans_gateway_type_desc, place.bin AS cc_first_6_nbr, dt, category, won, example, account_cd FROM real_facts
    UNION ALL SELECT {place}, dt, category, won, example, account_cd FROM checks)
, im AS (
    SELECT {place}, dt, category, count(*) AS total_invoices, count_if(won) AS successful_invoices, {examples.format("example", "invoice")}
    FROM facts GROUP BY ALL)"""


def day_cte(t: str = "tm", i: str = "im") -> str:
    zero = ", ".join(f"ifnull({x}_{u}, 0) AS {x}_{u}" for u in ("transactions", "invoices") for x in ("total", "successful"))
    return f"""
, days AS (
    SELECT dt, trans_gateway_type_desc, cc_first_6_nbr, category, {zero}
         , example_transaction_min, example_transaction_max, example_invoice_min, example_invoice_max
         , ifnull(t.example_account_min, i.example_account_min) AS example_account_min, ifnull(t.example_account_max, i.example_account_max) AS example_account_max
    FROM {t} t FULL JOIN {i} i USING (dt, trans_gateway_type_desc, cc_first_6_nbr, category))"""


def top_ctes(n: int) -> str:
    return f"""
, topb AS (
    SELECT cc_first_6_nbr FROM tx WHERE cc_first_6_nbr IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {n})"""


def comparison_sql() -> str:
    return (
        base_ctes("window", True, SINCE_LESS_MONTH)
        + metric_ctes("base", True)
        + day_cte()
        + f"""
, m AS (
    SELECT CAST(date_trunc('month', dt) AS DATE) AS mth, trans_gateway_type_desc, category
         , CAST(sum(successful_transactions) AS BIGINT) AS successful_transactions, CAST(sum(total_transactions) AS BIGINT) AS total_transactions
         , CAST(sum(successful_invoices) AS BIGINT) AS successful_invoices, CAST(sum(total_invoices) AS BIGINT) AS total_invoices
         , min(example_transaction_min) AS example_transaction_min, max(example_transaction_max) AS example_transaction_max
         , min(example_invoice_min) AS example_invoice_min, max(example_invoice_max) AS example_invoice_max
         , min(example_account_min) AS example_account_min, max(example_account_max) AS example_account_max
    FROM days WHERE dt >= DATE '{SINCE}' AND trans_gateway_type_desc IS NOT NULL GROUP BY 1, 2, 3)
SELECT *, {round_ratio('successful_transactions', 'total_transactions', 5)} AS txn_success_rate
     , {round_ratio('successful_invoices', 'total_invoices', 5)} AS inv_success_rate FROM m"""
    )


_GRAINS = """unnest([{'g': 'day', 'v': dt}, {'g': 'week', 'v': CAST(dt - CAST(dayofweek(dt) AS INTEGER) AS DATE)}
     , {'g': 'month', 'v': CAST(date_trunc('month', dt) AS DATE)}, {'g': 'quarter', 'v': CAST(date_trunc('quarter', dt) AS DATE)}])"""
_KEYS = "trans_gateway_type_desc, cc_first_6_nbr, category"
_RATES = (
    "CAST(successful_transactions AS DOUBLE) / nullif(total_transactions, 0) AS txn_success_rate, "
    "CAST(successful_invoices AS DOUBLE) / nullif(total_invoices, 0) AS inv_success_rate"
)


def _sums(*units: str) -> str:
    return ", ".join(f"CAST(sum({x}_{u}) AS BIGINT) AS {x}_{u}" for u in units for x in ("total", "successful"))


def grains_sql(top: int) -> str:
    return (
        base_ctes("window", True, SINCE_LESS_MONTH)
        + metric_ctes("base", False)
        + top_ctes(top)
        + """
, tt AS (SELECT * FROM tm SEMI JOIN topb USING (cc_first_6_nbr))
, ti AS (SELECT * FROM im SEMI JOIN topb USING (cc_first_6_nbr))"""
        + day_cte("tt", "ti")
        + f"""
, grained AS (SELECT *, {_GRAINS} AS grain FROM days)
, added AS (
    SELECT grain.g AS timeframe_type, grain.v AS timeframe_value, {_KEYS}, {_sums("transactions", "invoices")} FROM grained GROUP BY ALL)
SELECT *, {_RATES} FROM added WHERE timeframe_value >= DATE '{SINCE}' AND trans_gateway_type_desc IS NOT NULL"""
    )


def by_bin_sql(top: int) -> str:
    def level(name: str, table: str, unit: str) -> str:
        return f"SELECT '{name}' AS metric_level, grain.g AS timeframe_type, grain.v AS timeframe_value, {_KEYS}, {_sums(unit)} FROM (SELECT *, {_GRAINS} AS grain FROM {table}) GROUP BY ALL"

    return (
        base_ctes("band", False, SINCE)
        + top_ctes(top)
        + """
, tbase AS (SELECT * FROM base SEMI JOIN topb USING (cc_first_6_nbr))"""
        + metric_ctes("tbase", False)
        + f"""
SELECT *, {_RATES} FROM ({level("transaction", "tm", "transactions")} UNION ALL BY NAME {level("invoice", "im", "invoices")})"""
    )


def category_sql(rules: str) -> str:
    return (
        base_ctes(rules, True, SINCE_LESS_MONTH)
        + """
SELECT transaction_guid, transaction_category, invoice_category, invoice_grouper, w_guid AS sub_win_subscription_guid FROM base"""
    )
