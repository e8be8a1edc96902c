"""The filter contract under one report of every family, and every dimension once."""

from __future__ import annotations

import datetime as dt

from checks import fixtures as fx
from checks import oracle_anomaly as orc
from checks import oracle_disputes as dis
from checks import oracle_gateway as gat
from checks import oracle_lifecycle as life
from checks.classify_queries import tables
from checks.dispute_queries import _all
from checks.fixtures import spark_view
from checks.gateway_queries import SINCE
from checks.lifecycle_queries import _history, plain
from checks.registry import register
from paylens.operators import disputes as dp
from paylens.operators import filters as fl
from paylens.operators.subscriptions import mrr
from paylens.plans import gateway_reports as gr
from paylens.plans import presets as pre


def _listed(values) -> str:
    return "(" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _view(name: str, condition: str) -> tuple[str, str]:
    """A fixture view's SQL, and the same under a condition."""
    sql = f"{name} AS ({fx._VIEWS[name][0](fx.DUCK)})"
    return sql, f"{name} AS (SELECT * FROM ({fx._VIEWS[name][0](fx.DUCK)}) v WHERE {condition})"


# ------------------------------------------------- every dimension once
DIMENSIONS = {
    "country_cd": ("US", "DE"),
    "gateway_cd": ("inkqcylsbc8b", "unmappedgw01"),
    "trans_type_desc": ("verify",),
    "trans_status_desc": ("success", "declined"),
    "failure_type": ("soft", "fraud"),
    "origin_desc": ("recurring", "token_api"),
}
for _name, _values in DIMENSIONS.items():
    register(
        f"filter_{_name}",
        lambda s, d, n=_name, v=_values: plain(fl.by_dimension(spark_view(s, d, "txn"), {n: v})),
        f"""{fx.duck_cte("txn")} SELECT trans_dt, count(*) AS txn_ct, CAST(sum(trans_amt) AS DOUBLE) AS trans_amt
FROM txn WHERE {_name} IN {_listed(_values)} GROUP BY 1""",
    )


def _plans(s, d):
    """The most frequent plan codes in order of their names: every other one."""
    subs = spark_view(s, d, "sub")
    codes = [r["plan_cd"] for r in fl.apply_filters(subs, fl.Filters()).select("plan_cd").distinct().collect()]
    return tuple(sorted(c for c in codes if c is not None)[::2])


register(
    "filter_plan_cd",
    lambda s, d: plain(fl.by_dimension(spark_view(s, d, "att"), {"plan_cd": _plans(s, d)}, spark_view(s, d, "sub"))),
    f"""{fx.duck_cte("att", "sub")}
, codes AS (SELECT plan_cd, row_number() OVER (ORDER BY plan_cd) AS n FROM (SELECT DISTINCT plan_cd FROM sub WHERE plan_cd IS NOT NULL))
SELECT trans_dt, count(*) AS txn_ct, CAST(sum(trans_amt) AS DOUBLE) AS trans_amt FROM att
WHERE (src_system_id, account_cd, subscription_guid) IN (
    SELECT (src_system_id, account_cd, subscription_guid) FROM sub WHERE plan_cd IN (SELECT plan_cd FROM codes WHERE n % 2 = 1))
GROUP BY 1""",
)

# ------------------------------------------------- anomaly
_AS_OF = dt.date(2026, 1, 28)
_ANOMALY = fl.Filters(country_cd=("US", "CA", "DE"), card_brand_nm=("visa", "mastercard"), failure_type=("soft", "hard"))
_TUNE = {"z": 1.0, "min_current": 1}
register(
    "anomaly_dashboard_filtered",
    lambda s, d: pre.PRESETS["dashboard_bin"].run(fl.filtered_attempts(spark_view(s, d, "txn"), _ANOMALY), _AS_OF, tune=_TUNE),
    orc.preset_sql(
        pre.PRESETS["dashboard_bin"],
        _AS_OF,
        _TUNE,
        extra=" AND country_cd IN ('US', 'CA', 'DE') AND card_brand_nm IN ('visa', 'mastercard') AND failure_type IN ('soft', 'hard')",
    ),
)

# ------------------------------------------------- lifecycle
_LIFE = fl.Filters(date_start=dt.date(2023, 1, 1), src_system_id=(115, 134), plan_tier=("annual", "monthly"))
_DAY = dt.date(2025, 10, 1)
register(
    "mrr_filtered",
    lambda s, d: plain(mrr(fl.filtered_history(_history(s, d), _LIFE), _DAY)),
    f"""{life.view("sub")}{life.sub_ctes()}
SELECT src_system_id, plan_dur, count(*) AS active_subs
     , CAST(round(sum(CASE WHEN plan_dur = 'annual' THEN total_recur_amt / 12 ELSE total_recur_amt END), 2) AS DOUBLE) AS mrr
FROM hist WHERE CAST(activate_dt_ut AS DATE) <= DATE '{_DAY}' AND CAST(expiration_dt_ut AS DATE) > DATE '{_DAY}'
  AND CAST(activate_dt_ut AS DATE) >= DATE '2023-01-01' AND src_system_id IN (115, 134) AND plan_dur IN ('annual', 'monthly')
GROUP BY 1, 2""",
)

# ------------------------------------------------- gateway
_GATEWAY = fl.Filters(
    date_start=dt.date(2024, 8, 1), src_system_id=(115, 139), gateway_region=("US", "UK", "CA", "unmappedgw01"), trans_status_desc=("success", "declined")
)
_MARKETS = f"src_system_id IN (115, 139) AND trans_dt >= DATE '2024-08-01' AND trans_status_desc IN ('success', 'declined') AND {orc.market_case()} IN ('US', 'UK', 'CA', 'unmappedgw01')"


def _gateway_sql() -> str:
    sql = gat.comparison_sql()
    for name, condition in (("att", _MARKETS), ("sub", "src_system_id IN (115, 139)"), ("adj", "src_system_id IN (115, 139)")):
        whole, part = _view(name, condition)
        if whole not in sql:
            raise ValueError(f"the report does not read {name}")
        sql = sql.replace(whole, part)
    return sql


register(
    "gateway_comparison_filtered",
    lambda s, d: gr.comparison(fl.filtered_tables(tables(s, d), _GATEWAY), SINCE, life.AS_OF),
    _gateway_sql(),
)

# ------------------------------------------------- disputes
_DISPUTES = fl.Filters(date_start=dt.date(2022, 9, 1), date_end=dt.date(2024, 6, 30))
_RANGE = "BETWEEN DATE '2022-09-01' AND DATE '2024-06-30'"
register(
    "dispute_rate_filtered",
    lambda s, d: dp.dispute_rate(
        fl.filtered_disputes(_all(s, d), _DISPUTES), fl.filtered_attempts(spark_view(s, d, "att"), _DISPUTES)
    ),
    dis.rate_sql().replace("FROM allcb GROUP", f"FROM allcb WHERE txn_date {_RANGE} GROUP").replace("FROM att GROUP", f"FROM att WHERE trans_dt {_RANGE} GROUP"),
)
