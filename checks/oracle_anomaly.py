"""Anomaly oracles: the textbook formulation in SQL.

Distinct counts are computed as such, baselines by joining daily volumes to a
calendar, dense reports over an explicit grid of keys and days. None of the
library's rewrites are used here.
"""

from __future__ import annotations

import datetime as dt

from checks import fixtures as fx
from paylens.functions import fixed_values as fv
from paylens.operators import activity as act
from paylens.operators.anomaly import AnomalySpec
from paylens.operators.calendar import RunWindow, add_months
from paylens.operators.fixed_baseline import FixedPeriod


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def dates(values) -> str:
    return ", ".join(f"DATE '{v}'" for v in values)


def market_case(col: str = "gateway_cd") -> str:
    arms = " ".join(
        f"WHEN {col} IN ({quoted(codes)}) THEN '{region}'"
        for region, codes in fv.GATEWAYS_BY_MARKET.items()
    )
    return f"CASE {arms} ELSE {col} END"


def half_up(num: str, den: str) -> str:
    """Integer quotient, half away from zero."""
    return (
        f"CAST(sign({num}) * ((2 * abs(CAST({num} AS HUGEINT)) + nullif({den}, 0)) "
        f"// (2 * nullif({den}, 0))) AS BIGINT)"
    )


def round_ratio(num: str, den: str, digits: int) -> str:
    return f"({half_up(f'(({num}) * {10**digits})', den)} / {10**digits}.0::DOUBLE)"


def stddev(n: str, s: str, ss: str) -> str:
    return (
        f"CASE WHEN {n} > 1 THEN sqrt(CAST(CAST({ss} AS HUGEINT) * {n} - CAST({s} AS HUGEINT) * {s} AS DOUBLE)"
        f" / CAST({n} * ({n} - 1) AS DOUBLE)) END"
    )


def to_long(x: str) -> str:
    return f"CAST(round({x}) AS BIGINT)"


_COND = {
    act.TOTAL: "TRUE",
    act.SUCCESS: "trans_status_desc IN ('success', 'void')",
    act.DECLINE: "trans_status_desc = 'declined'",
    act.AVS_FAIL: "trans_status_desc IN ('success', 'void') AND avs_result_cd NOT IN ('Y', 'X', 'V')",
}


def scope_where(spec_origins, start, end, method=True, avs_not_passed=False) -> str:
    parts = [
        "trans_type_desc IN ('purchase', 'verify')",
        "trans_status_desc IN ('success', 'void', 'declined')",
    ]
    if start:
        parts.append(f"trans_dt >= DATE '{start}'")
    if end:
        parts.append(f"trans_dt <= DATE '{end}'")
    if spec_origins is not None:
        parts.append(f"origin_desc IN ({quoted(spec_origins)})")
    if method:
        parts.append("payment_method_desc = 'Credit Card'")
    if avs_not_passed:
        parts.append("coalesce(avs_result_cd, '') NOT IN ('Y', 'X', 'V')")
    return " AND ".join(parts)


def _head(spec: AnomalySpec, window: RunWindow, source_cte: str, scan: str, extra: str) -> str:
    start = spec.volume_start(window)
    where = scope_where(spec.origins, start, window.end, avs_not_passed=spec.avs_not_passed)
    if spec.excluded:
        where += f" AND trans_dt NOT IN ({dates(spec.excluded)})"
    market = f", {market_case()} AS gateway_country" if "gateway_country" in spec.keys else ""
    step = (
        f"{spec.lookback_days} DAY" if spec.lookback_days else f"{spec.lookback_months} MONTH"
    )
    weekday = "dayofweek(bd) = dayofweek(run_dt)" if spec.same_weekday else "TRUE"
    gone = f" AND bd NOT IN ({dates(spec.excluded)})" if spec.excluded else ""
    return f"""{source_cte}
, scoped AS (SELECT *{market} FROM {scan} WHERE {where}{extra})
, run_dates AS (
    SELECT CAST(unnest(generate_series(DATE '{window.start}', DATE '{window.end}', INTERVAL 1 DAY)) AS DATE) AS run_dt)
, lookback AS (
    SELECT run_dt, CAST(unnest(generate_series(CAST(run_dt - INTERVAL {step} AS DATE), run_dt - 1, INTERVAL 1 DAY)) AS DATE) AS bd
    FROM run_dates)
, base AS (SELECT * FROM lookback WHERE {weekday}{gone})"""


def _examples(spec: AnomalySpec) -> list[str]:
    return [
        f"{agg}(CASE WHEN {_COND[m]} THEN account_cd END) AS {act.EXAMPLE_STEMS[m]}_ex{i}"
        for m in spec.examples
        for i, agg in ((1, "min"), (2, "max"))
    ]


def _daily(spec: AnomalySpec) -> str:
    k = ", ".join(spec.all_keys)
    cts = [
        f"count(DISTINCT CASE WHEN {_COND[m]} THEN {spec.unit} END) AS {m}_ct" for m in spec.metrics
    ]
    body = f"""
, daily AS (
    SELECT {k}, trans_dt, {', '.join(cts + _examples(spec))}
    FROM scoped GROUP BY {k}, trans_dt)"""
    if spec.share:
        seg = ", ".join(spec.segment)
        tots = [
            f"count(DISTINCT CASE WHEN {_COND[m]} THEN {spec.unit} END) AS {m}_tot"
            for m in spec.metrics
        ]
        body += f"""
, totals AS (SELECT {seg}, trans_dt, {', '.join(tots)} FROM scoped GROUP BY {seg}, trans_dt)"""
    return body


def _grid(spec: AnomalySpec) -> str:
    k = ", ".join(spec.all_keys)
    cts = ", ".join(f"coalesce({m}_ct, 0) AS {m}_ct" for m in spec.metrics)
    return f"""
, grid AS (
    SELECT {k}, dt AS trans_dt FROM (SELECT DISTINCT {k} FROM scoped)
    CROSS JOIN (SELECT run_dt AS dt FROM base UNION SELECT bd FROM base))
, filled AS (
    SELECT {k}, trans_dt, {cts} FROM grid LEFT JOIN daily USING ({k}, trans_dt))"""


def _counts(spec: AnomalySpec) -> str:
    k = ", ".join(spec.all_keys)
    on = " AND ".join(
        f"c.{x} IS NOT DISTINCT FROM b.{x}" if x in spec.null_safe_keys else f"c.{x} = b.{x}"
        for x in spec.all_keys
    )
    vol = "filled" if spec.dense else "daily"
    moments = ", ".join(
        f"count({m}_ct) AS {m}_n, sum({m}_ct) AS {m}_s, sum({m}_ct * {m}_ct) AS {m}_ss"
        for m in spec.metrics
    )
    stats = ", ".join(
        f"{half_up(f'{m}_s', f'{m}_n')} AS {m}_avg, "
        f"{to_long(stddev(f'{m}_n', f'{m}_s', f'{m}_ss'))} AS {m}_std"
        for m in spec.metrics
    )
    scores = ", ".join(
        f"{m}_ct - {m}_avg AS {m}_diff, "
        f"{round_ratio(f'{m}_ct - {m}_avg', f'{m}_std', spec.score_digits)} AS {m}_score, "
        f"CAST({m}_ct - {m}_avg AS DOUBLE) / nullif({m}_std, 0) AS {m}_z"
        for m in spec.metrics
    )
    return f"""
{_grid(spec) if spec.dense else ''}
, moments AS (
    SELECT {', '.join('v.' + x for x in spec.all_keys)}, run_dt, {moments}
    FROM base JOIN {vol} v ON bd = v.trans_dt GROUP BY ALL)
, stats AS (SELECT {k}, run_dt, {stats} FROM moments)
, scored AS (
    SELECT c.*, b.* EXCLUDE ({k}, run_dt), {scores}
    FROM {vol} c JOIN stats b ON {on} AND c.trans_dt = b.run_dt
    WHERE c.trans_dt BETWEEN (SELECT min(run_dt) FROM run_dates) AND (SELECT max(run_dt) FROM run_dates))"""


def _shares(spec: AnomalySpec) -> str:
    k = ", ".join(spec.all_keys)
    seg = ", ".join(spec.segment)
    vol = "filled" if spec.dense else "daily"
    base10 = 10**spec.baseline_digits

    def unit(m):
        return spec.scale * 10 ** spec.digits.get(m, spec.baseline_digits)

    def step(m):
        return 10 ** (spec.digits.get(m, spec.baseline_digits) - spec.baseline_digits)

    qs = ", ".join(f"{half_up(f'({m}_ct * {unit(m)})', f'{m}_tot')} AS {m}_q" for m in spec.metrics)
    moments = ", ".join(
        f"count({m}_q) AS {m}_n, sum({m}_q) AS {m}_s, sum(CAST({m}_q AS HUGEINT) * {m}_q) AS {m}_ss, "
        f"{half_up(f'sum({m}_ct)', 'count(*)')} AS {m}_ct_avg, "
        f"{half_up(f'sum({m}_tot)', 'count(*)')} AS {m}_tot_avg, max({m}_tot) AS {m}_tot_max"
        for m in spec.metrics
    )
    stats = ", ".join(
        f"{half_up(f'{m}_s', f'({m}_n * {step(m)})')} AS {m}_q_avg, "
        f"{to_long(stddev(f'{m}_n', f'{m}_s', f'{m}_ss') + f' / {step(m)}.0')} AS {m}_q_std, "
        f"{m}_ct_avg, {m}_tot_avg, {m}_tot_max"
        for m in spec.metrics
    )
    scores = ", ".join(
        f"{m}_q / {10**spec.digits.get(m, spec.baseline_digits)}.0::DOUBLE AS {m}_rate, "
        f"{m}_q_avg / {base10}.0::DOUBLE AS {m}_avg, {m}_q_std / {base10}.0::DOUBLE AS {m}_std, "
        f"{half_up(f'({m}_q - {m}_q_avg * {step(m)})', str(step(m)))} AS {m}_diff_q, "
        f"{half_up(f'({m}_q - {m}_q_avg * {step(m)})', str(step(m)))} / {base10}.0::DOUBLE AS {m}_diff, "
        f"{round_ratio(f'{m}_q - {m}_q_avg * {step(m)}', f'({m}_q_std * {step(m)})', spec.score_digits)} AS {m}_score, "
        f"CAST({m}_q - {m}_q_avg * {step(m)} AS DOUBLE) / nullif({m}_q_std * {step(m)}, 0) AS {m}_z"
        for m in spec.metrics
    )
    on = " AND ".join(f"c.{x} = b.{x}" for x in spec.all_keys)
    return f"""
{_grid(spec) if spec.dense else ''}
, rates AS (
    SELECT v.*, t.* EXCLUDE ({seg}, trans_dt), {qs}
    FROM {vol} v JOIN totals t USING ({seg}, trans_dt))
, moments AS (
    SELECT {', '.join('v.' + x for x in spec.all_keys)}, run_dt, {moments}
    FROM base JOIN rates v ON bd = v.trans_dt GROUP BY ALL)
, stats AS (SELECT {k}, run_dt, {stats} FROM moments)
, scored AS (
    SELECT c.*, b.* EXCLUDE ({k}, run_dt), {scores}
    FROM rates c JOIN stats b ON {on} AND c.trans_dt = b.run_dt
    WHERE c.trans_dt BETWEEN (SELECT min(run_dt) FROM run_dates) AND (SELECT max(run_dt) FROM run_dates))"""


def scored_sql(
    spec: AnomalySpec,
    window: RunWindow,
    source_cte: str | None = None,
    scan: str = "txn",
    extra: str = "",
) -> str:
    flags = []
    for m in spec.metrics:
        if spec.flag_on_rounded:
            flags.append(
                f"CASE WHEN abs({m}_score) >= {spec.z} THEN CASE WHEN {m}_score > 0 THEN 'large_increase' "
                f"WHEN {m}_score < 0 THEN 'large_decrease' END END AS {m}_flag"
            )
        else:
            flags.append(
                f"CASE WHEN {m}_z >= {spec.z} THEN 'large_increase' "
                f"WHEN {m}_z <= -{spec.z} THEN 'large_decrease' END AS {m}_flag"
            )
    gates = ["TRUE"]
    first = spec.metrics[0]
    if spec.min_baseline is not None:
        gates.append(f"{first}_ct_avg >= {spec.min_baseline}" if spec.share else f"{first}_avg >= {spec.min_baseline}")
    if spec.min_current is not None:
        gates.append(f"{first}_ct >= {spec.min_current}")
    return (
        _head(spec, window, source_cte or fx.duck_cte("txn"), scan, extra)
        + _daily(spec)
        + (_shares(spec) if spec.share else _counts(spec))
        + f"""
, final AS (SELECT *, {', '.join(flags)} FROM scored WHERE {' AND '.join(gates)})"""
    )


def _any(spec: AnomalySpec) -> str:
    return "(" + " OR ".join(f"{m}_flag IS NOT NULL" for m in spec.triggers or spec.metrics) + ")"


def _p(m: str) -> str:
    return "" if m == act.TOTAL else f"{m}_"


def _bi(as_of: dt.date | None, months: int | None) -> str:
    if not months:
        return ""
    return f", DATE '{as_of}' AS tableau_end_dt, DATE '{add_months(as_of, -months)}' AS tableau_start_dt"


def wide_counts(spec, period="daily", bi="") -> str:
    cols = [*spec.all_keys, "trans_dt"]
    for m in spec.metrics:
        p = _p(m)
        cols += [
            f"{m}_avg AS baseline_{p}avg_ct", f"{m}_std AS baseline_{p}stddev_ct",
            f"{m}_ct AS {period}_{p}ct", f"{m}_diff AS {p or 'vol_'}diff",
            f"{m}_score AS {p or 'vol_'}z_score", f"{m}_flag AS {p}chg_flag",
        ]
    cols += act.example_columns(spec.examples)
    return f"\nSELECT {', '.join(cols)}{bi} FROM final WHERE {_any(spec)}"


def wide_share(spec) -> str:
    m = spec.metrics[0]
    return f"""
SELECT src_system_id, trans_dt, {', '.join(spec.keys)}, {m}_ct AS daily_bin_ct, {m}_tot AS daily_total_ct
     , {m}_rate AS daily_rate_pct, {m}_ct_avg AS baseline_bin_ct, {m}_tot_avg AS baseline_total_ct
     , {m}_avg AS baseline_avg_rate_pct, {m}_std AS baseline_stddev_rate_pct, {m}_diff AS rate_diff_pct
     , {m}_score AS rate_z_score, {m}_flag AS rate_chg_flag
FROM final WHERE {_any(spec)}"""


def wide_share_metrics(spec, bi="") -> str:
    cols = [*spec.all_keys, "trans_dt"]
    for m in spec.metrics:
        tail, head = ("", "") if m == act.TOTAL else (f"_{m}", f"{m}_")
        cols += [
            f"{m}_avg AS baseline_avg_pct{tail}", f"{m}_std AS baseline_stddev_pct{tail}",
            f"{m}_rate AS current_pct_of_total{tail}", f"{m}_score AS {head}pct_z_score",
            f"{m}_flag AS {head}pct_chg_flag", f"{m}_ct AS daily_{head}ct",
        ]
    t = spec.metrics[0]
    cols += [
        f"{t}_diff_q / {10 ** (spec.baseline_digits - 2)}.0::DOUBLE AS pct_point_diff",
        f"{t}_ct_avg AS baseline_avg_ct", f"{t}_tot AS daily_total_ct",
        *act.example_columns(spec.examples),
    ]
    return f"\nSELECT {', '.join(cols)}{bi} FROM final WHERE {_any(spec)}"


def stacked(spec, bi="", share=False, before=None) -> str:
    parts = []
    for m in spec.metrics:
        kind = "total_volume" if m == act.TOTAL else m
        if share:
            cols = (
                f"{m}_tot_max AS daily_total_ct, {m}_ct_avg AS baseline_avg_ct, {m}_avg AS baseline_avg_rate"
                f", {m}_std AS baseline_rate_stddev, {m}_ct AS daily_bin_ct, {m}_rate AS daily_bin_rate"
                f", {m}_diff AS rate_diff, {m}_score AS vol_z_score"
            )
        else:
            cols = (
                f"{m}_avg AS baseline_avg_ct, {m}_std AS baseline_stddev_ct, {m}_ct AS daily_ct"
                f", {m}_diff AS vol_diff, {m}_score AS vol_z_score"
            )
        parts.append(
            f"SELECT {', '.join(spec.all_keys)}, trans_dt, '{kind}' AS flag_type, {cols}"
            f", {m}_flag AS chg_flag{bi} FROM final WHERE {m}_flag IS NOT NULL"
        )
    where = f" WHERE trans_dt < DATE '{before}'" if before else ""
    return f"\nSELECT * FROM ({' UNION ALL '.join(parts)}) u{where}"


def dashboard(spec, top=None) -> str:
    m = spec.metrics[0]
    return f"""
SELECT src_system_id, trans_dt AS run_dt, {', '.join(spec.keys)}, {m}_rate AS rate_pct, {m}_avg AS baseline_avg
     , {m}_score AS z_score, ({m}_z >= {spec.z} OR {m}_z <= -{spec.z}) AS flagged
FROM final
ORDER BY run_dt DESC, z_score DESC NULLS LAST, src_system_id, {', '.join(spec.keys)}{f' LIMIT {top}' if top else ''}"""


def preset_sql(preset, as_of: dt.date, tune=None, window=None, source_cte=None, extra="") -> str:
    """Oracle of a preset run, by the shape it uses."""
    spec = preset.spec.with_(**(tune or {}))
    window = window or preset.window(as_of)
    head = scored_sql(spec, window, source_cte=source_cte, extra=extra)
    bi = _bi(as_of, preset.bi_months)
    name = preset.shape.__name__
    if name == "wide_counts":
        return head + wide_counts(spec, bi=bi)
    if name == "wide_share":
        return head + wide_share(spec)
    if name == "wide_share_metrics":
        return head + wide_share_metrics(spec, bi=bi)
    if name == "dashboard_panel":
        return head + dashboard(spec)
    before = as_of if preset.drop_today else None
    return head + stacked(spec, bi=bi, share=name == "stacked_shares", before=before)


def _fixed_head(period: FixedPeriod, bins) -> str:
    where = scope_where(fv.API_ORIGINS, period.baseline_start, period.end, method=False)
    return f"""{fx.duck_cte('txn')}
, scoped AS (SELECT * FROM txn WHERE {where} AND cc_first_6_nbr IN ({quoted(bins)}))
, daily AS (
    SELECT src_system_id, cc_first_6_nbr, trans_dt, count(DISTINCT transaction_guid) AS daily_ct
         , count(DISTINCT CASE WHEN trans_status_desc IN ('success', 'void') THEN transaction_guid END) AS daily_success_ct
    FROM scoped GROUP BY ALL)"""


def _flag(x: str, t: float) -> str:
    return f"CASE WHEN {x} >= {t} THEN 'large_increase' WHEN {x} <= -{t} THEN 'large_decrease' END"


def percent_change_sql(period: FixedPeriod, bins, threshold=0.5) -> str:
    d = period.baseline_days
    return f"""{_fixed_head(period, bins)}
, base AS (
    SELECT src_system_id, cc_first_6_nbr, count(DISTINCT transaction_guid) AS n
         , count(DISTINCT CASE WHEN trans_status_desc IN ('success', 'void') THEN transaction_guid END) AS ns
    FROM scoped WHERE trans_dt <= DATE '{period.baseline_end}' GROUP BY ALL)
, j AS (
    SELECT daily.*, n AS baseline_tot_ct, {half_up('n', str(d))} AS baseline_avg_ct
         , {half_up('ns', str(d))} AS baseline_success_avg_ct
    FROM daily JOIN base USING (src_system_id, cc_first_6_nbr) WHERE trans_dt > DATE '{period.baseline_end}')
SELECT * FROM (
  SELECT *, daily_ct - baseline_avg_ct AS vol_diff, daily_success_ct - baseline_success_avg_ct AS success_diff
     , {round_ratio('(daily_ct - baseline_avg_ct) * 100', 'baseline_avg_ct', 2)} AS pct_change
     , {round_ratio('(daily_success_ct - baseline_success_avg_ct) * 100', 'baseline_success_avg_ct', 2)} AS success_pct_chg
     , {_flag('((daily_ct - baseline_avg_ct) / nullif(baseline_avg_ct, 0))', threshold)} AS chg_flag
     , {_flag('((daily_success_ct - baseline_success_avg_ct) / nullif(baseline_success_avg_ct, 0))', threshold)} AS success_chg_flag
  FROM j) WHERE chg_flag IS NOT NULL OR success_chg_flag IS NOT NULL"""


def fixed_zscore_sql(period: FixedPeriod, bins, z=2.0) -> str:
    return f"""{_fixed_head(period, bins)}
, base AS (
    SELECT src_system_id, cc_first_6_nbr, count(*) AS n, sum(daily_ct) AS s, sum(daily_ct * daily_ct) AS ss
         , sum(daily_success_ct) AS s2, sum(daily_success_ct * daily_success_ct) AS ss2
    FROM daily WHERE trans_dt <= DATE '{period.baseline_end}' GROUP BY ALL)
, st AS (
    SELECT src_system_id, cc_first_6_nbr, {half_up('s', 'n')} AS baseline_avg_ct, {stddev('n', 's', 'ss')} AS baseline_stddev_ct
         , {half_up('s2', 'n')} AS baseline_success_avg_ct, {stddev('n', 's2', 'ss2')} AS baseline_success_stddev_ct
    FROM base)
, j AS (
    SELECT *, daily_ct - baseline_avg_ct AS vol_diff, daily_success_ct - baseline_success_avg_ct AS success_diff
         , (daily_ct - baseline_avg_ct) / nullif(baseline_stddev_ct, 0) AS zz
         , (daily_success_ct - baseline_success_avg_ct) / nullif(baseline_success_stddev_ct, 0) AS zs
    FROM daily JOIN st USING (src_system_id, cc_first_6_nbr) WHERE trans_dt > DATE '{period.baseline_end}')
SELECT * FROM (
  SELECT * EXCLUDE (zz, zs), round(zz, 2) AS vol_z_score, round(zs, 2) AS success_z_score
     , {_flag('zz', z)} AS chg_flag, {_flag('zs', z)} AS success_chg_flag
  FROM j) WHERE chg_flag IS NOT NULL OR success_chg_flag IS NOT NULL"""
