"""Deviation of a key's daily volume, or share of volume, from its own history.

One engine serves every preset (see `paylens.plans.presets`):

    attempts -> daily activity -> running sums -> differences -> scores -> shape

The daily table is hash-partitioned by key alone. Running sums along each key's
days are read off at the two ends of a run date's lookback; a baseline is the
difference of the two readings (`paylens.operators.history`). Days, readings and
run dates of a key lie in one partition, so that nothing is shuffled again,
nothing is joined, and a daily row is never repeated for the run dates that look
back on it.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators import activity as act
from paylens.operators import calendar as cal
from paylens.operators.history import Lookback, between_readings
from paylens.sources.transactions import txn_scope

SOURCE = "src_system_id"


def _zero() -> Column:
    return F.lit(0).cast("long")


@dataclass(frozen=True)
class AnomalySpec:
    """What to count, over which history, and what deviates."""

    unit: str = "account_cd"
    keys: tuple[str, ...] = ("cc_first_6_nbr",)
    metrics: tuple[str, ...] = (act.TOTAL,)
    share: bool = False
    # days of the segment's total, for shares
    segment: tuple[str, ...] = (SOURCE,)
    scale: int = 1
    digits: Mapping[str, int] = field(default_factory=dict)
    baseline_digits: int = 5
    score_digits: int = 2
    same_weekday: bool = True
    lookback_months: int | None = 3
    lookback_days: int | None = None
    # months of volume kept before the run range; None = the lookback
    history_months: int | None = None
    # days without volume count as zero
    dense: bool = False
    null_safe_keys: frozenset[str] = frozenset()
    excluded: tuple[dt.date, ...] = ()
    origins: tuple[str, ...] | None = fv.API_ORIGINS
    avs_not_passed: bool = False
    examples: tuple[str, ...] = ()
    z: float = 3.0
    min_baseline: int | None = None
    min_current: int | None = None
    flag_on_rounded: bool = False
    # metrics whose flag makes a wide report keep the row; None = any of them
    triggers: tuple[str, ...] | None = None

    def with_(self, **changes) -> AnomalySpec:
        return replace(self, **changes)

    @property
    def all_keys(self) -> tuple[str, ...]:
        return (SOURCE, *self.keys)

    @property
    def lookback(self) -> Lookback:
        return Lookback(self.lookback_months, self.lookback_days, self.same_weekday, self.excluded)

    def volume_start(self, window: cal.RunWindow) -> dt.date:
        if self.history_months is not None:
            return cal.add_months(window.start, -self.history_months)
        if self.lookback_days:
            return window.start - dt.timedelta(days=self.lookback_days)
        return cal.add_months(window.start, -(self.lookback_months or 0))


def with_market(txn: DataFrame) -> DataFrame:
    return txn.withColumn("gateway_country", sem.market(F.col("gateway_cd")))


def daily_volume(
    txn: DataFrame, spec: AnomalySpec, window: cal.RunWindow, sources: Sequence[int] = ()
) -> DataFrame:
    """Scoped attempts reduced to daily activity, event days left out."""
    scoped = txn_scope(
        txn,
        spec.volume_start(window),
        window.end,
        sources=sources,
        origins=spec.origins,
        avs_not_passed=spec.avs_not_passed,
    )
    if spec.excluded:
        scoped = scoped.where(~F.col("trans_dt").isin(*spec.excluded))
    if "gateway_country" in spec.all_keys and "gateway_country" not in txn.columns:
        scoped = with_market(scoped)
    return act.activity(
        scoped,
        spec.all_keys,
        spec.unit,
        spec.metrics,
        segment=spec.segment if spec.share else (),
        examples=spec.examples,
    )


def _rate(metric: str, spec: AnomalySpec) -> Column:
    """Share of the segment as an integer number of 10**-digits units."""
    unit = spec.scale * 10 ** spec.digits.get(metric, spec.baseline_digits)
    return sem.div_half_up(
        F.col(f"{metric}_ct") * F.lit(unit).cast("long"), F.col(f"{metric}_tot")
    )


def _moments(value: Column, stem: str) -> dict[str, Column]:
    exact = value.cast("decimal(19,0)")
    return {
        f"{stem}_n": F.when(value.isNotNull(), 1).otherwise(0),
        f"{stem}_s": F.coalesce(value, _zero()),
        f"{stem}_ss": F.coalesce(exact * exact, F.lit(0).cast("decimal(38,0)")),
    }


def compare_to_history(
    daily: DataFrame, spec: AnomalySpec, window: cal.RunWindow
) -> DataFrame:
    """Per (keys, run date): current values and integer baseline moments.

    A key that is NULL matches nothing in the baseline unless declared
    null-safe, so such rows are dropped up front.
    """
    for key in spec.keys:
        if key not in spec.null_safe_keys:
            daily = daily.where(F.col(key).isNotNull())
    daily = daily.repartition(*spec.all_keys)
    summed: dict[str, Column] = {"days_seen": F.lit(1)}
    current: dict[str, Column] = {}
    if spec.share:
        daily = daily.withColumns({f"{m}_q": _rate(m, spec) for m in spec.metrics})
    for m in spec.metrics:
        count = F.col(f"{m}_ct")
        current[f"{m}_cur"] = count
        if spec.share:
            summed |= _moments(F.col(f"{m}_q"), f"{m}_q")
            summed[f"{m}_s"] = count
            current[f"{m}_q_cur"] = F.col(f"{m}_q")
        else:
            summed |= _moments(count, m)
    if spec.share:
        summed["tot_s"] = current["tot_cur"] = F.col(f"{spec.metrics[0]}_tot")
    current |= {c: F.col(c) for c in act.example_columns(spec.examples)}
    out = between_readings(daily, spec.all_keys, summed, current, window, spec.lookback, spec.dense)
    if spec.dense and not spec.share:
        out = out.join(F.broadcast(spec.lookback.spans(daily.sparkSession, window)), "run_dt")
    return out


def _segment_history(
    daily: DataFrame, spec: AnomalySpec, window: cal.RunWindow
) -> DataFrame:
    """Per (segment, run date): days with volume, needed to zero-fill shares.

    A segment's days, at most as many as the scan has, are one array, from which
    each run date takes its lookback: a maximum is no difference of two readings.
    """
    totals = [f"{m}_tot" for m in spec.metrics]
    per_day = daily.groupBy(*spec.segment, "trans_dt").agg(*[F.max(t).alias(t) for t in totals])
    days = per_day.groupBy(*spec.segment).agg(
        F.collect_list(F.struct("trans_dt", *totals)).alias("days")
    )
    run = F.col("run_dt")
    runs = days.withColumn("run_dt", F.explode(F.sequence(F.lit(window.start), F.lit(window.end))))
    runs = runs.withColumns(
        {
            "past": F.filter("days", lambda x: spec.lookback.covers(run, x["trans_dt"])),
            "now": F.get(F.filter("days", lambda x: x["trans_dt"] == run), 0),
        }
    )
    cols = [F.size("past").alias("seg_days"), F.col("now").isNotNull().cast("int").alias("seg_current")]
    for m, tot in zip(spec.metrics, totals, strict=True):
        past = F.col("past")[tot]
        cols += [
            F.size(F.filter(past, lambda v: v > 0)).alias(f"{m}_seg_n"),
            F.array_max(past).alias(f"{m}_seg_max"),
            F.col("now")[tot].alias(f"{m}_seg_cur"),
        ]
    return runs.select(*spec.segment, "run_dt", *cols)


def _hit(diff: Column, std: Column, spec: AnomalySpec) -> Column:
    """Is |diff / std| at or above the threshold? NULL without a deviation.

    Written as a comparison of products: the optimizer pushes the condition
    below the score columns, so only rows that deviate pay for those.
    """
    if not spec.flag_on_rounded:
        return F.when(std > 0, F.abs(diff) >= std * float(spec.z))
    # round(x, d) >= z  <=>  x * 10**d >= ceil(z * 10**d) - 1/2
    scale = 10**spec.score_digits
    bound = 2 * math.ceil(spec.z * scale) - 1
    return F.when(std > 0, F.abs(diff) * (2 * scale) >= std * bound)


def _direction(metric: str, diff: Column) -> Column:
    return F.when(
        F.col(f"{metric}_hit"),
        F.when(diff > 0, "large_increase").otherwise("large_decrease"),
    )


def _kept(spec: AnomalySpec, *more: str) -> list[Column]:
    """Columns carried next to the metrics; the rest is dropped early."""
    names = [*spec.all_keys, "run_dt", *act.example_columns(spec.examples), *more]
    return [F.col(c) for c in names]


def _score_counts(df: DataFrame, spec: AnomalySpec) -> DataFrame:
    """Counts: average and deviation are whole numbers."""
    stats = []
    for m in spec.metrics:
        n, s, ss = F.col(f"{m}_n"), F.col(f"{m}_s"), F.col(f"{m}_ss")
        if spec.dense:
            n, s, ss = F.col("span"), F.coalesce(s, _zero()), F.coalesce(ss, F.lit(0.0))
        stats += [
            F.coalesce(F.col(f"{m}_cur"), _zero()).alias(f"{m}_ct"),
            sem.mean_half_up(s, n).alias(f"{m}_avg"),
            sem.round_to_long(sem.sample_stddev(n, s, ss)).alias(f"{m}_std"),
        ]
    df = _gated(df.select(*_kept(spec), *stats), spec, f"{spec.metrics[0]}_avg")
    scores, flags = {}, {}
    for m in spec.metrics:
        diff, std = F.col(f"{m}_diff"), F.col(f"{m}_std")
        scores[f"{m}_score"] = sem.round_ratio(diff, std, spec.score_digits)
        scores[f"{m}_hit"] = _hit(diff, std, spec)
        flags[f"{m}_flag"] = _direction(m, diff)
    diffs = {f"{m}_diff": F.col(f"{m}_ct") - F.col(f"{m}_avg") for m in spec.metrics}
    return df.withColumns(diffs).withColumns(scores).withColumns(flags)


def _score_shares(df: DataFrame, spec: AnomalySpec) -> DataFrame:
    """Shares: rounded rates, averaged and compared as integers."""
    base = F.lit(float(10**spec.baseline_digits))
    stats = []
    steps = {
        m: 10 ** (spec.digits.get(m, spec.baseline_digits) - spec.baseline_digits)
        for m in spec.metrics
    }
    kept = ["tot_cur"]
    for m, step in steps.items():
        n, days = F.col(f"{m}_q_n"), F.col("days_seen")
        q_sum, q_sq, ct_sum = F.col(f"{m}_q_s"), F.col(f"{m}_q_ss"), F.col(f"{m}_s")
        rate = F.col(f"{m}_q_cur")
        if spec.dense:
            # days on which the segment, but not the key, had volume are zeros
            n, days = F.col(f"{m}_seg_n"), F.col("seg_days")
            q_sum, q_sq, ct_sum = (F.coalesce(c, _zero()) for c in (q_sum, q_sq, ct_sum))
            rate = F.when(F.col(f"{m}_seg_cur") > 0, F.coalesce(rate, _zero()))
            kept.append(f"{m}_seg_max")
        stats += [
            F.coalesce(F.col(f"{m}_cur"), _zero()).alias(f"{m}_ct"),
            sem.mean_half_up(ct_sum, days).alias(f"{m}_ct_avg"),
            rate.alias(f"{m}_q"),
            sem.mean_half_up(q_sum, n * F.lit(step).cast("long")).alias(f"{m}_q_avg"),
            sem.round_to_long(sem.sample_stddev(n, q_sum, q_sq) / F.lit(float(step))).alias(
                f"{m}_q_std"
            ),
        ]
    stats.append(sem.mean_half_up(F.col("tot_s"), F.col("days_seen")).alias("tot_avg"))
    df = _gated(df.select(*_kept(spec, *kept), *stats), spec, f"{spec.metrics[0]}_ct_avg")

    out = [*_kept(spec, "tot_avg", *kept)]
    flags = {}
    df = df.withColumns(
        {
            f"{m}_q_diff": F.col(f"{m}_q") - F.col(f"{m}_q_avg") * F.lit(step).cast("long")
            for m, step in steps.items()
        }
    )
    for m, step in steps.items():
        fine = F.lit(float(10 ** spec.digits.get(m, spec.baseline_digits)))
        diff, spread = F.col(f"{m}_q_diff"), F.col(f"{m}_q_std") * F.lit(step).cast("long")
        out += [
            F.col(f"{m}_ct"),
            F.col(f"{m}_ct_avg"),
            (F.col(f"{m}_q") / fine).alias(f"{m}_rate"),
            (F.col(f"{m}_q_avg") / base).alias(f"{m}_avg"),
            (F.col(f"{m}_q_std") / base).alias(f"{m}_std"),
            (sem.div_half_up(diff, F.lit(step).cast("long")) / base).alias(f"{m}_diff"),
            sem.round_ratio(diff, spread, spec.score_digits).alias(f"{m}_score"),
            _hit(diff, spread, spec).alias(f"{m}_hit"),
        ]
        flags[f"{m}_flag"] = _direction(m, F.col(f"{m}_diff"))
    return df.select(*out).withColumns(flags)


def _gated(df: DataFrame, spec: AnomalySpec, gate: str) -> DataFrame:
    if spec.min_baseline is not None:
        df = df.where(F.col(gate) >= spec.min_baseline)
    if spec.min_current is not None:
        df = df.where(F.col(f"{spec.metrics[0]}_ct") >= spec.min_current)
    return df


def score(
    txn: DataFrame, spec: AnomalySpec, window: cal.RunWindow, sources: Sequence[int] = ()
) -> DataFrame:
    """Scored candidates: one row per (keys, trans_dt), gates applied.

    Columns per metric: ``_ct`` current count, ``_avg``/``_std`` baseline,
    ``_diff``, ``_score`` (rounded), ``_hit`` and ``_flag``; shares add ``_rate`` and
    ``_ct_avg``.
    """
    daily = daily_volume(txn, spec, window, sources)
    compared = compare_to_history(daily, spec, window)
    if spec.share and spec.dense:
        segments = _segment_history(daily, spec, window)
        compared = compared.join(segments, [*spec.segment, "run_dt"]).where(
            (F.col("seg_current") == 1) & (F.col("seg_days") > 0)
        )
    scored = _score_shares(compared, spec) if spec.share else _score_counts(compared, spec)
    return scored.withColumnRenamed("run_dt", "trans_dt")


def any_hit(metrics: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"{m}_hit") for m in metrics])


def flagged(scored: DataFrame, spec: AnomalySpec) -> DataFrame:
    return scored.where(any_hit(spec.triggers or spec.metrics))


# ---------------------------------------------------------------- shapes


def _stem(metric: str) -> str:
    return "" if metric == act.TOTAL else f"{metric}_"


def wide_counts(scored: DataFrame, spec: AnomalySpec, period: str = "daily") -> DataFrame:
    """One row per flagged key and day, a column group per metric."""
    cols = [*spec.all_keys[:1], *spec.keys, "trans_dt"]
    exprs: list[Column] = [F.col(c) for c in dict.fromkeys(cols)]
    for m in spec.metrics:
        p = _stem(m)
        exprs += [
            F.col(f"{m}_avg").alias(f"baseline_{p}avg_ct"),
            F.col(f"{m}_std").alias(f"baseline_{p}stddev_ct"),
            F.col(f"{m}_ct").alias(f"{period}_{p}ct"),
            F.col(f"{m}_diff").alias(f"{p or 'vol_'}diff"),
            F.col(f"{m}_score").alias(f"{p or 'vol_'}z_score"),
            F.col(f"{m}_flag").alias(f"{p}chg_flag"),
        ]
    exprs += [F.col(c) for c in act.example_columns(spec.examples)]
    return flagged(scored, spec).select(*exprs)


def wide_share(scored: DataFrame, spec: AnomalySpec) -> DataFrame:
    """Single-metric share report."""
    m = spec.metrics[0]
    return flagged(scored, spec).select(
        SOURCE,
        "trans_dt",
        *spec.keys,
        F.col(f"{m}_ct").alias("daily_bin_ct"),
        F.col("tot_cur").alias("daily_total_ct"),
        F.col(f"{m}_rate").alias("daily_rate_pct"),
        F.col(f"{m}_ct_avg").alias("baseline_bin_ct"),
        F.col("tot_avg").alias("baseline_total_ct"),
        F.col(f"{m}_avg").alias("baseline_avg_rate_pct"),
        F.col(f"{m}_std").alias("baseline_stddev_rate_pct"),
        F.col(f"{m}_diff").alias("rate_diff_pct"),
        F.col(f"{m}_score").alias("rate_z_score"),
        F.col(f"{m}_flag").alias("rate_chg_flag"),
    )


def wide_share_metrics(scored: DataFrame, spec: AnomalySpec) -> DataFrame:
    """Share report with a column group per metric."""
    exprs = [F.col(SOURCE), *[F.col(k) for k in spec.keys], F.col("trans_dt")]
    for m in spec.metrics:
        tail = "" if m == act.TOTAL else f"_{m}"
        head = _stem(m)
        exprs += [
            F.col(f"{m}_avg").alias(f"baseline_avg_pct{tail}"),
            F.col(f"{m}_std").alias(f"baseline_stddev_pct{tail}"),
            F.col(f"{m}_rate").alias(f"current_pct_of_total{tail}"),
            F.col(f"{m}_score").alias(f"{head}pct_z_score"),
            F.col(f"{m}_flag").alias(f"{head}pct_chg_flag"),
            F.col(f"{m}_ct").alias(f"daily_{head}ct"),
        ]
    t = spec.metrics[0]
    # rates carry `baseline_digits` digits, so percentage points are exact
    units = F.round(F.col(f"{t}_diff") * 10.0**spec.baseline_digits)
    exprs += [
        (units / 10.0 ** (spec.baseline_digits - 2)).alias("pct_point_diff"),
        F.col(f"{t}_ct_avg").alias("baseline_avg_ct"),
        F.col("tot_cur").alias("daily_total_ct"),
        *[F.col(c) for c in act.example_columns(spec.examples)],
    ]
    return flagged(scored, spec).select(*exprs)


def _stack(scored: DataFrame, spec: AnomalySpec, fields: Mapping[str, str]) -> DataFrame:
    entries = [
        F.struct(
            F.lit("total_volume" if m == act.TOTAL else m).alias("flag_type"),
            *[F.col(src.format(m=m)).alias(name) for name, src in fields.items()],
            F.col(f"{m}_flag").alias("chg_flag"),
        )
        for m in spec.metrics
    ]
    return (
        flagged(scored, spec)
        .select(SOURCE, *spec.keys, "trans_dt", F.explode(F.array(*entries)).alias("e"))
        .where(F.col("e.chg_flag").isNotNull())
        .select(SOURCE, *spec.keys, "trans_dt", "e.*")
    )


def stacked_counts(scored: DataFrame, spec: AnomalySpec) -> DataFrame:
    """One row per flagged metric: a single explode, not a union of scans."""
    return _stack(
        scored,
        spec,
        {
            "baseline_avg_ct": "{m}_avg",
            "baseline_stddev_ct": "{m}_std",
            "daily_ct": "{m}_ct",
            "vol_diff": "{m}_diff",
            "vol_z_score": "{m}_score",
        },
    )


def stacked_shares(scored: DataFrame, spec: AnomalySpec) -> DataFrame:
    return _stack(
        scored,
        spec,
        {
            "daily_total_ct": "{m}_seg_max",
            "baseline_avg_ct": "{m}_ct_avg",
            "baseline_avg_rate": "{m}_avg",
            "baseline_rate_stddev": "{m}_std",
            "daily_bin_ct": "{m}_ct",
            "daily_bin_rate": "{m}_rate",
            "rate_diff": "{m}_diff",
            "vol_z_score": "{m}_score",
        },
    )


def dashboard_panel(scored: DataFrame, spec: AnomalySpec, top: int | None = None) -> DataFrame:
    """Every candidate with a boolean flag; with `top`, so many of the newest, strongest rows."""
    m = spec.metrics[0]
    out = scored.select(
        SOURCE,
        F.col("trans_dt").alias("run_dt"),
        *spec.keys,
        F.col(f"{m}_rate").alias("rate_pct"),
        F.col(f"{m}_avg").alias("baseline_avg"),
        F.col(f"{m}_score").alias("z_score"),
        F.col(f"{m}_hit").alias("flagged"),
    )
    if top is not None:
        out = out.orderBy(
            F.desc("run_dt"), F.desc_nulls_last("z_score"), SOURCE, *spec.keys
        ).limit(top)
    return out


def latest_hour(scored: DataFrame, txn: DataFrame, today: dt.date) -> DataFrame:
    """Keep each source's newest hour of the current day."""
    newest = (
        txn.where(F.col("trans_dt") == F.lit(today))
        .groupBy(SOURCE, "trans_dt")
        .agg(F.max("trans_hr").alias("max_hr"))
    )
    return scored.join(newest, [SOURCE, "trans_dt"]).where(F.col("trans_hr") == F.col("max_hr"))


def attackers(flags: DataFrame, txn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accounts behind flagged (source, day, key) rows."""
    on = [SOURCE, "trans_dt", *keys]
    return txn.select(*on, "account_cd").join(flags.select(*on).distinct(), on, "left_semi")


def bi_window(df: DataFrame, as_of: dt.date, months: int) -> DataFrame:
    """Reporting window columns read by BI extracts."""
    return df.withColumns(
        {
            "tableau_end_dt": F.lit(as_of),
            "tableau_start_dt": F.lit(cal.add_months(as_of, -months)),
        }
    )
