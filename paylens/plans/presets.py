"""Named anomaly reports: configurations of the one anomaly engine.

Every preset is a function of an `as_of` date and returns its report. `tune`
takes `AnomalySpec` overrides, for instance a lower gate for small data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators import activity as act
from paylens.operators import anomaly as an
from paylens.operators import fixed_baseline as fb
from paylens.operators.calendar import RunWindow
from paylens.sources.transactions import nrt_union

Shape = Callable[[DataFrame, an.AnomalySpec], DataFrame]

_PAIR = (act.TOTAL, act.SUCCESS)
_FOUR = (act.TOTAL, act.SUCCESS, act.AVS_FAIL, act.DECLINE)
_THREE = (act.TOTAL, act.SUCCESS, act.DECLINE)
_EXAMPLES = (act.SUCCESS, act.DECLINE, act.AVS_FAIL)
_MARKET_BIN = ("gateway_country", "cc_first_6_nbr")
_MARKET = (an.SOURCE, "gateway_country")
_TXN = "transaction_guid"

# BINs watched by the two fixed-period reports (fixed values)
WATCHED_BINS = ("601100", "601101", "414720")


@dataclass(frozen=True)
class Preset:
    spec: an.AnomalySpec
    window: Callable[[dt.date], RunWindow]
    shape: Shape
    bi_months: int | None = None
    drop_today: bool = False

    def run(
        self,
        txn: DataFrame,
        as_of: dt.date,
        window: RunWindow | None = None,
        sources: Sequence[int] = (),
        tune: Mapping[str, Any] | None = None,
    ) -> DataFrame:
        spec = self.spec.with_(**(tune or {}))
        scored = an.score(txn, spec, window or self.window(as_of), sources)
        out = self.shape(scored, spec)
        if self.drop_today:
            out = out.where(F.col("trans_dt") < F.lit(as_of))
        return an.bi_window(out, as_of, self.bi_months) if self.bi_months else out


def _last_days(days: int) -> Callable[[dt.date], RunWindow]:
    """Complete days: the range ends yesterday."""
    return lambda as_of: RunWindow.days_ending(as_of - dt.timedelta(days=1), days)


def _last_months(months: int) -> Callable[[dt.date], RunWindow]:
    return lambda as_of: RunWindow.months_ending(as_of, months)


def _spec(**kw) -> an.AnomalySpec:
    return an.AnomalySpec(**kw)


_SHARE = dict(share=True, score_digits=5, z=3.0)

PRESETS: dict[str, Preset] = {
    # transactions per BIN, same weekday
    "txn_dow_bin": Preset(
        _spec(
            unit=_TXN,
            metrics=_PAIR,
            examples=(act.SUCCESS, act.DECLINE),
            excluded=fv.EVENT_WEEKENDS,
            min_baseline=500,
        ),
        _last_days(14),
        an.wide_counts,
    ),
    "txn_dow_bin_country": Preset(
        _spec(
            unit=_TXN,
            keys=_MARKET_BIN,
            metrics=_PAIR,
            examples=(act.SUCCESS, act.DECLINE),
            excluded=fv.EVENT_DAY,
            min_baseline=500,
        ),
        _last_days(14),
        an.wide_counts,
    ),
    "avs_fail_txn_dow_bin": Preset(
        _spec(
            unit=_TXN,
            metrics=_PAIR,
            avs_not_passed=True,
            examples=(act.SUCCESS, act.DECLINE),
            excluded=fv.EVENT_WEEKENDS,
            min_baseline=500,
        ),
        _last_days(92),
        an.wide_counts,
    ),
    # a missing decline code is a group of its own, a missing failure type is not
    "txn_dow_decline_type": Preset(
        _spec(
            unit=_TXN,
            keys=("failure_type", "gateway_error_cd"),
            null_safe_keys=frozenset({"gateway_error_cd"}),
            examples=(act.DECLINE,),
            excluded=fv.EVENT_DAY,
            min_baseline=500,
        ),
        _last_days(14),
        an.wide_counts,
    ),
    "acct_dow_bin": Preset(
        _spec(metrics=_FOUR, examples=_EXAMPLES, excluded=fv.EVENT_WEEKENDS, min_baseline=300),
        _last_days(14),
        an.wide_counts,
    ),
    "acct_bin_rate": Preset(
        _spec(**_SHARE, same_weekday=False, excluded=fv.EVENT_WEEKENDS, min_baseline=100),
        _last_days(14),
        an.wide_share,
    ),
    "acct_dow_bin_rate": Preset(
        _spec(**_SHARE, excluded=fv.EVENT_WEEKENDS, min_baseline=100),
        _last_days(14),
        an.wide_share,
    ),
    "dashboard_bin": Preset(
        _spec(**_SHARE, scale=100, same_weekday=False, min_current=100),
        _last_days(14),
        an.dashboard_panel,
    ),
    "bi_acct_dow_bin": Preset(
        _spec(
            keys=_MARKET_BIN,
            metrics=_FOUR,
            examples=_EXAMPLES,
            excluded=fv.EVENT_WEEKEND,
            min_baseline=500,
        ),
        _last_days(14),
        an.wide_counts,
        bi_months=4,
    ),
    "bi_txn_dow_bin": Preset(
        _spec(
            unit=_TXN,
            keys=_MARKET_BIN,
            metrics=(act.TOTAL, act.SUCCESS, act.AVS_FAIL),
            triggers=_PAIR,
            examples=_EXAMPLES,
            excluded=fv.EVENT_WEEKEND,
            min_baseline=500,
        ),
        _last_days(14),
        an.wide_counts,
        bi_months=4,
    ),
    # the scan reaches back only to the run range, so early run dates have
    # short baselines; kept, and adjustable through history_months
    "bi_acct_dow_bin_stacked": Preset(
        _spec(
            keys=_MARKET_BIN,
            metrics=_FOUR,
            excluded=fv.EVENT_WEEKEND,
            history_months=0,
            min_baseline=300,
        ),
        _last_months(4),
        an.stacked_counts,
        bi_months=4,
    ),
    "bi_acct_share": Preset(
        _spec(
            share=True,
            keys=_MARKET_BIN,
            segment=_MARKET,
            metrics=_FOUR,
            baseline_digits=6,
            same_weekday=False,
            lookback_months=4,
            origins=None,
            excluded=fv.EVENT_WEEKEND,
            examples=_EXAMPLES,
            min_baseline=500,
        ),
        _last_days(14),
        an.wide_share_metrics,
        bi_months=4,
    ),
    "bi_avs_fail_stacked": Preset(
        _spec(
            keys=_MARKET_BIN,
            metrics=_THREE,
            avs_not_passed=True,
            excluded=fv.EVENT_WEEKENDS_AND_MONTH_END,
            history_months=0,
            min_baseline=50,
        ),
        _last_months(3),
        an.stacked_counts,
        bi_months=3,
    ),
    "acct_dow_bin_union": Preset(
        _spec(keys=_MARKET_BIN, metrics=_FOUR, excluded=fv.EVENT_WEEKEND, min_baseline=300),
        _last_days(122),
        an.stacked_counts,
        bi_months=4,
    ),
    "avs_fail_union": Preset(
        _spec(keys=_MARKET_BIN, metrics=_THREE, avs_not_passed=True, history_months=0),
        _last_months(3),
        an.stacked_counts,
        bi_months=3,
    ),
    "full_grid_union": Preset(
        _spec(
            keys=_MARKET_BIN,
            metrics=_FOUR,
            dense=True,
            lookback_months=6,
            z=2.5,
            flag_on_rounded=True,
        ),
        _last_months(6),
        an.stacked_counts,
        bi_months=3,
    ),
    "full_grid_gated": Preset(
        _spec(
            keys=_MARKET_BIN,
            metrics=_FOUR,
            dense=True,
            lookback_months=6,
            z=2.5,
            min_baseline=300,
            flag_on_rounded=True,
        ),
        _last_months(6),
        an.stacked_counts,
        bi_months=3,
        drop_today=True,
    ),
    "full_grid_rate": Preset(
        _spec(
            share=True,
            keys=_MARKET_BIN,
            segment=_MARKET,
            metrics=_FOUR,
            digits={act.SUCCESS: 5, act.DECLINE: 5},
            baseline_digits=4,
            same_weekday=False,
            dense=True,
            lookback_months=6,
            z=2.5,
            min_baseline=300,
            flag_on_rounded=True,
        ),
        _last_months(6),
        an.stacked_shares,
        bi_months=6,
        drop_today=True,
    ),
    # attempts of subscribers, or without a subscription at all
    "subscriber_stacked": Preset(
        _spec(
            keys=_MARKET_BIN,
            metrics=_FOUR,
            origins=None,
            excluded=fv.EVENT_WEEKEND,
            history_months=0,
            min_baseline=300,
        ),
        _last_months(4),
        an.stacked_counts,
        bi_months=4,
    ),
}


def subscriber_attempts(txn: DataFrame, subs: DataFrame) -> DataFrame:
    """Attempts of a known subscription, or carrying none.

    Expressed as a semi join plus a filter instead of an outer join: an attempt
    is kept once however many subscription rows match it, and nothing
    downstream distinguishes repeated rows.
    """
    on = [an.SOURCE, "account_cd", "subscription_guid"]
    none = txn.where(F.col("subscription_guid").isNull())
    return txn.join(subs.select(*on), on, "left_semi").select(*txn.columns).unionByName(none)


HOURLY = an.AnomalySpec(
    unit=_TXN,
    keys=("trans_hr", "cc_first_6_nbr"),
    metrics=_PAIR,
    examples=(act.SUCCESS, act.DECLINE),
    excluded=fv.EVENT_DAY,
    min_baseline=20,
)


def with_hour(txn: DataFrame) -> DataFrame:
    return txn.withColumn("trans_hr", sem.zone_hour(F.col("trans_dt_ut"), fv.REPORT_ZONE))


def hourly_check(
    nrt: DataFrame,
    hist: DataFrame,
    as_of: dt.date,
    days: int = 15,
    tune: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Same weekday and hour; only each source's newest hour of `as_of`."""
    spec = HOURLY.with_(**(tune or {}))
    window = RunWindow.days_ending(as_of, days)
    txn = with_hour(nrt_union(nrt, hist, dedupe=False))
    scored = an.score(txn, spec, window)
    scoped = an.txn_scope(txn, as_of, as_of, origins=spec.origins)
    return an.wide_counts(an.latest_hour(scored, scoped, as_of), spec, period="hourly")


def percent_change(txn: DataFrame, period: fb.FixedPeriod, bins=WATCHED_BINS) -> DataFrame:
    return fb.percent_change_report(txn, period, bins)


def fixed_zscore(
    txn: DataFrame, period: fb.FixedPeriod, bins=WATCHED_BINS, excluded=()
) -> DataFrame:
    return fb.fixed_zscore_report(txn, period, bins, excluded=excluded)
