"""Anomaly reports on the folded attempt fixture."""

from __future__ import annotations

import datetime as dt

from checks import oracle_anomaly as orc
from checks.fixtures import spark_view
from checks.registry import register
from paylens.operators.calendar import RunWindow
from paylens.operators.fixed_baseline import FixedPeriod
from paylens.plans import presets as pre

AS_OF = dt.date(2026, 1, 28)
SMALL = {"z": 2.0, "min_baseline": 5}
# thresholds are parameters; the fixture's volumes call for lower ones
TUNING = {
    "acct_bin_rate": {"z": 2.0, "min_baseline": 5},
    "acct_dow_bin_rate": {"z": 2.0, "min_baseline": 5},
    "dashboard_bin": {"z": 2.0, "min_current": 3},
    "txn_dow_decline_type": {"z": 1.0, "min_baseline": 1},
    "txn_dow_bin_country": {"z": 1.5, "min_baseline": 1},
    "bi_acct_dow_bin": {"z": 1.5, "min_baseline": 1},
    "bi_txn_dow_bin": {"z": 1.5, "min_baseline": 1},
    "bi_acct_dow_bin_stacked": {"z": 2.0, "min_baseline": 1},
    "bi_acct_share": {"z": 2.0, "min_baseline": 1},
    "bi_avs_fail_stacked": {"z": 1.5, "min_baseline": 1},
    "acct_dow_bin_union": {"z": 2.0, "min_baseline": 1},
    "avs_fail_union": {"z": 1.5},
    "full_grid_union": {},
    "full_grid_gated": {"min_baseline": 1},
    "full_grid_rate": {"min_baseline": 1},
    "subscriber_stacked": {"z": 2.0, "min_baseline": 2},
}
FIXED = FixedPeriod(dt.date(2025, 10, 15), dt.date(2026, 1, 15), dt.date(2026, 1, 27))
FIXED_BINS = ("400001", "400002", "400003")




def _preset_query(name: str):
    preset = pre.PRESETS[name]
    tune = TUNING.get(name, SMALL)

    def run(spark, sf_dir):
        return preset.run(spark_view(spark, sf_dir, "txn"), AS_OF, tune=tune)

    return run, orc.preset_sql(preset, AS_OF, tune)


for _name in pre.PRESETS:
    if _name != "subscriber_stacked":
        register(f"anomaly_{_name}", *_preset_query(_name))


def percent_change(spark, sf_dir):
    return pre.percent_change(spark_view(spark, sf_dir, "txn"), FIXED, FIXED_BINS)


def fixed_zscore(spark, sf_dir):
    return pre.fixed_zscore(spark_view(spark, sf_dir, "txn"), FIXED, FIXED_BINS)


register("anomaly_percent_change", percent_change, orc.percent_change_sql(FIXED, FIXED_BINS))
register("anomaly_fixed_zscore", fixed_zscore, orc.fixed_zscore_sql(FIXED, FIXED_BINS))


def dashboard_bound(spark, sf_dir):
    """The dashboard panel with bound parameters instead of the defaults."""
    return pre.PRESETS["dashboard_bin"].run(
        spark_view(spark, sf_dir, "txn"), AS_OF, window=BOUND, sources=(115, 139), tune=BOUND_TUNE
    )


BOUND = RunWindow(dt.date(2026, 1, 5), dt.date(2026, 1, 20))
BOUND_TUNE = {"z": 1.5, "min_current": 2}
register(
    "anomaly_dashboard_bound",
    dashboard_bound,
    orc.preset_sql(
        pre.PRESETS["dashboard_bin"], AS_OF, BOUND_TUNE, BOUND, extra=" AND src_system_id IN (115, 139)"
    ),
)
