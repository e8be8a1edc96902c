"""Registered queries against their oracles on the smallest data.

PAYLENS_ALL_QUERIES=1 compares all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.run_check import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "anomaly_dashboard_bin",
    "anomaly_txn_dow_decline_type",
    "anomaly_full_grid_rate",
    "anomaly_percent_change",
    "anomaly_hourly_all_hours",
    "subscription_history",
    "invoice_rollup",
    "dunning_outcome",
    "attempt_categories_band",
    "gateway_comparison",
    "attempt_classes",
    "order_summary",
    "dispute_summary",
    "kpi_success_rates",
    "refund_plan",
    "keyed_upsert",
)
NAMES = tuple(entry.queries()) if os.environ.get("PAYLENS_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 70


def test_entry_runs(spark):
    assert entry.entry(spark).columns[:3] == ["src_system_id", "run_dt", "cc_first_6_nbr"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, name):
    ok, text, _ = compare(spark, con, name, SF)
    assert ok, text
