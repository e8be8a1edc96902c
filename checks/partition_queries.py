"""The attempts cut by day, and a merge that rewrites some partitions of a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import spark_view
from checks.lifecycle_queries import plain
from checks.registry import ORACLES, register
from paylens.reuse import job_folder
from paylens.sources.partitions import PartitionedTable, read_days, write_days
from paylens.sources.transactions import project_txn, txn_scope


def _by_day(spark, sf_dir):
    txn = spark_view(spark, sf_dir, "txn")
    folder = job_folder(spark, "days")
    write_days(txn, folder)
    days = read_days(spark, folder, txn.schema)
    return plain(project_txn(txn_scope(days, dt.date(2025, 10, 1), dt.date(2025, 12, 31), sources=(115, 134), bins=("400001", "400003"))))


register("txn_scope_by_day", _by_day, ORACLES["txn_scope"])


def _merged(spark, sf_dir):
    """Orders by year; then the dearer ones of two years at a new price, some of them moved to another year, and new ones."""
    orders = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), F.year("o_orderdate").alias("o_year")
    )
    table = PartitionedTable(spark, job_folder(spark, "orders"), "o_year")
    table.merge(orders, ["o_orderkey"])
    dear = orders.where((F.col("o_totalprice") > 200000) & F.col("o_year").isin(1994, 1995))
    moved = F.when((F.col("o_year") == 1995) & (F.col("o_totalprice") > 300000), 1996).otherwise(F.col("o_year"))
    changed = dear.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_year": moved})
    new = orders.where(F.col("o_totalprice") < 2000).withColumns({"o_orderkey": -F.col("o_orderkey"), "o_year": F.lit(2001)})
    table.merge(changed.unionByName(new), ["o_orderkey"])
    return table.read()


register(
    "upsert_partitions",
    _merged,
    """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER) AS o_year FROM orders)
SELECT * REPLACE (CASE WHEN o_totalprice > 200000 AND o_year IN (1994, 1995) THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
       , CAST(CASE WHEN o_totalprice > 300000 AND o_year = 1995 THEN 1996 ELSE o_year END AS INTEGER) AS o_year) FROM o
UNION ALL SELECT * REPLACE (-o_orderkey AS o_orderkey, CAST(2001 AS INTEGER) AS o_year) FROM o WHERE o_totalprice < 2000""",
)
