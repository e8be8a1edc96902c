"""Computed tables are cut into small partitions, and histories carry no more than they must."""

import pytest
from pyspark.sql import functions as F

from checks.fixtures import spark_view
from checks.oracle_lifecycle import AS_OF
from paylens import reuse
from paylens.operators import classify as cl
from paylens.operators import subscriptions as sub
from paylens.plans import gateway_reports as gr

KEYS = (*reuse.SMALL_PARTITIONS, reuse.ALL_KEYS)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _wide(spark):
    """About 60 MB that do not shrink."""
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(4)])
    return spark.range(0, 250_000, 1, 4).select((F.col("id") % 1000).alias("k"), F.unhex(text).alias("v"))


@pytest.mark.parametrize("dealt", [False, True])
def test_a_computed_table_is_cut_small_whatever_the_session_says(one_partition, dealt):
    before = [one_partition.conf.get(k, None) for k in KEYS]
    table = reuse.computed_once(_wide(one_partition).repartition("k"), dealt)
    assert len(table.inputFiles()) > 1
    assert table.count() == 250_000 and table.select("k").distinct().count() == 1000
    assert [one_partition.conf.get(k, None) for k in KEYS] == before


def test_the_settings_come_back_after_an_error(spark):
    spark.conf.set(KEYS[1], "32m")
    before = [spark.conf.get(k, None) for k in KEYS]
    with pytest.raises(ZeroDivisionError), reuse.settings(spark, {k: "false" for k in KEYS[2:]} | reuse.SMALL_PARTITIONS):
        1 / 0
    assert [spark.conf.get(k, None) for k in KEYS] == before
    spark.conf.unset(KEYS[1])


def test_start_types_by_account_equal_those_by_subscription(spark):
    subs = spark.createDataFrame(
        [(1, "a", "S1"), (1, "a", "S1"), (1, "b", "S1"), (1, None, "S1"), (1, None, "S2"), (1, "c", None),
         (None, "c", "S2"), (2, "a", "S1"), (1, "d", "S3")],
        "src_system_id long, account_cd string, subscription_guid string",
    )
    types = spark.createDataFrame(
        [(1, "S1", "promo"), (1, "S1", "promo"), (1, "S1", "gift"), (1, "S2", "gift"), (None, "S2", "x"), (1, None, "y"), (2, "S9", "z")],
        "src_system_id long, subscription_guid string, overall_sub_start_type_desc string",
    )
    history = subs.withColumn("n", F.monotonically_increasing_id())
    history = reuse.computed_once(history)
    cols = ("n", *sub.SUBSCRIPTION, "overall_sub_start_type_desc")

    def rows(df):
        return sorted(map(str, df.select(*cols).collect()))

    assert rows(cl.with_start_type_dealt(history, subs, types)) == rows(cl.with_start_type(history, types))


def test_stored_histories_equal_the_full_ones(spark):
    sf = "/root/testdata/sf0.001"
    t = gr.Tables(*(spark_view(spark, sf, v) for v in ("att", "adj", "sub", "starts")))
    full = cl.with_start_type(sub.sub_history(t.subs, AS_OF), t.start_types).select(*gr.HISTORY_COLUMNS)
    assert not set(sub.derived_times()) & set(gr._stored_history(t, AS_OF).columns)
    for found in (gr.history(t, AS_OF), gr.dealt_history(t, AS_OF)):
        assert found.columns == full.columns
        assert found.count() == full.count() and found.exceptAll(full).isEmpty()
