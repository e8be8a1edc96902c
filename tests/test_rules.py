"""Every attempt gets exactly one category; detailed classes cover all."""

from pyspark.sql import functions as F

from checks import classify_queries, gateway_queries  # noqa: F401
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_each_attempt_has_one_category(spark):
    df = QUERIES["attempt_categories_window"](spark, SF)
    assert df.count() == df.select("transaction_guid").distinct().count()
    assert df.where(F.col("transaction_category").isNull()).count() == 0


def test_no_attempt_is_lost_by_the_detailed_classes(spark):
    classes = QUERIES["attempt_classes"](spark, SF)
    simple = QUERIES["attempt_categories_window"](spark, SF)
    assert classes.select("transaction_guid").distinct().count() == simple.count()
    assert classes.where(F.col("txn_classify").isNull()).count() == 0
