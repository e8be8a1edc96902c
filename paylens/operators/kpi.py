"""Payment and fraud KPIs under one filter contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators.filters import Filters, apply_filters
from paylens.sources.transactions import is_attempt


def filter_values(df: DataFrame, dimension: str) -> DataFrame:
    """Distinct values a multi-select offers."""
    return df.select(dimension).where(F.col(dimension).isNotNull()).distinct()


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def attempts(txn: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Customers' attempts under the filters; test rows go where they are marked."""
    if "test_transaction_ind" in txn.columns:
        txn = txn.where(~F.coalesce("test_transaction_ind", F.lit(False)))
    return apply_filters(txn.where(is_attempt()), filters)


def kpi_scope(txn: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return attempts(txn, filters).where(F.col("origin_desc").isin(*fv.API_ORIGINS))


def success_rates(
    txn: DataFrame,
    by: Sequence[str] = ("src_system_id", "trans_dt"),
    filters: Filters = Filters(),
) -> DataFrame:
    status = F.col("trans_status_desc")
    out = (
        kpi_scope(txn, filters)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            _count(sem.succeeded(status)).alias("successes"),
            _count(sem.declined(status)).alias("declines"),
        )
    )
    return out.withColumns(
        {
            "success_rate": sem.round_ratio(F.col("successes"), F.col("attempts"), 5),
            "decline_rate": sem.round_ratio(F.col("declines"), F.col("attempts"), 5),
        }
    )


def volume(txn: DataFrame, grain: str = "day", filters: Filters = Filters()) -> DataFrame:
    """Count and amount of attempts per day, Sunday week or month."""
    starts = {
        "day": F.col("trans_dt"),
        "week": sem.week_start_sunday(F.col("trans_dt")),
        "month": F.trunc("trans_dt", "month"),
    }
    return attempts(txn, filters).groupBy(starts[grain].alias("period"), "src_system_id").agg(
        F.count(F.lit(1)).alias("txn_ct"), F.sum("trans_amt").alias("txn_amt")
    )


def verification_rates(
    txn: DataFrame, cvv_match: Sequence[str] = ("match",), filters: Filters = Filters()
) -> DataFrame:
    """AVS pass and CVV match among successful attempts; missing counts as not."""
    won = attempts(txn, filters).where(sem.succeeded(F.col("trans_status_desc")))
    out = won.groupBy("src_system_id").agg(
        F.count(F.lit(1)).alias("successes"),
        _count(F.col("avs_result_cd").isin(*fv.AVS_PASSED)).alias("avs_pass"),
        _count(F.col("cvv_result_desc").isin(*cvv_match)).alias("cvv_match"),
    )
    return out.withColumns(
        {
            "avs_pass_rate": sem.round_ratio(F.col("avs_pass"), F.col("successes"), 5),
            "cvv_match_rate": sem.round_ratio(F.col("cvv_match"), F.col("successes"), 5),
        }
    )


def shares(txn: DataFrame, dimensions: Sequence[str], filters: Filters = Filters()) -> DataFrame:
    """Attempts per combination and their share of all."""
    scoped = attempts(txn, filters)
    per = scoped.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("txn_ct"))
    total = scoped.agg(F.count(F.lit(1))).scalar()
    return per.withColumn("share", sem.round_ratio(F.col("txn_ct"), total, 5))


def decline_breakdown(txn: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return (
        kpi_scope(txn, filters)
        .where(sem.declined(F.col("trans_status_desc")))
        .groupBy("failure_type", "gateway_error_cd")
        .agg(F.count(F.lit(1)).alias("declines"), F.sum("trans_amt").alias("declined_amt"))
    )
