"""Invoices rolled up from their lines, payment attempts and dunning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators.subscriptions import ACCOUNT, SUBSCRIPTION
from paylens.sources.transactions import is_attempt

INVOICE = (*ACCOUNT, "invoice_guid")
INVOICE_COLUMNS = (
    *ACCOUNT, "subscription_guid", "invoice_guid", "invoice_nbr", "invoice_billed_dt_ut",
    "start_dt_ut", "end_dt_ut", "invoice_type_cd", "invoice_state_desc", "invoice_closed_dt_ut",
    "coupon_cd",
)


def invoice_rollup(lines: DataFrame, since: dt.date | None = None) -> DataFrame:
    """One row per invoice header: amounts, gift-card flag, rank, renewal rank.

    Lines are pre-aggregated to header rows before any window runs, so a long
    invoice shrinks on the map side; the per-invoice sums then only add up the
    header variants. The string 'null' in `paid_by_gc_chk` is part of the
    contract.
    """
    if since is not None:
        lines = lines.where(F.col("creation_dt") >= F.lit(since))
    gift = (
        (F.col("invoice_type_cd") == "gift_card")
        & (F.col("type_desc") == "credit")
        & F.lower("adj_desc").like("%gift%card%")
    )
    headers = (
        lines.withColumn("_gift", F.when(gift, 1).otherwise(0))
        .withColumn("invoice_type_cd", sem.blank_to_null(F.col("invoice_type_cd")))
        .groupBy(*INVOICE_COLUMNS)
        .agg(
            F.sum("adj_amt").alias("_amt"),
            F.sum("adj_total_amt").alias("_total"),
            F.max("_gift").alias("_gift"),
        )
        .repartition(*ACCOUNT)  # all windows are inside an account
    )
    same_invoice = Window.partitionBy(*INVOICE)
    order = ("invoice_billed_dt_ut", "invoice_nbr")
    of_sub = Window.partitionBy(*SUBSCRIPTION).orderBy(*order)
    renewal = F.col("invoice_type_cd") == "renewal"
    # ties inside the account history are broken by the invoice id
    of_account = Window.partitionBy(*ACCOUNT).orderBy(*order, "invoice_guid")
    renewals = Window.partitionBy(*SUBSCRIPTION).orderBy(
        F.when(renewal, 0).otherwise(1), *order, "invoice_guid"
    )
    out = headers.withColumns(
        {
            "adj_amt": F.sum("_amt").over(same_invoice),
            "adj_total_amt": F.sum("_total").over(same_invoice),
            "gift_card_chk": F.max("_gift").over(same_invoice),
            "earliest_inv": F.dense_rank().over(of_sub),
        }
    ).drop("_amt", "_total", "_gift")
    before = F.lag("adj_total_amt").over(of_account)
    return out.withColumns(
        {
            "paid_by_gc_chk": F.when(
                (before < 0) & (F.col("adj_total_amt") + before < 0), "paid_by_gift_card"
            ).otherwise("null"),
            "renewal_earliest_inv": F.when(renewal, F.row_number().over(renewals)),
        }
    )


def invoice_sums(lines: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Plain sums per subscription, invoice, type and state."""
    if since is not None:
        lines = lines.where(F.col("creation_dt") >= F.lit(since))
    return (
        lines.withColumn("invoice_type_cd", sem.blank_to_null(F.col("invoice_type_cd")))
        .groupBy(*SUBSCRIPTION, "invoice_guid", "invoice_type_cd", "invoice_state_desc")
        .agg(F.sum("adj_amt").alias("adj_amt"), F.sum("adj_total_amt").alias("adj_total_amt"))
    )


def paid_per_subscription(subs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Amounts of paid invoices; subscriptions without invoices are absent.

    The sum is taken before the join, which then only moves one row per
    subscription; the join multiplies it by the matching subscription rows.
    """

    def paid(c: str) -> Column:
        return F.sum(
            F.when(F.col("invoice_state_desc") == "paid", F.col(c)).otherwise(F.lit(0))
        ).alias(c)

    sums = invoices.groupBy(*SUBSCRIPTION).agg(paid("adj_amt"), paid("adj_total_amt"))
    copies = subs.groupBy(*SUBSCRIPTION).agg(F.count(F.lit(1)).alias("_n"))
    return sums.join(copies, list(SUBSCRIPTION)).select(
        *SUBSCRIPTION,
        (F.col("adj_amt") * F.col("_n")).alias("sub_paid_amt"),
        (F.col("adj_total_amt") * F.col("_n")).alias("sub_paid_total_amt"),
    )


# ------------------------------------------------------------ attempts


def collection_origin() -> Column:
    """Collected by the recovery vendor or by the billing system."""
    return F.when(
        F.trim(F.coalesce("approval_desc", F.lit(""))) == fv.VENDOR_APPROVAL_TEXT,
        fv.VENDOR_ORIGIN,
    ).otherwise(fv.BILLING_ORIGIN)


def clean_reference() -> Column:
    """Second part of the three-part references of one gateway."""
    ref = F.col("reference_cd")
    return F.when(
        (F.col("trans_gateway_type_desc") == "cybersource") & ref.like("%;%;%"),
        F.get(F.split(ref, ";"), F.lit(1)),
    ).otherwise(ref)


def clean_attempts(txn: DataFrame, since: dt.date | None = None, sources=()) -> DataFrame:
    """Attempts with market, blank ids as NULL and cleaned references."""
    keep = is_attempt()
    if since is not None:
        keep &= F.col("trans_dt") >= F.lit(since)
    if sources:
        keep &= F.col("src_system_id").isin(*sources)
    return txn.where(keep).withColumns(
        {
            "gateway_country": sem.market(F.col("gateway_cd")),
            "subscription_guid": sem.blank_to_null(F.col("subscription_guid")),
            "invoice_guid": sem.blank_to_null(F.col("invoice_guid")),
            "reference_cd": clean_reference(),
            "txn_origin": collection_origin(),
            "trans_dt_et": sem.in_zone(F.col("trans_dt_ut"), fv.BILLING_ZONE),
        }
    )


ATTEMPT_GROUP = (*SUBSCRIPTION, "attempt_group")


def attempt_group() -> Column:
    """The invoice, or the day for attempts that carry none."""
    return F.coalesce(F.col("invoice_guid"), F.col("trans_dt").cast("string"))


def attempt_ranks(attempts: DataFrame) -> DataFrame:
    """Dense ranks of an attempt from both ends of its invoice or day."""
    grouped = attempts.withColumn("attempt_group", attempt_group())
    w = Window.partitionBy(*ATTEMPT_GROUP)
    return grouped.withColumns(
        {
            "earliest_txn": F.dense_rank().over(w.orderBy("trans_dt_ut")),
            "latest_txn": F.dense_rank().over(w.orderBy(F.desc("trans_dt_ut"))),
        }
    )


def dunning(attempts: DataFrame) -> DataFrame:
    """Per invoice: entered dunning, vendor involved, how it was recovered.

    Only the first and last attempt times matter, so this is one aggregation:
    the earliest (latest) attempts are those whose time equals the minimum
    (maximum), carried inside a struct comparison instead of a ranking window.
    Attempts that tie on the last instant give a row each.
    """
    status, origin = F.col("trans_status_desc"), F.col("origin_desc")
    collected = F.col("txn_origin")
    entered = (F.col("trans_type_desc") == "purchase") & (status == "declined")
    paid_type = (
        F.when((status == "success") & (collected == fv.VENDOR_ORIGIN), "vindicia_paid")
        .when((status == "success") & origin.isin(*fv.API_ORIGINS), "cust_paid")
        .when(
            (status == "success")
            & (origin == "recurring")
            & (collected == fv.BILLING_ORIGIN),
            "recurly_paid",
        )
        .when(status == "success", "paid")
    )
    keyed = attempts.where(
        F.col("subscription_guid").isNotNull() & F.col("invoice_guid").isNotNull()
    ).withColumns({"_entered": F.when(entered, 1).otherwise(0), "_paid": paid_type})
    # first per attempt time: ties at one instant collapse to one row each
    per_time = keyed.groupBy(*SUBSCRIPTION, "invoice_guid", "trans_dt_ut").agg(
        F.max("_entered").alias("_entered"),
        # bounded: attempts on one invoice at one instant
        F.collect_list(F.coalesce("_paid", F.lit("none"))).alias("_types"),
        F.max(F.when(collected == fv.VENDOR_ORIGIN, 1).otherwise(0)).alias("_vendor"),
    )
    per_invoice = per_time.groupBy(*SUBSCRIPTION, "invoice_guid").agg(
        F.min_by("_entered", "trans_dt_ut").alias("dun_chk"),
        F.max_by("_types", "trans_dt_ut").alias("_types"),
        F.max("_vendor").alias("vindicia_chk"),
    )
    return per_invoice.select(
        *SUBSCRIPTION, "invoice_guid", "dun_chk", "vindicia_chk",
        F.explode(
            F.when(F.col("dun_chk") == 1, F.col("_types")).otherwise(F.array(F.lit("none")))
        ).alias("_type"),
    ).select(
        *SUBSCRIPTION, "invoice_guid", "dun_chk", "vindicia_chk",
        F.nullif("_type", F.lit("none")).alias("dun_paid_type"),
    )


def invoices_with_dunning(invoices: DataFrame, dun: DataFrame) -> DataFrame:
    entered = (F.col("invoice_type_cd") == "renewal") & (F.col("_dun") == 1)
    joined = invoices.join(
        dun.withColumnRenamed("dun_chk", "_dun").drop("vindicia_chk"),
        [*SUBSCRIPTION, "invoice_guid"],
        "left",
    )
    return joined.withColumn("dun_chk", F.when(entered, "entered_dunning")).drop("_dun")


def dunning_funnel(
    valued: DataFrame, invoices: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Invoices that entered dunning and how they were recovered."""
    subs = valued.where(F.to_date("activate_dt_et").between(F.lit(start), F.lit(end)))
    joined = subs.join(
        invoices.select(*SUBSCRIPTION, "invoice_nbr", "dun_chk", "dun_paid_type"),
        list(SUBSCRIPTION),
        "left",
    ).withColumn(
        "sub_paid_chk",
        F.when(F.col("sub_paid_amt") > 0, "paid").when(F.col("sub_paid_amt") == 0, "not_paid"),
    )
    keys = ("src_system_id", "plan_dur", "sub_paid_chk", "mths_active")
    kinds = {
        "enter_dunning_ct": F.col("dun_chk") == "entered_dunning",
        "cust_paid_ct": F.col("dun_paid_type") == "cust_paid",
        "vindicia_paid_ct": F.col("dun_paid_type") == "vindicia_paid",
        "recurly_paid_ct": F.col("dun_paid_type") == "recurly_paid",
        "tot_paid_ct": F.col("dun_paid_type") == "paid",
    }
    has_invoice = F.col("invoice_nbr").isNotNull()
    per_invoice = joined.groupBy(*keys, "invoice_nbr").agg(
        *[F.max(F.when(c & has_invoice, 1).otherwise(0)).alias(n) for n, c in kinds.items()]
    )
    invoice_part = per_invoice.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in kinds])
    per_sub = joined.groupBy(*keys, "subscription_guid").agg(
        F.min("account_cd").alias("lo"), F.max("account_cd").alias("hi")
    )
    sub_part = per_sub.groupBy(*keys).agg(
        F.count("subscription_guid").alias("sub_ct"),
        F.min("lo").alias("min_account_cd"),
        F.max("hi").alias("max_account_cd"),
    )
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return (
        invoice_part.alias("i")
        .join(sub_part.alias("s"), same)
        .select(
            *[F.col(f"i.{k}") for k in keys], *kinds, "sub_ct", "min_account_cd", "max_account_cd"
        )
    )


def recovery_rate(attempts: DataFrame, within_days: int) -> DataFrame:
    """Invoices whose first decline was followed by a success in time.

    One aggregate per invoice holds the first decline and all it needs: the
    first success after it comes from a second, equally small step.
    """
    keyed = attempts.where(F.col("invoice_guid").isNotNull())
    status = F.col("trans_status_desc")
    on = list(INVOICE)
    first_fail = keyed.where(sem.declined(status)).groupBy(*on).agg(
        F.min("trans_dt_ut").alias("failed_at")
    )
    wins = keyed.where(sem.succeeded(status)).select(*on, F.col("trans_dt_ut").alias("won_at"))
    # collapse repeated instants before the join
    wins = wins.distinct()
    won = (
        first_fail.join(wins, on, "left")
        .withColumn(
            "_won",
            (F.col("won_at") > F.col("failed_at"))
            & (F.col("won_at") <= F.col("failed_at") + F.expr(f"INTERVAL '{within_days}' DAY")),
        )
        .groupBy(*on)
        .agg(F.max(F.when(F.col("_won"), 1).otherwise(0)).alias("recovered"))
    )
    return (
        won.groupBy("src_system_id")
        .agg(
            F.count(F.lit(1)).alias("failed_invoices"),
            F.sum("recovered").alias("recovered_invoices"),
        )
        .withColumn(
            "recovery_rate",
            sem.round_ratio(F.col("recovered_invoices"), F.col("failed_invoices"), 5),
        )
    )
