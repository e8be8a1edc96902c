"""Processor disputes matched back to gateway requests, invoices, accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators.sparse_keys import left_join
from paylens.operators.subscriptions import ACCOUNT

# --- fixed values ------------------------------------------------------------
FIRST_CHARGEBACK = "First Chargeback"
CHARGEBACK_RECORD = "Chargeback"
VENDOR_REFERENCE = "PAR%"
FRAUD_REASONS = ("no authorization", "chip liability shift")
APPROVED_REASON = 100
CARD_TEST_AMOUNT = 1
NOT_FIRST = 1_000_000
US_SOURCE, DOMESTIC = 115, "US"


def _day(text: Column) -> Column:
    return F.to_date(text, "M/d/yyyy")


def _only(c: Column, chars: str) -> Column:
    """Does the text consist of these characters only? NULL stays NULL."""
    return F.length(F.regexp_replace(c, f"[{chars}]", "")) == 0


def _has_letters(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def dispute_invoices(
    invoices: DataFrame, lines: DataFrame, since: dt.date
) -> DataFrame:
    """Invoices per subscription with the rank of paid ones (`fin`)."""
    links = (
        lines.where((F.col("creation_dt") >= F.lit(since)) & F.col("subscription_guid").isNotNull())
        .select(*ACCOUNT, "invoice_guid", "subscription_guid")
        .distinct()
    )
    country = F.col("country_cd")
    joined = (
        invoices.where(F.col("partition_month_start_dt") >= F.lit(since))
        .join(links, [*ACCOUNT, "invoice_guid"])
        .withColumns(
            {
                "country_cd": F.when(
                    F.col("src_system_id") == US_SOURCE,
                    F.coalesce(F.trim(country), F.lit(DOMESTIC)),
                ).otherwise(country),
                "dun_chk": F.nullif("dunning_campaign_id", F.lit("nan")),
                "_paid": F.when(F.col("total_amt") > 0, 1).otherwise(0),
            }
        )
    )
    per_sub = Window.partitionBy(*ACCOUNT, "subscription_guid")
    paid_rank = F.dense_rank().over(
        Window.partitionBy(*ACCOUNT, "subscription_guid", "_paid").orderBy("billed_dt_ut")
    )
    return joined.select(
        *ACCOUNT, "country_cd", "subscription_guid", "invoice_guid", "invoice_nbr",
        "invoice_type_desc", "status_desc", "billed_dt_ut", "closed_dt_ut", "total_amt", "dun_chk",
        F.when(F.col("_paid") == 1, paid_rank).otherwise(NOT_FIRST).alias("fin"),
        F.min("invoice_nbr").over(per_sub).alias("min_sub_inv"),
    ).distinct()


def _signup(fin: Column) -> Column:
    return F.when(fin == 1, "signup")


def attempt_signups(txn: DataFrame, invoices: DataFrame, since: dt.date) -> DataFrame:
    """Attempts with invoice number and the first-paid-invoice flag."""
    inv = invoices.select(*ACCOUNT, "invoice_guid", "invoice_nbr", "fin").distinct()
    return (
        txn.where(F.col("trans_dt") >= F.lit(since))
        .join(inv, [*ACCOUNT, "invoice_guid"], "left")
        .select(
            *ACCOUNT,
            sem.blank_to_null(F.col("subscription_guid")).alias("txn_subscription_guid"),
            "invoice_nbr",
            "invoice_guid",
            "transaction_guid",
            "origin_desc",
            _signup(F.col("fin")).alias("signup_chk"),
        )
        .distinct()
    )


def first_disputes(disputes: DataFrame, since: dt.date) -> DataFrame:
    """First dispute per site and transaction, dates parsed."""
    dated = disputes.where(
        (F.col("chargeback_work_type") == FIRST_CHARGEBACK)
        & (_day(F.col("txn_date")) >= F.lit(since))
        & sem.blank_to_null(F.col("transaction_id")).isNotNull()
    ).withColumns(
        {c: _day(F.col(c)) for c in ("txn_date", "received_date", "disposition_date")}
    )
    order = Window.partitionBy("site_id_be", "transaction_id").orderBy(
        "received_date", "case_number"
    )
    return (
        dated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")
    )


def recovery_number(number: Column) -> tuple[Column, Column]:
    """(invoice number, country) of an external recovery's invoice text."""
    prefixed = _has_letters(number)
    digits = F.when(prefixed, F.substr(number, F.lit(3), F.lit(20))).otherwise(number)
    country = F.when(prefixed, F.left(number, F.lit(2))).otherwise(DOMESTIC)
    return digits.try_cast("bigint"), country


def clean_requests(
    requests: DataFrame, batches: DataFrame, recoveries: DataFrame, since: dt.date
) -> DataFrame:
    """Approved gateway requests with network id, origin and invoice number."""
    ref, customer = F.col("merchantreferencenumber"), F.col("customerid")
    network = F.col("networktransactionid")
    batch = batches.where(F.to_date("requestdate") >= F.lit(since)).select(
        "requestid", "merchantid", "transactionrefnumber"
    )
    kept = requests.where(
        (F.to_date("requestdate") >= F.lit(since))
        & (F.col("amount") > 0)
        & (F.col("amount") != CARD_TEST_AMOUNT)
        & (F.col("overallreasoncode") == APPROVED_REASON)
    ).drop("transactionrefnumber")
    texts = recoveries.select(
        F.col("external_reference").alias("merchantreferencenumber"),
        F.col("invoice_number").alias("recovery_text"),
    )
    joined = left_join(kept, texts, ["merchantreferencenumber"], ["requestid"])
    joined = joined.join(batch, ["requestid", "merchantid"], "left")
    short_number = (F.length(ref) < 32) & _only(ref, "0-9.")
    recovered, _ = recovery_number(F.col("recovery_text"))
    vendor = (
        ~_only(customer, "0-9.") & sem.blank_to_null(customer).isNotNull()
    ) | F.coalesce(ref, F.lit("")).like(VENDOR_REFERENCE)
    history = Window.partitionBy(
        "merchantid", "merchantreferencenumber", "customerid"
    ).orderBy("requestdate", "requestid")
    day = F.to_date("requestdate")
    return joined.withColumns(
        {
            "transaction_id": F.when(_only(network, "0-9"), network).otherwise(
                F.trim(F.substr(network, F.lit(5)))
            ),
            "txn_origin": F.when(vendor, fv.VENDOR_ORIGIN).otherwise(fv.BILLING_ORIGIN),
            "txn_id": F.when(F.length(ref) == 32, ref),
            "invoice_nbr": F.when(short_number, ref.try_cast("bigint")).otherwise(recovered),
            "pre_dt": F.date_sub(day, 1),
            "post_dt": F.date_add(day, 1),
            "rn": F.row_number().over(history),
            "lead_amt": F.lead("amount").over(history),
            "lag_amt": F.lag("amount").over(history),
        }
    ).drop("recovery_text")


def match_requests(
    disputes: DataFrame, requests: DataFrame, invoices: DataFrame
) -> DataFrame:
    """Disputes with the request of the same network id within a day.

    Each dispute is repeated for the three admissible request dates, which
    turns the date band into an equality and the id plus date into the key.
    """
    days = disputes.withColumn(
        "request_day",
        F.explode(F.sequence(F.date_sub("txn_date", 1), F.date_add("txn_date", 1))),
    )
    req = requests.select(
        "transaction_id",
        F.to_date("requestdate").alias("request_day"),
        "requestdate", "requestid", "networktransactionid", "merchantreferencenumber",
        "transactionrefnumber", "txn_origin", "invoice_nbr", "customerid",
    )
    inv = invoices.select(
        "invoice_nbr", F.col("account_cd").alias("customerid"), F.col("fin").alias("own_fin")
    )
    matched = days.join(req, ["transaction_id", "request_day"])
    found = left_join(matched, inv, ["invoice_nbr", "customerid"], ["requestid", "case_number"])
    return found.withColumn("signup_chk", _signup(F.col("own_fin")))


def _resolved_invoices(invoices: DataFrame, prefix: str) -> DataFrame:
    cols = ("account_cd", "subscription_guid", "invoice_nbr", "country_cd", "fin")
    return invoices.select(*[F.col(c).alias(f"{prefix}{c}") for c in cols])


def processor_a(
    matched: DataFrame, recoveries: DataFrame, invoices: DataFrame, sites: DataFrame
) -> DataFrame:
    """Matched disputes in the common layout, invoices looked up three ways:
    the request's own, the reference read as a number, the vendor's reference.

    ``sites`` (site_id_be, country_cd) is the processor's list of dispute sites.
    """
    direct, via = _resolved_invoices(invoices, "d_"), _resolved_invoices(invoices, "v_")
    number, country = recovery_number(F.col("recovery_text"))
    er = recoveries.select(
        F.col("external_reference").alias("merchantreferencenumber"),
        F.col("invoice_number").alias("recovery_text"),
    ).withColumns({"v_invoice_nbr": number, "v_country_cd": country})
    ref = F.col("merchantreferencenumber")
    numbered = direct.withColumn("merchantreferencenumber", F.col("d_invoice_nbr").cast("string"))
    row = ["requestid", "case_number"]
    joined = left_join(matched, er, ["merchantreferencenumber"], row)
    joined = left_join(joined, numbered, ["merchantreferencenumber"], row)
    joined = left_join(joined, via.withColumn("_hit", F.lit(True)), ["v_invoice_nbr", "v_country_cd"], row)
    joined = joined.join(sites.select("site_id_be", F.col("country_cd").alias("mid_country")), "site_id_be", "left")
    # the number alone says nothing unless the lookup found an invoice
    v_number = F.when(F.col("_hit"), F.col("v_invoice_nbr"))
    short_number = (F.length(ref) < 32) & _only(ref, "0-9.")
    fin = F.coalesce("d_fin", "v_fin")
    return joined.select(
        F.lit("cybersource").alias("gateway"),
        "mid_country",
        F.col("requestid").alias("gateway_txn_id"),
        F.when(short_number, ref)
        .otherwise(F.coalesce("recovery_text", "merchantreferencenumber"))
        .alias("merchant_reference"),
        "networktransactionid",
        "transaction_id",
        "transactionrefnumber",
        F.col("received_date").alias("dispute_date"),
        "txn_date",
        "dispute_reason",
        F.col("chargeback_amount").alias("dispute_amount"),
        "txn_origin",
        F.when(_has_letters(F.col("customerid")), F.col("d_account_cd"))
        .otherwise(F.col("customerid"))
        .alias("account_cd"),
        F.coalesce(_signup(fin), F.col("signup_chk")).alias("signup_chk"),
        F.coalesce("d_subscription_guid", "v_subscription_guid").alias("subscription_guid"),
        F.coalesce(F.col("invoice_nbr"), F.col("d_invoice_nbr"), v_number).alias("invoice_nbr"),
    )


def processor_b(
    disputes: DataFrame,
    attempts: DataFrame,
    recoveries: DataFrame,
    invoices: DataFrame,
    merchants: DataFrame,
    since: dt.date,
) -> DataFrame:
    """The second processor's chargebacks in the common layout.

    ``merchants`` (merchant_account, country_cd) is the list of its merchant accounts.
    """
    ref = F.col("merchant_reference")
    number, country = recovery_number(F.col("recovery_text"))
    er = recoveries.select(
        F.col("external_reference").alias("merchant_reference"),
        F.col("invoice_number").alias("recovery_text"),
    ).withColumns({"v_invoice_nbr": number, "v_country_cd": country})
    txn = attempts.select(
        F.col("transaction_guid").alias("merchant_reference"),
        "txn_subscription_guid",
        F.col("invoice_nbr").alias("t_invoice_nbr"),
        F.col("signup_chk").alias("t_signup"),
    )
    kept = disputes.where(
        (F.col("record_type") == CHARGEBACK_RECORD) & (F.to_date("payment_date") >= F.lit(since))
    )
    via = _resolved_invoices(invoices, "v_").withColumn("_hit", F.lit(True))
    joined = left_join(kept, txn, ["merchant_reference"], ["psp_reference"])
    joined = left_join(joined, er, ["merchant_reference"], ["psp_reference"])
    joined = left_join(joined, via, ["v_invoice_nbr", "v_country_cd"], ["psp_reference"])
    joined = joined.join(
        merchants.select("merchant_account", F.col("country_cd").alias("mid_country")), "merchant_account", "left"
    )
    from_vendor = ref.like(VENDOR_REFERENCE)
    return joined.select(
        F.lit("adyen").alias("gateway"),
        "mid_country",
        F.col("psp_reference").alias("gateway_txn_id"),
        F.when(from_vendor, F.col("recovery_text")).otherwise(ref).alias("merchant_reference"),
        F.lit("").alias("networktransactionid"),
        F.lit("").alias("transaction_id"),
        F.lit("").alias("transactionrefnumber"),
        F.to_date("dispute_date").alias("dispute_date"),
        F.to_date("payment_date").alias("txn_date"),
        "dispute_reason",
        "dispute_amount",
        F.when(from_vendor, fv.VENDOR_ORIGIN).otherwise(fv.BILLING_ORIGIN).alias("txn_origin"),
        F.when(_has_letters(F.col("shopper_reference")), F.col("v_account_cd"))
        .otherwise(F.col("shopper_reference"))
        .alias("account_cd"),
        F.coalesce(_signup(F.col("v_fin")), F.col("t_signup")).alias("signup_chk"),
        F.coalesce("txn_subscription_guid", "v_subscription_guid").alias("subscription_guid"),
        F.coalesce(
            F.col("t_invoice_nbr"), F.when(F.col("_hit"), F.col("v_invoice_nbr"))
        ).alias("invoice_nbr"),
    ).distinct()


def is_fraud() -> Column:
    reason = F.lower("dispute_reason")
    return reason.contains("fraud") | reason.isin(*FRAUD_REASONS)


def dispute_summary(disputes: DataFrame) -> DataFrame:
    """Disputes, signup disputes, amounts and fraud per country, day, origin.

    One row per dispute first: its flags add up to distinct counts, its amounts
    still include the lookups' repetitions, as upstream sums them.
    """
    keys = [
        F.when(F.col("mid_country") == DOMESTIC, "domestic").otherwise("intl").alias("chk"),
        F.col("mid_country"),
        F.col("txn_date").alias("purch_dt"),
        F.col("txn_origin"),
    ]
    names = ["chk", "mid_country", "purch_dt", "txn_origin"]
    first = F.col("gateway") == "cybersource"

    def flag(c: Column) -> Column:
        return F.max(F.when(c, 1).otherwise(0))

    per = disputes.groupBy(*keys, "gateway_txn_id").agg(
        flag(F.col("signup_chk") == "signup").alias("signup"),
        flag(is_fraud()).alias("fraud"),
        flag(is_fraud() & first).alias("fraud_a"),
        F.sum("dispute_amount").alias("amount"),
    )
    signup_id = F.when(F.col("signup") == 1, F.col("gateway_txn_id"))
    return per.groupBy(*names).agg(
        F.count("gateway_txn_id").alias("cb_ct"),
        F.sum("signup").alias("signup_cb_ct"),
        F.min(signup_id).alias("signup_cb_ex1"),
        F.max(signup_id).alias("signup_cb_ex2"),
        F.sum("amount").alias("dispute_amount"),
        F.sum("fraud").alias("fraud_ct"),
        F.sum("fraud_a").alias("cybs_fraud_ct"),
    )


def dispute_rate(disputes: DataFrame, txn: DataFrame) -> DataFrame:
    """Disputes as a share of attempts, per month of purchase."""
    month = F.trunc("dt", "month").alias("mth")
    d = (
        disputes.select(F.col("txn_date").alias("dt"), "gateway_txn_id")
        .distinct()
        .groupBy(month)
        .agg(F.count("gateway_txn_id").alias("dispute_ct"))
    )
    v = (
        txn.select(F.col("trans_dt").alias("dt"))
        .groupBy(month)
        .agg(F.count(F.lit(1)).alias("txn_ct"))
    )
    zero = F.lit(0).cast("long")
    return v.join(d, "mth", "left").select(
        "mth",
        "txn_ct",
        F.coalesce("dispute_ct", zero).alias("dispute_ct"),
        sem.round_ratio(F.coalesce("dispute_ct", zero), F.col("txn_ct"), 5).alias("dispute_rate"),
    )
