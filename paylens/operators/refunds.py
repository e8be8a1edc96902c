"""Set-based refund planning and invoice listings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CURRENCY = "USD"
# two-digit years below this are 20xx (fixed value)
YEAR_PIVOT = 50


def subscription_id(c: Column) -> Column:
    """uuid- prefix for 32 hex digits, dashes aside."""
    s = F.trim(F.coalesce(c, F.lit("")))
    is_uuid = F.replace(s, F.lit("-"), F.lit("")).rlike("^[0-9a-fA-F]{32}$")
    return F.when(is_uuid & ~s.startswith("uuid-"), F.concat(F.lit("uuid-"), s)).otherwise(s)


def account_id(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.when((s == "") | s.startswith("code-"), s).otherwise(F.concat(F.lit("code-"), s))


def refund_date(c: Column) -> Column:
    """yyyy-mm-dd, m/d/yyyy or m/d/yy; anything else is NULL."""
    s = F.trim(c)
    iso = F.when(
        s.rlike(r"^.{4}-.{2}-"), F.to_date(F.try_to_timestamp(F.left(s, F.lit(10)), F.lit("yyyy-MM-dd")))
    )
    parts = F.split(F.replace(s, F.lit(","), F.lit("")), "/")
    number = [F.trim(F.get(parts, F.lit(i))).try_cast("int") for i in range(3)]
    month, day, year = number
    full = F.when(
        year < 100, year + F.when(year < YEAR_PIVOT, 2000).otherwise(1900)
    ).otherwise(year)
    text = F.concat_ws(
        "-",
        F.lpad(full.cast("string"), 4, "0"),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    usable = (F.size(parts) == 3) & full.isNotNull() & month.between(1, 12) & day.between(1, 31)
    slashed = F.when(usable, F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))
    return F.coalesce(iso, slashed)


def invoice_date() -> Column:
    """Billed, else closed, updated or created day."""
    return F.to_date(F.coalesce("billed_at", "closed_at", "updated_at", "created_at"))


def invoice_label() -> Column:
    """Number, else id."""
    return F.coalesce(F.col("number").cast("string"), F.col("id"))


def eligible_invoices(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """Charges of the requested subscriptions that a refund would cover."""
    wanted = requests.select(
        "request_id", "sub_id", F.upper("currency_cd").alias("currency"), "refund_on"
    ).where(F.col("refund_on").isNotNull())
    charges = invoices.where((F.col("type") == "charge") & (F.col("total") > 0)).select(
        subscription_id(F.col("subscription_guid")).alias("sub_id"),
        F.upper("currency").alias("currency"),
        invoice_date().alias("invoice_dt"),
        invoice_label().alias("label"),
        "total",
    )
    return (
        wanted.join(charges, ["sub_id", "currency"])
        .where(F.col("invoice_dt") >= F.col("refund_on"))
        .drop("refund_on")
    )


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Trimmed fields, API ids, parsed date; ``request_id`` names the input row."""
    cleaned = {
        c: F.trim(F.coalesce(c, F.lit("")))
        for c in ("account_cd", "subscription_guid", "refund_dt", "account_note")
    }
    currency = F.col("currency_cd") if "currency_cd" in requests.columns else F.lit("")
    out = requests.withColumns(cleaned).withColumn(
        "currency_cd",
        F.when(F.trim(F.coalesce(currency, F.lit(""))) == "", DEFAULT_CURRENCY).otherwise(
            F.trim(currency)
        ),
    )
    return out.withColumns(
        {
            "sub_id": subscription_id(F.col("subscription_guid")),
            "acc_id": account_id(F.col("account_cd")),
            "refund_on": refund_date(F.col("refund_dt")),
        }
    )


def refund_plan(requests: DataFrame, invoices: DataFrame) -> DataFrame:
    """Dry-run plan: one row per request with the invoices it would refund.

    The list is bounded by one subscription's invoices; it is sorted by invoice
    date, then label.
    """
    norm = normalize_requests(requests)
    lists = (
        eligible_invoices(norm, invoices)
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("invoice_dt", "label"))).alias("found"))
    )
    missing = (F.col("sub_id") == "") | (F.col("acc_id") == "")
    planned = norm.join(lists, "request_id", "left")
    numbers = F.transform("found", lambda x: x["label"])
    empty = F.array().cast("array<string>")
    return planned.select(
        "request_id",
        "account_cd",
        "subscription_guid",
        F.when(missing, "")
        .otherwise("(dry-run) would terminate with refund=none")
        .alias("subscription_state"),
        (~missing & (F.col("account_note") != "")).alias("note_added"),
        (~missing).alias("billing_cleared"),
        F.when(missing, empty).otherwise(F.coalesce(numbers, empty)).alias(
            "refunded_invoice_numbers"
        ),
        F.lit(True).alias("dry_run"),
        F.when(missing, "missing account_cd or subscription_guid").otherwise("").alias("error"),
    )


def notes_to_add(requests: DataFrame, notes: DataFrame, run_date: dt.date) -> DataFrame:
    """Requests whose account has no note of the run date yet."""
    today = notes.where(F.to_date("created_at") == F.lit(run_date)).select(
        account_id(F.col("account_cd")).alias("acc_id")
    )
    return (
        normalize_requests(requests)
        .where(F.col("account_note") != "")
        .join(today.distinct(), "acc_id", "left_anti")
    )


def invoice_listing(subs: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoices of the listed subscriptions; a blank row where there is none."""
    left = subs.select(
        F.trim(F.coalesce("account_cd", F.lit(""))).alias("account_cd"),
        F.trim(F.coalesce("subscription_guid", F.lit(""))).alias("subscription_guid"),
    ).withColumn("sub_id", subscription_id(F.col("subscription_guid")))
    amount = F.format_string("%.2f", F.col("total").cast("double"))
    right = invoices.select(
        subscription_id(F.col("subscription_guid")).alias("sub_id"),
        F.coalesce(invoice_label(), F.lit("")).alias("invoice_number"),
        F.when(F.col("total").isNotNull(), amount).otherwise("").alias("amount"),
        F.trim(F.coalesce("currency", F.lit(""))).alias("currency_cd"),
        F.coalesce(
            F.date_format(F.coalesce("billed_at", "created_at"), "yyyy-MM-dd"), F.lit("")
        ).alias("billed_date"),
    ).where(F.col("sub_id") != "")
    blanks = ("invoice_number", "amount", "currency_cd", "billed_date")
    return left.join(right, "sub_id", "left").select(
        "account_cd",
        "subscription_guid",
        *[F.coalesce(c, F.lit("")).alias(c) for c in blanks],
        F.when(F.col("sub_id") == "", "missing subscription_guid").otherwise("").alias("error"),
    )
