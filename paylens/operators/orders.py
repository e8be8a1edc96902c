"""Orders: attempts that reached a gateway, grouped per invoice or day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators import classify as cl
from paylens.operators.invoices import INVOICE
from paylens.operators.sparse_keys import left_join
from paylens.operators.subscriptions import ACCOUNT, SUBSCRIPTION

# fixed values
GATEWAYS = ("adyen", "cybersource")
NOT_SENT = ("fraud_velocity", "gateway_timeout")
RECURRING_ORIGINS = ("recurring", "force_collect", "api_sub_change")
RULE_DECLINE_CODE, RULE_DECLINE_GATEWAY = "481", "cybersource"
NO_RESPONSE_CODE, NO_RESPONSE_TEXT = "O", "No Response sent"
REPORTED = ("trial_verify", "direct_to_paid", "renewals", "trial_to_paid")
ON_SUB, PRE_SUB = "purch_on_sub", "verify_or_purch_pre_sub"

# what the order rows read from an attempt
ATTEMPT_COLUMNS = (
    *cl.ATTEMPT_COLUMNS, "trans_dt", "trans_gateway_type_desc", "gateway_error_cd", "failure_type",
    "reference_cd",
)


def outcome() -> Column:
    status = F.col("trans_status_desc")
    return F.when(sem.succeeded(status), "success").otherwise(status)


def reached_gateway(attempts: DataFrame) -> DataFrame:
    """Attempts with a gateway reference, or collected by the vendor; those
    stopped by velocity limits or timeouts never got there."""
    sent = sem.blank_to_null(F.col("reference_cd")).isNotNull() | (
        F.col("txn_origin") == fv.VENDOR_ORIGIN
    )
    failure = F.trim(F.coalesce("failure_type", F.lit("")))
    return attempts.where(
        F.col("trans_gateway_type_desc").isin(*GATEWAYS) & ~failure.isin(*NOT_SENT) & sent
    )


def with_latest(attempts: DataFrame) -> DataFrame:
    """Rank from the newest attempt per outcome: per invoice, and per day with
    verifications apart."""
    newest = F.desc("trans_dt_ut")
    verify = F.when(F.col("trans_type_desc") == "verify", "verify")
    out = attempts.withColumns(
        {
            "trans_status_desc_2": outcome(),
            "txn_type": F.when(
                (F.col("trans_type_desc") != "verify") & F.col("subscription_guid").isNotNull(),
                ON_SUB,
            ).otherwise(PRE_SUB),
        }
    )
    # attempts before a subscription count too: they push an older purchase down
    per_invoice = Window.partitionBy(*INVOICE, "trans_status_desc_2").orderBy(newest)
    per_day = Window.partitionBy(*ACCOUNT, verify, "trans_dt", "trans_status_desc_2").orderBy(newest)
    return out.withColumns(
        {
            "latest_txn": F.dense_rank().over(per_invoice),
            "verify_latest_txn": F.dense_rank().over(per_day),
        }
    )


def decline_texts(
    requests: DataFrame, texts: DataFrame, since: dt.date, merchants: Sequence[str] = ()
) -> DataFrame:
    """Issuer response of failed gateway requests as a readable code.

    ``texts`` is the processor's code list (cardtype, issuerresponsecode,
    response_text), passed in as data; unknown pairs become ``other``.
    """
    keep = (F.to_date("requestdate") >= F.lit(since)) & (F.col("overallrcode") == 0)
    if merchants:
        keep &= F.col("merchantid").isin(*merchants)
    named = requests.where(keep).join(texts, ["cardtype", "issuerresponsecode"], "left")
    text = F.when(
        F.col("issuerresponsecode") == NO_RESPONSE_CODE, NO_RESPONSE_TEXT
    ).otherwise(F.coalesce("response_text", F.lit("other")))
    return named.select(
        "requestid",
        "issuerresponsecode",
        F.replace(F.lower(text), F.lit(" "), F.lit("_")).alias("response_desc"),
    )


def with_context(
    attempts: DataFrame, invoices: DataFrame, history: DataFrame, declines: DataFrame
) -> DataFrame:
    """Invoice, subscription and decline reason of each attempt."""
    inv = invoices.select(
        *INVOICE, "invoice_nbr", "adj_amt", "invoice_billed_dt_ut", "invoice_state_desc",
        "invoice_closed_dt_ut", "invoice_type_cd",
    )
    subs = history.select(
        *SUBSCRIPTION,
        F.col("subscription_guid").alias("sub_guid"),
        F.col("activate_dt_et").alias("own_activate_dt_et"),
    )
    rule_decline = (F.col("gateway_error_cd") == RULE_DECLINE_CODE) & (
        F.col("trans_gateway_type_desc") == RULE_DECLINE_GATEWAY
    )
    # verifications have no invoice, and often neither subscription nor reference
    joined = left_join(attempts, inv, list(INVOICE), ["transaction_guid"])
    joined = left_join(joined, subs, list(SUBSCRIPTION), ["transaction_guid"])
    declines = declines.withColumnRenamed("requestid", "reference_cd")
    joined = left_join(joined, declines, ["reference_cd"], ["transaction_guid"])
    return joined.withColumns(
        {
            "decline_cd": F.coalesce("issuerresponsecode", "gateway_error_cd"),
            "decline_desc": F.coalesce(
                F.when(rule_decline, cl.FRAUD).otherwise(F.col("response_desc")), "failure_type"
            ),
        }
    ).drop("issuerresponsecode", "response_desc")


def attempt_counts(context: DataFrame, subs_since: dt.date, since: dt.date) -> DataFrame:
    """First attempt date, attempts per outcome and whether the order won.

    Purchases on a subscription group by invoice, all other attempts by account,
    type and day. The day groups also see same-typed purchases on
    subscriptions, as upstream.
    """
    on_sub = F.col("txn_type") == ON_SUB
    kept = context.where(
        ~on_sub
        | (F.to_date("own_activate_dt_et") >= F.lit(subs_since))
        | F.col("sub_guid").isNull()
    )
    # the invoice groups serve purchases on subscriptions only; the rest is
    # kept apart by its own id
    group = F.when(on_sub, F.coalesce("invoice_guid", F.lit(""))).otherwise(F.col("transaction_guid"))
    invoice = (*ACCOUNT, "txn_type", "_group")
    day = (*ACCOUNT, "trans_type_desc")
    clean = F.when(
        F.trim(F.coalesce("failure_type", F.lit(""))) != cl.FRAUD, F.col("transaction_guid")
    )

    def by_type(value, on_invoice, on_day) -> Column:
        return F.when(on_sub, value.over(on_invoice)).otherwise(value.over(on_day))

    status = "trans_status_desc_2"
    w_inv, w_inv_status = Window.partitionBy(*invoice), Window.partitionBy(*invoice, status)
    w_day_status = Window.partitionBy(*day, "trans_dt", status)
    counted = kept.withColumn("_group", group).withColumns(
        {
            "dt_first_attempt": F.when(on_sub, F.min("trans_dt").over(w_inv)).otherwise(
                F.col("trans_dt")
            ),
            "attempts": by_type(F.count("transaction_guid"), w_inv_status, w_day_status),
            "attempts_no_fraud": by_type(F.count(clean), w_inv_status, w_day_status),
        }
    )
    # one row per attempt from here on
    cols = (
        *ACCOUNT, "invoice_guid", "_group", "transaction_guid", "txn_type", "trans_type_desc",
        status, "dt_first_attempt", "attempts", "attempts_no_fraud",
    )
    rows = (
        counted.select(*cols).distinct().where(F.col("dt_first_attempt") >= F.lit(since))
    )
    w_first = Window.partitionBy(*day, "dt_first_attempt")

    def any_(value: str) -> Column:
        return F.max(F.when(F.col(status) == value, 1).otherwise(0))

    return rows.select(
        *ACCOUNT, "transaction_guid", "dt_first_attempt", "attempts", "attempts_no_fraud",
        by_type(any_("success"), w_inv, w_first).alias("has_success"),
        by_type(any_("declined"), w_inv, w_first).alias("has_declined"),
    )


def order_rows(
    context: DataFrame,
    history: DataFrame,
    since: dt.date,
    as_of: dt.date,
    subs_since: dt.date,
    orders_since: dt.date,
) -> DataFrame:
    """Latest attempts with their counts and the flag that counts an order once."""
    classed = cl.classify(context, history, since, as_of, cl.REACHED)
    counts = attempt_counts(context, subs_since, orders_since)
    on_sub = F.col("txn_type") == ON_SUB
    rows = classed.where(
        (on_sub & (F.col("latest_txn") == 1)) | (~on_sub & (F.col("verify_latest_txn") == 1))
    ).join(counts, [*ACCOUNT, "transaction_guid"])
    newest = (F.desc("trans_dt_ut"), "transaction_guid", "txn_classify", "decline_cd", "decline_desc")
    status = "trans_status_desc_2"
    spread = F.when(~on_sub, F.col("transaction_guid"))
    per_invoice = Window.partitionBy(*INVOICE, spread, status).orderBy(*newest)
    per_day = Window.partitionBy(
        *ACCOUNT, "trans_type_desc", "dt_first_attempt", status
    ).orderBy(*newest)
    per_first = Window.partitionBy(*ACCOUNT, "dt_first_attempt", status).orderBy(*newest)
    number = F.row_number()
    rows = rows.withColumns(
        {
            "row_status": F.when(on_sub, number.over(per_invoice)).otherwise(number.over(per_day)),
            "row_dt_status": F.when(on_sub, number.over(per_first)).otherwise(F.lit(0)),
        }
    )
    first = F.when(on_sub, F.col("row_dt_status") == 1).otherwise(F.col("row_status") == 1)
    counts_once = (F.col(status) == "success") | (
        (F.col(status) == "declined") & (F.col("has_success") == 0)
    )
    return rows.withColumns(
        {
            "account_count": F.when(first & counts_once, 1).otherwise(0),
            "txn_classify": cl.business_class(all_verify=True),
        }
    ).where(F.col("txn_classify").isin(*REPORTED))


def _sum(c: str, status: str | None = None) -> Column:
    value = F.col(c)
    if status:
        value = F.when(F.col("trans_status_desc_2") == status, value)
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def _order_counts() -> list[Column]:
    out = []
    for prefix, c in (
        ("order", "account_count"), ("txn", "attempts"), ("no_fraud_txn", "attempts_no_fraud")
    ):
        out += [
            _sum(c).alias(f"{prefix}_ct"),
            _sum(c, "success").alias(f"{prefix}_success_ct"),
            _sum(c, "declined").alias(f"{prefix}_declined_ct"),
        ]
    return out


def _with_pct(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            f"{p}_success_pct": sem.round_ratio(F.col(f"{p}_success_ct"), F.col(f"{p}_ct"), 5)
            for p in ("order", "txn", "no_fraud_txn")
        }
    )


def _keys() -> list[Column]:
    return [
        F.trunc("dt_first_attempt", "month").alias("mth"),
        F.col("trans_gateway_type_desc"),
        F.col("txn_classify"),
    ]


def order_summary(rows: DataFrame) -> DataFrame:
    """Orders, attempts and attempts without fraud: counts, rates, examples."""
    recurring = F.col("origin_desc").isin(*RECURRING_ORIGINS)
    picks = []
    for prefix, cond in (("", F.lit(True)), ("contauth_", recurring), ("ecomm_", ~recurring)):
        for status in ("success", "declined"):
            value = F.when(
                cond & (F.col("trans_status_desc_2") == status), F.col("reference_cd")
            )
            picks += [
                F.min(value).alias(f"{prefix}{status}_ref_ex1"),
                F.max(value).alias(f"{prefix}{status}_ref_ex2"),
            ]
    return _with_pct(rows.groupBy(*_keys()).agg(*_order_counts(), *picks))


def _top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    order = Window.partitionBy("mth", "trans_gateway_type_desc", "txn_classify").orderBy(
        F.desc(by), *ties
    )
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def top_order_bins(rows: DataFrame, n: int = 50) -> DataFrame:
    """Busiest BINs of each month, gateway and class."""
    grouped = _with_pct(rows.groupBy(*_keys(), "cc_first_6_nbr").agg(*_order_counts()))
    return _top(grouped, n, "txn_ct", "cc_first_6_nbr")


def top_decline_codes(rows: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent decline reasons of each month, gateway and class."""
    grouped = (
        rows.where(F.col("trans_status_desc_2") == "declined")
        .groupBy(*_keys(), "decline_cd", "decline_desc")
        .agg(
            _sum("account_count").alias("order_ct"),
            _sum("attempts").alias("txn_ct"),
            F.min("transaction_guid").alias("ex1"),
            F.max("transaction_guid").alias("ex2"),
        )
    )
    return _top(grouped, n, "txn_ct", "decline_cd", "decline_desc")
