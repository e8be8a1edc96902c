"""Gateway performance: categorised attempts and invoices, success rates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators.calendar import add_months
from paylens.operators.invoices import INVOICE, invoice_rollup
from paylens.operators.subscriptions import ACCOUNT, SUBSCRIPTION, derived_times
from paylens.operators.windows import in_activation_window
from paylens.reuse import computed_once
from paylens.sources.transactions import is_attempt

GATEWAY_BIN = ("trans_gateway_type_desc", "cc_first_6_nbr")
VERIFY_CATEGORIES = ("trial_verify", "other_verify")
GRAINS = ("day", "week", "month", "quarter")
# a renewal this close to the activation pays for it directly
DIRECT_MINUTES = 10

# rule sets of the attempt classifier
BY_WINDOW, BY_BAND = "window", "band"


def scoped_attempts(
    txn: DataFrame, since: dt.date, sources: Sequence[int] = ()
) -> DataFrame:
    keep = is_attempt() & (F.col("trans_dt") >= F.lit(since))
    if sources:
        keep &= F.col("src_system_id").isin(*sources)
    return txn.where(keep).withColumns(
        {
            "subscription_guid": sem.blank_to_null(F.col("subscription_guid")),
            "invoice_guid": sem.blank_to_null(F.col("invoice_guid")),
        }
    )


def change_invoices(txn: DataFrame) -> DataFrame:
    """Invoices with at least one purchase attempt of a plan change."""
    guid = sem.blank_to_null(F.col("invoice_guid"))
    return (
        txn.where(
            (F.col("trans_type_desc") == "purchase")
            & F.col("trans_status_desc").isin(*fv.TRANS_STATUSES)
            & (F.col("origin_desc") == "api_sub_change")
            & guid.isNotNull()
        )
        .select(*ACCOUNT, "invoice_guid")
        .distinct()
        .withColumn("is_change", F.lit(1))
    )


def _near(c: Column, anchor: Column, minutes: int) -> Column:
    return c.between(
        sem.add_seconds(anchor, -60 * minutes), sem.add_seconds(anchor, 60 * minutes)
    )


def categorize_invoices(
    invoices: DataFrame, history: DataFrame, changes: DataFrame, change_first: bool = True
) -> DataFrame:
    """Invoice category; plan changes win first or only where nothing else fits."""
    bands = history.select(
        *SUBSCRIPTION,
        F.col("trial_end_dt_ut").alias("s_trial_end"),
        F.col("activate_dt_ut").alias("s_activate"),
        F.col("pre_activate").alias("s_pre"),
        F.col("post_activate").alias("s_post"),
        F.col("pre_trial_end").alias("s_pre_trial"),
        F.col("post_trial_end").alias("s_post_trial"),
    )
    joined = invoices.join(bands, list(SUBSCRIPTION), "left").join(
        changes, list(INVOICE), "left"
    )
    renewal = F.col("invoice_type_cd") == "renewal"
    billed, trial_end = F.col("invoice_billed_dt_ut"), F.col("s_trial_end")
    rank = F.col("renewal_earliest_inv")
    change = F.col("is_change") == 1
    kind = F.when(change, "change_sub") if change_first else F
    kind = (
        kind.when(
            renewal
            & (F.col("adj_total_amt") > 0)
            & trial_end.isNotNull()
            & billed.between(F.col("s_pre_trial"), F.col("s_post_trial"))
            & (rank == 1),
            "trial_to_paid",
        )
        .when(
            renewal
            & trial_end.isNull()
            & (F.to_date(billed) < F.lit(fv.POLICY_CHANGE_DATE))
            & _near(billed, F.col("s_activate"), DIRECT_MINUTES),
            "direct_to_paid",
        )
        .when(
            (F.col("invoice_type_cd") == "purchase")
            & trial_end.isNull()
            & billed.between(F.col("s_pre"), F.col("s_post")),
            "direct_to_paid",
        )
        .when(renewal & (rank > 1), "recurring")
    )
    if not change_first:
        kind = kind.when(change, "change_sub")
    return joined.withColumn("invoice_category", kind.otherwise("other")).drop(
        "is_change", "s_trial_end", "s_activate", "s_pre", "s_post", "s_pre_trial", "s_post_trial"
    )


def attempt_category(rules: str) -> Column:
    """Category of an attempt; the first matching rule wins.

    The two rule sets differ in direct-to-paid attempts after the policy
    change: by the window of the attempt's own subscription, or by the narrow
    activation band for successes and the account's window for declines.
    """
    kind, status, origin = (
        F.col("trans_type_desc"), F.col("trans_status_desc"), F.col("origin_desc")
    )
    at, billed = F.col("trans_dt_ut"), F.col("invoice_billed_dt_ut")
    purchase, verify = kind == "purchase", kind == "verify"
    renewal = F.col("invoice_type_cd") == "renewal"
    any_status = status.isin(*fv.TRANS_STATUSES)
    no_trial = F.col("sub_trial_end_dt_ut").isNull()
    after_change = F.to_date(at) >= F.lit(fv.POLICY_CHANGE_DATE)
    off_renewal = F.col("invoice_guid").isNull() | (F.col("invoice_type_cd") != "renewal")
    from_api = origin.isin(*fv.API_ORIGINS)

    rule = (
        F.when(purchase & any_status & (origin == "api_sub_change"), "change_sub")
        .when(
            verify
            & sem.succeeded(status)
            & F.col("sub_win_trial_end_dt_ut").isNotNull()
            & at.between(F.col("sub_win_pre_activate"), F.col("sub_win_post_activate")),
            "trial_verify",
        )
        .when(
            verify & sem.declined(status) & F.col("sub_win_subscription_guid").isNotNull(),
            "trial_verify",
        )
        .when(
            purchase
            & renewal
            & F.col("sub_trial_end_dt_ut").isNotNull()
            & billed.between(F.col("sub_pre_trial_end"), F.col("sub_post_trial_end"))
            & (F.col("renewal_earliest_inv") == 1),
            "trial_to_paid",
        )
        .when(
            purchase
            & any_status
            & no_trial
            & renewal
            & (F.to_date(F.coalesce(billed, at)) < F.lit(fv.POLICY_CHANGE_DATE))
            & _near(billed, F.col("sub_activate_dt_ut"), DIRECT_MINUTES),
            "direct_to_paid",
        )
    )
    if rules == BY_WINDOW:
        rule = rule.when(
            purchase
            & any_status
            & from_api
            & no_trial
            & off_renewal
            & after_change
            & at.between(F.col("sub_prior_expiration"), F.col("sub_post_activate")),
            "direct_to_paid",
        )
    elif rules == BY_BAND:
        rule = rule.when(
            purchase
            & sem.succeeded(status)
            & no_trial
            & (F.col("invoice_type_cd") == "purchase")
            & after_change
            & at.between(F.col("sub_pre_activate"), F.col("sub_post_activate")),
            "direct_to_paid",
        ).when(
            purchase
            & sem.declined(status)
            & from_api
            & off_renewal
            & F.col("sub_win_subscription_guid").isNotNull(),
            "direct_to_paid",
        )
    else:
        raise ValueError(f"unknown rule set {rules!r}")
    return (
        rule.when(purchase & any_status & renewal & (F.col("renewal_earliest_inv") > 1), "recurring")
        .when(verify, "other_verify")
        .otherwise("other")
    )


def window_key() -> Column:
    """Invoice id, or a key of the account's activation window."""

    def text(c: str, default: str) -> Column:
        return F.date_format(F.coalesce(c, sem.ts(default)), "yyyy-MM-dd HH:mm:ssx")

    return F.coalesce(
        "invoice_guid",
        F.concat_ws(
            "_",
            F.lit("window"),
            F.col("src_system_id").cast("string"),
            F.col("account_cd"),
            text("sub_win_prior_expiration", sem.NO_PRIOR),
            text("sub_win_activate_dt_ut", sem.OPEN_ENDED),
        ),
    )


def categorized_attempts(
    attempts: DataFrame,
    cat_invoices: DataFrame,
    history: DataFrame,
    since: dt.date,
    rules: str,
    dealt: bool = False,
) -> DataFrame:
    """One row per attempt with invoice, subscription, category and grouper.

    The account's activation window is found before the invoice join, so the
    merge by time carries only attempt columns. Where an invoice or a
    subscription id matches several rows, the first by a fixed order is taken.
    ``dealt`` histories are dealt by account already.
    """
    placed = in_activation_window(attempts, history, since, dealt=dealt)
    inv = cat_invoices.select(
        *INVOICE,
        F.col("subscription_guid").alias("adj_subscription_guid"),
        "invoice_type_cd", "invoice_billed_dt_ut", "adj_total_amt", "renewal_earliest_inv",
        "invoice_category", "invoice_state_desc", "invoice_nbr",
    )
    subs = history.select(
        *SUBSCRIPTION,
        F.col("trial_end_dt_ut").alias("sub_trial_end_dt_ut"),
        F.col("activate_dt_ut").alias("sub_activate_dt_ut"),
        F.col("pre_activate").alias("sub_pre_activate"),
        F.col("post_activate").alias("sub_post_activate"),
        F.col("pre_trial_end").alias("sub_pre_trial_end"),
        F.col("post_trial_end").alias("sub_post_trial_end"),
        F.col("prior_expiration").alias("sub_prior_expiration"),
    )
    # one header per invoice is the rule; where several exist, one is kept
    first_header = Window.partitionBy(*INVOICE).orderBy(
        "invoice_billed_dt_ut", "invoice_nbr", "adj_subscription_guid", "invoice_state_desc"
    )
    inv = (
        inv.repartition(*ACCOUNT).withColumn("_n", F.row_number().over(first_header)).where("_n = 1").drop("_n", "invoice_nbr")
    )
    joined = placed.join(inv, list(INVOICE), "left").join(subs, list(SUBSCRIPTION), "left")
    return joined.withColumns(
        {
            "transaction_category": attempt_category(rules),
            "invoice_grouper": window_key(),
            "invoice_dt_ut": F.coalesce("invoice_billed_dt_ut", "trans_dt_ut"),
        }
    )


# ------------------------------------------------------------ metrics


def _rate(num: Column, den: Column, digits: int | None = 5) -> Column:
    return sem.round_ratio(num, den, digits) if digits is not None else sem.ratio(num, den)


def _ones(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def txn_metrics(base: DataFrame) -> DataFrame:
    return base.groupBy(
        *GATEWAY_BIN, F.col("trans_dt").alias("dt"), F.col("transaction_category").alias("category")
    ).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        _ones(sem.succeeded(F.col("trans_status_desc"))).alias("successful_transactions"),
        F.min("transaction_guid").alias("example_transaction_min"),
        F.max("transaction_guid").alias("example_transaction_max"),
        F.min("account_cd").alias("example_account_min"),
        F.max("account_cd").alias("example_account_max"),
    )


def top_bins(base: DataFrame, n: int = 100) -> DataFrame:
    """BINs with the most attempts; ties go to the smaller BIN."""
    return (
        base.where(F.col("cc_first_6_nbr").isNotNull())
        .groupBy("cc_first_6_nbr")
        .agg(F.count(F.lit(1)).alias("vol"))
        .orderBy(F.desc("vol"), "cc_first_6_nbr")
        .limit(n)
        .select("cc_first_6_nbr")
    )


def keep_top_bins(df: DataFrame, bins: DataFrame) -> DataFrame:
    """At most `n` BINs by construction, hence the broadcast."""
    return df.join(F.broadcast(bins), "cc_first_6_nbr", "left_semi")


def invoice_facts(base: DataFrame, cat_invoices: DataFrame, paid_counts: bool) -> DataFrame:
    """Invoices and verification windows, per gateway and BIN they touched.

    An invoice succeeds if any attempt on it did, wherever that attempt went;
    with ``paid_counts`` also when its state is paid. Attempts are reduced to
    (invoice, gateway, BIN) before the success is spread over the invoice.
    """
    status = F.col("trans_status_desc")
    success = sem.succeeded(status)
    if paid_counts:
        success = success | (F.col("invoice_state_desc") == "paid")
    # the counts, the window and the join below stay in the invoices' partitions
    per_place = (
        base.where(F.col("invoice_guid").isNotNull())
        .repartition(*INVOICE)
        .groupBy(*INVOICE, *GATEWAY_BIN)
        .agg(F.max(F.when(success, 1).otherwise(0)).alias("won"))
        .withColumn("won", F.max("won").over(Window.partitionBy(*INVOICE)))
    )
    headers = cat_invoices.select(*INVOICE, "invoice_billed_dt_ut", "invoice_category")
    headers = headers.repartition(*INVOICE).distinct()
    real = per_place.join(headers, list(INVOICE)).select(
        *GATEWAY_BIN,
        F.to_date("invoice_billed_dt_ut").alias("dt"),
        F.col("invoice_category").alias("category"),
        "won",
        F.col("invoice_guid").alias("example"),
        "account_cd",
    )
    verify = (
        base.where(
            F.col("transaction_category").isin(*VERIFY_CATEGORIES)
            & F.col("invoice_grouper").like("window_%")
        )
        .groupBy(*ACCOUNT, "invoice_grouper", *GATEWAY_BIN, "transaction_category")
        .agg(
            F.min("trans_dt").alias("dt"),
            F.max(F.when(sem.succeeded(status), 1).otherwise(0)).alias("won"),
        )
        .select(
            *GATEWAY_BIN,
            "dt",
            F.col("transaction_category").alias("category"),
            "won",
            F.col("invoice_grouper").alias("example"),
            "account_cd",
        )
    )
    return real.unionByName(verify)


def invoice_metrics(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*GATEWAY_BIN, "dt", "category").agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.sum("won").cast("long").alias("successful_invoices"),
        F.min("example").alias("example_invoice_min"),
        F.max("example").alias("example_invoice_max"),
        F.min("account_cd").alias("example_account_min"),
        F.max("account_cd").alias("example_account_max"),
    )


def combined_days(txn_m: DataFrame, inv_m: DataFrame) -> DataFrame:
    """Attempt and invoice metrics side by side, day grain.

    Written as a union and one aggregate over (day, gateway, BIN, category)
    instead of a full outer join of two aggregates. A NULL key matches nothing
    in the outer join, so such rows are kept apart by their side.
    """
    keys = ["dt", *GATEWAY_BIN, "category"]
    examples = ("example_account_min", "example_account_max")
    t = txn_m.withColumn("side", F.lit(1))
    i = inv_m.withColumn("side", F.lit(2)).withColumnsRenamed({c: f"i_{c}" for c in examples})
    complete = F.col("dt").isNotNull()
    for k in keys[1:]:
        complete &= F.col(k).isNotNull()
    both = t.unionByName(i, allowMissingColumns=True).withColumn(
        "side", F.when(complete, 0).otherwise(F.col("side"))
    )
    zero = F.lit(0).cast("long")
    counts = (
        "total_transactions", "successful_transactions", "total_invoices", "successful_invoices"
    )
    picks = (
        "example_transaction_min", "example_transaction_max", "example_invoice_min",
        "example_invoice_max",
    )
    return (
        both.groupBy(*keys, "side")
        .agg(
            *[F.coalesce(F.sum(c), zero).alias(c) for c in counts],
            *[F.max(c).alias(c) for c in picks],
            *[F.coalesce(F.max(c), F.max(f"i_{c}")).alias(c) for c in examples],
        )
        .drop("side")
    )


def monthly_rollup(days: DataFrame, since: dt.date) -> DataFrame:
    """Success rates per month, gateway and category."""
    counts = (
        "successful_transactions", "total_transactions", "successful_invoices", "total_invoices"
    )
    lows = ("example_transaction_min", "example_invoice_min", "example_account_min")
    highs = ("example_transaction_max", "example_invoice_max", "example_account_max")
    out = (
        days.where((F.col("dt") >= F.lit(since)) & F.col("trans_gateway_type_desc").isNotNull())
        .groupBy(F.trunc("dt", "month").alias("mth"), "trans_gateway_type_desc", "category")
        .agg(
            *[F.sum(c).alias(c) for c in counts],
            *[F.min(c).alias(c) for c in lows],
            *[F.max(c).alias(c) for c in highs],
        )
    )
    return out.withColumns(
        {
            "txn_success_rate": _rate(
                F.col("successful_transactions"), F.col("total_transactions")
            ),
            "inv_success_rate": _rate(F.col("successful_invoices"), F.col("total_invoices")),
        }
    )


def grain_starts(d: Column) -> Column:
    """(grain, first day) pairs of a date; weeks start on Sunday."""
    starts = {
        "day": d,
        "week": sem.week_start_sunday(d),
        "month": F.trunc(d, "month"),
        "quarter": F.trunc(d, "quarter"),
    }
    return F.array(
        *[
            F.struct(F.lit(g).alias("timeframe_type"), starts[g].alias("timeframe_value"))
            for g in GRAINS
        ]
    )


def _by_grain(metrics: DataFrame, counts: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """All grains from one pass over the day metrics."""
    return (
        metrics.withColumn("grain", F.explode(grain_starts(F.col("dt"))))
        .groupBy(*extra, "grain.timeframe_type", "grain.timeframe_value", *GATEWAY_BIN, "category")
        .agg(*[F.sum(c).alias(c) for c in counts])
    )


def multi_grain(txn_m: DataFrame, inv_m: DataFrame) -> DataFrame:
    """Attempt and invoice metrics as separate rows at every grain."""
    nulls = F.lit(None).cast("long")
    t = txn_m.select(
        F.lit("transaction").alias("metric_level"), "dt", *GATEWAY_BIN, "category",
        "total_transactions", "successful_transactions",
        nulls.alias("total_invoices"), nulls.alias("successful_invoices"),
    )
    i = inv_m.select(
        F.lit("invoice").alias("metric_level"), "dt", *GATEWAY_BIN, "category",
        nulls.alias("total_transactions"), nulls.alias("successful_transactions"),
        "total_invoices", "successful_invoices",
    )
    counts = (
        "total_transactions", "successful_transactions", "total_invoices", "successful_invoices"
    )
    return _with_rates(_by_grain(t.unionByName(i), counts, ("metric_level",)))


def combined_grains(days: DataFrame, since: dt.date) -> DataFrame:
    """Attempt and invoice metrics side by side at every grain."""
    counts = (
        "total_transactions", "successful_transactions", "total_invoices", "successful_invoices"
    )
    grains = _with_rates(_by_grain(days, counts))
    return grains.where(
        (F.col("timeframe_value") >= F.lit(since)) & F.col("trans_gateway_type_desc").isNotNull()
    )


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "txn_success_rate": sem.ratio(
                F.col("successful_transactions"), F.col("total_transactions")
            ),
            "inv_success_rate": sem.ratio(F.col("successful_invoices"), F.col("total_invoices")),
        }
    )


# ------------------------------------------------------------ reports

# what attempts and invoice facts read from a categorised invoice
CATEGORY_COLUMNS = (
    *INVOICE, "subscription_guid", "invoice_nbr", "invoice_type_cd", "invoice_billed_dt_ut",
    "adj_total_amt", "renewal_earliest_inv", "invoice_category", "invoice_state_desc",
)


def _parts(
    txn: DataFrame,
    lines: DataFrame,
    history: DataFrame,
    since: dt.date,
    rules: str,
    change_first: bool,
    invoice_since: dt.date | None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    # times that follow from others are computed where they are read, not moved
    history = history.select(*HISTORY_COLUMNS).repartition(*ACCOUNT).withColumns(derived_times())
    invoices = invoice_rollup(lines, invoice_since or add_months(since, -1))
    cat = categorize_invoices(invoices, history, change_invoices(txn), change_first)
    cat = computed_once(cat.select(*CATEGORY_COLUMNS), dealt=True)
    attempts = scoped_attempts(txn, since)
    narrow = attempts.select(*ATTEMPT_COLUMNS)
    base = categorized_attempts(narrow, cat, history, since, rules, dealt=True)
    return computed_once(base.select(*BASE_COLUMNS), dealt=True), cat, attempts


# what categories read from a subscription's history
HISTORY_COLUMNS = (*SUBSCRIPTION, "activate_dt_ut", "trial_end_dt_ut", "prior_expiration")
# what categories and metrics read from an attempt
ATTEMPT_COLUMNS = (
    *INVOICE, *GATEWAY_BIN, "subscription_guid", "transaction_guid", "trans_dt", "trans_dt_ut",
    "trans_type_desc", "trans_status_desc", "origin_desc",
)
# what is read from a categorised attempt; all joins up to it are inside an account
BASE_COLUMNS = (
    *INVOICE, *GATEWAY_BIN, "transaction_guid", "trans_dt", "trans_status_desc",
    "transaction_category", "invoice_category", "invoice_grouper", "invoice_state_desc",
    "sub_win_subscription_guid",
)


def gateway_comparison(
    txn: DataFrame, lines: DataFrame, history: DataFrame, since: dt.date
) -> DataFrame:
    """Monthly success of attempts and invoices by gateway and category."""
    base, cat, _ = _parts(txn, lines, history, since, BY_WINDOW, True, None)
    days = combined_days(
        txn_metrics(base), invoice_metrics(invoice_facts(base, cat, paid_counts=True))
    )
    return monthly_rollup(days, since)


def gateway_grains(
    txn: DataFrame, lines: DataFrame, history: DataFrame, since: dt.date, top: int = 100
) -> DataFrame:
    """Side-by-side metrics at day/week/month/quarter for the busiest BINs."""
    base, cat, attempts = _parts(txn, lines, history, since, BY_WINDOW, True, None)
    bins = top_bins(attempts, top)
    days = combined_days(
        keep_top_bins(txn_metrics(base), bins),
        keep_top_bins(invoice_metrics(invoice_facts(base, cat, paid_counts=False)), bins),
    )
    return combined_grains(days, since)


def gateway_by_bin(
    txn: DataFrame, lines: DataFrame, history: DataFrame, since: dt.date, top: int = 100
) -> DataFrame:
    """Attempt rows and invoice rows at every grain.

    Restricted to the busiest BINs before anything is counted, so an invoice's
    success sees only their attempts.
    """
    base, cat, attempts = _parts(txn, lines, history, since, BY_BAND, False, since)
    base = keep_top_bins(base, top_bins(attempts, top))
    return multi_grain(
        txn_metrics(base), invoice_metrics(invoice_facts(base, cat, paid_counts=False))
    )
