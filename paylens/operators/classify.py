"""Detailed attempt classes: every attempt assigned to an invoice and a class."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem
from paylens.operators.intervals import interval_join
from paylens.operators.invoices import INVOICE
from paylens.operators.subscriptions import ACCOUNT, SUBSCRIPTION
from paylens.reuse import computed_once

# prefixes of synthetic (negative) invoice numbers, per fallback (fixed values)
NO_TRIAL_INVOICE, NO_CARD_CHANGE_INVOICE, NO_ACTIVATION = "-999", "-888", "-777"

# rule sets of the detailed classifier
STANDARD, REACHED = "standard", "reached"

FRAUD = "fraud_gateway"

# what the assignment and the rules read from an attempt
ATTEMPT_COLUMNS = (
    *INVOICE, "subscription_guid", "transaction_guid", "trans_dt_ut", "trans_type_desc",
    "trans_status_desc", "origin_desc",
)


def with_start_type(history: DataFrame, start_types: DataFrame) -> DataFrame:
    return history.join(start_types, ["src_system_id", "subscription_guid"], "left")


def with_start_type_dealt(
    history: DataFrame, subs: DataFrame, start_types: DataFrame
) -> DataFrame:
    """`with_start_type` for histories that are dealt by account.

    The start types take the account of their subscription and are dealt by it,
    so that only keys move, not the histories. An account that is not known
    meets its start types by the subscription alone.
    """
    known = F.col("account_cd").isNotNull()
    by_id = ("src_system_id", "subscription_guid")
    # no more keys than subscriptions, however often those repeat
    accounts = subs.where(known).select(*SUBSCRIPTION).repartition(*by_id).distinct()
    typed = start_types.join(accounts, list(by_id)).repartition(*ACCOUNT)
    named = history.where(known).join(typed, list(SUBSCRIPTION), "left")
    return named.unionByName(with_start_type(history.where(~known), start_types))


def _synthetic(prefix: str) -> Column:
    # an account that is no number is an error here: it must not lose its invoices unnoticed
    account = F.col("account_cd").cast("decimal(28,0)") * F.lit(10000).cast("decimal(5,0)")
    return F.concat(F.lit(prefix), account.cast("string"), F.lit("1")).cast("decimal(38,0)")


def assign_invoices(
    attempts: DataFrame, invoices: DataFrame, history: DataFrame, since: dt.date, as_of: dt.date
) -> DataFrame:
    """Give every attempt an invoice number.

    Attempts that carry no invoice fall back to, in order: the first invoice of
    the subscription activated next, its zero-amount trial invoice, the invoice
    of the period after a card change, or a synthetic negative number. An
    attempt inside several windows keeps a row per window.
    """
    number = F.col("invoice_nbr").cast("decimal(38,0)")
    own = invoices.select(
        *INVOICE, number.alias("own_nbr"), F.col("earliest_inv").alias("own_rank")
    )
    own_sub = history.select(*SUBSCRIPTION).distinct().withColumn("has_sub", F.lit(True))
    windows = history.select(
        *ACCOUNT,
        F.col("subscription_guid").alias("pre_guid"),
        F.coalesce("prior_expiration", sem.ts(sem.NO_PRIOR)).alias("prior_expiration"),
        F.coalesce("post_activate", F.lit(as_of).cast("timestamp")).alias("post_activate"),
    )
    base = attempts.join(own, list(INVOICE), "left").join(own_sub, list(SUBSCRIPTION), "left")
    placed = interval_join(
        base, windows, F.col("trans_dt_ut"), "prior_expiration", "post_activate", since, as_of
    )

    # the trial's first invoice: nothing to pay, or paid by gift card
    amount = F.when(F.col("paid_by_gc_chk") == "paid_by_gift_card", F.lit(0)).otherwise(
        F.col("adj_total_amt")
    )
    trial = invoices.where((F.col("earliest_inv") == 1) & (amount == 0)).select(
        *ACCOUNT, F.col("subscription_guid").alias("pre_guid"), number.alias("trial_nbr")
    )
    trial = trial.groupBy(*ACCOUNT, "pre_guid").agg(F.min("trial_nbr").alias("trial_nbr"))
    no_invoice = F.col("invoice_guid").isNull()
    # first invoices paid by an attempt inside a window, per window
    first = F.max(F.when(F.col("own_rank") == 1, F.col("own_nbr")))
    placed = placed.join(trial, [*ACCOUNT, "pre_guid"], "left").withColumn(
        "first_nbr", first.over(Window.partitionBy(*ACCOUNT, "pre_guid"))
    )

    verify, purchase = (F.col("trans_type_desc") == k for k in ("verify", "purchase"))
    current = history.select(
        *ACCOUNT,
        F.col("subscription_guid").alias("cur_guid"),
        F.col("plan_dur").alias("cur_dur"),
        F.col("activate_dt_ut").alias("cur_from"),
        F.col("expiration_dt_ut").alias("cur_to"),
    )
    # only verifications without an invoice look at periods
    is_verify = (F.col("p.trans_type_desc") == "verify") & F.col("p.invoice_guid").isNull()
    placed = interval_join(
        placed, current, F.col("trans_dt_ut"), "cur_from", "cur_to", since, as_of, when=is_verify
    )
    periods = invoices.select(
        *ACCOUNT,
        number.alias("change_nbr"),
        F.to_date("start_dt_ut").alias("period_from"),
        F.to_date("end_dt_ut").alias("period_to"),
    ).distinct()
    next_period = F.add_months(
        F.to_date("trans_dt_ut"), F.when(F.col("cur_dur") == "annual", 12).otherwise(1)
    )
    placed = interval_join(
        placed,
        periods,
        next_period,
        "period_from",
        "period_to",
        since,
        dt.date(as_of.year + 2, 1, 1),
        when=is_verify & F.col("p.cur_guid").isNotNull(),
    )

    unknown_sub = F.col("has_sub").isNull()
    in_window = F.col("pre_guid").isNotNull()
    assigned = (
        F.when(
            no_invoice & unknown_sub & in_window & purchase, F.coalesce("first_nbr", "trial_nbr")
        )
        .when(
            no_invoice & unknown_sub & in_window & verify,
            F.coalesce("trial_nbr", _synthetic(NO_TRIAL_INVOICE)),
        )
        .when(
            no_invoice & F.col("cur_guid").isNotNull() & verify,
            F.coalesce("change_nbr", _synthetic(NO_CARD_CHANGE_INVOICE)),
        )
        .when(no_invoice & unknown_sub & ~in_window, _synthetic(NO_ACTIVATION))
        .otherwise(F.col("own_nbr"))
    )
    return placed.select(
        *attempts.columns,
        assigned.alias("invoice_nbr"),
        F.coalesce(F.when(~unknown_sub, F.col("subscription_guid")), F.col("pre_guid")).alias(
            "sub_guid"
        ),
        F.col("prior_expiration").alias("win_prior_expiration"),
        F.col("post_activate").alias("win_post_activate"),
    ).distinct()


def with_invoice_state(assigned: DataFrame, invoices: DataFrame) -> DataFrame:
    """Success of the assigned invoice, its state, type and billing time.

    Success is kept per (invoice, subscription) as upstream does, so an invoice
    shared by two subscriptions gives a row for each outcome.
    """
    key = [*ACCOUNT, "invoice_nbr"]
    of_invoice = Window.partitionBy(*key)
    known = F.lit(True)
    for k in key:
        known &= F.col(k).isNotNull()
    won = F.max(F.when(sem.succeeded(F.col("trans_status_desc")), 1).otherwise(0))
    last = F.when(F.col("invoice_nbr") < 0, F.max("trans_dt_ut").over(of_invoice))
    # the subscriptions of an invoice have one outcome or both
    outcomes = F.array_distinct(
        F.array(F.min("_won").over(of_invoice), F.max("_won").over(of_invoice))
    )
    outcome = (
        assigned.withColumn("_won", won.over(Window.partitionBy(*key, "sub_guid")))
        .withColumns({"_won": F.when(known, outcomes), "last_attempt": F.when(known, last)})
        .select(
            *assigned.columns, F.explode_outer("_won").alias("success_ind"), "last_attempt"
        )
    )
    headers = invoices.select(
        *ACCOUNT,
        F.col("invoice_nbr").cast("decimal(38,0)").alias("invoice_nbr"),
        "adj_amt",
        "invoice_billed_dt_ut",
        "invoice_state_desc",
        "invoice_closed_dt_ut",
        "invoice_type_cd",
    ).distinct()
    joined = outcome.join(headers, key, "left")
    synthetic = F.col("invoice_nbr") < 0
    return joined.withColumns(
        {
            "invoice_billed_dt_ut": F.coalesce("invoice_billed_dt_ut", "last_attempt"),
            "invoice_state_desc": F.when(
                synthetic & (F.col("success_ind") == 1), "paid"
            )
            .when(synthetic & (F.col("success_ind") == 0), "not_paid")
            .otherwise(F.col("invoice_state_desc")),
        }
    ).drop("last_attempt")


# subscription columns the classifier looks at
_RULE_COLUMNS = (
    "activate_dt_ut", "post_activate", "prior_activation", "prior_expiration", "expiration_dt_ut",
    "next_activation", "pre_trial_end", "post_trial_end",
)
# attributes collapsed to one value per attempt
_ATTRIBUTES = (
    "subscription_guid", "plan_cd", "plan_nm", "plan_dur", "original_activation", "prior_activation",
    "creation_dt_ut", "activate_dt_ut", "trial_start_dt_ut", "trial_end_dt_ut", "expiration_dt_ut",
    "prior_expiration", "next_activation", "overall_sub_start_type_desc",
)


def _reaches(history: DataFrame) -> DataFrame:
    """Intervals in which a subscription claims an attempt, one row per kind."""
    first = F.col("prior_activation") == sem.ts(sem.NO_PRIOR)
    again = F.col("prior_expiration") > sem.ts(sem.NO_PRIOR)
    last = F.col("next_activation") == sem.ts(sem.OPEN_ENDED)

    def reach(kind: str, cond: Column, start: Column, end: Column) -> Column:
        return F.when(
            cond, F.struct(F.lit(kind).alias("kind"), start.alias("from"), end.alias("to"))
        )

    kinds = F.array(
        reach("band", F.lit(True), F.col("pre_activate"), F.col("post_activate")),
        reach("first", first, F.col("prior_activation"), F.col("post_activate")),
        reach(
            "again", again, sem.add_seconds(F.col("prior_expiration"), -30), F.col("post_activate")
        ),
        reach("never", last, F.col("expiration_dt_ut"), sem.add_seconds(F.col("next_activation"), 90)),
    )
    cols = [c for c in dict.fromkeys((*_RULE_COLUMNS, *_ATTRIBUTES)) if c in history.columns]
    return history.select(
        *ACCOUNT,
        *[F.col(c).alias(f"_sub_{c}") for c in cols],
        F.explode(F.array_compact(kinds)).alias("r"),
    ).select(
        *ACCOUNT,
        *[f"_sub_{c}" for c in cols],
        F.col("r.kind").alias("reach_kind"),
        F.col("r.from").alias("reach_from"),
        F.col("r.to").alias("reach_to"),
    )


def _claims() -> Column:
    """May this attempt be claimed through this kind of interval?"""
    kind, status = F.col("p.trans_type_desc"), F.col("p.trans_status_desc")
    own = F.col("p.subscription_guid")
    success = (
        (F.col("i.reach_kind") == "band")
        & sem.succeeded(status)
        & (
            ((kind == "purchase") & (own == F.col("i._sub_subscription_guid")))
            | ((kind == "verify") & own.isNull())
        )
    )
    failed = (
        (F.col("i.reach_kind") != "band")
        & own.isNull()
        & (
            ((kind == "purchase") & (status == "declined"))
            | ((kind == "verify") & status.isin("void", "declined"))
        )
    )
    return F.col("p.origin_desc").isin(*fv.API_ORIGINS) & (success | failed)


def attempt_class(rules: str = STANDARD) -> Column:
    """Class of an attempt; the first matching rule wins.

    `reached`, used where only attempts that got to the gateway are kept, also
    takes forced collections for trial removals and knows plan changes by their
    exact origins.
    """
    kind, status, origin = (
        F.col("trans_type_desc"), F.col("trans_status_desc"), F.col("origin_desc")
    )
    at, billed, type_cd = F.col("trans_dt_ut"), F.col("invoice_billed_dt_ut"), F.col("invoice_type_cd")
    none, never_again = sem.ts(sem.NO_PRIOR), sem.ts(sem.OPEN_ENDED)
    api = origin.isin(*fv.API_ORIGINS)
    verify, purchase = kind == "verify", kind == "purchase"
    good, bad = sem.succeeded(status), sem.declined(status)
    any_status = status.isin(*fv.TRANS_STATUSES)
    unknown_account = F.col("ever_sub").isNull()

    sub, own = (lambda c: F.col(f"_sub_{c}")), (lambda c: F.col(f"_own_{c}"))
    first_time = at.between(sub("prior_activation"), sub("post_activate")) & (
        sub("prior_activation") == none
    )
    coming_back = at.between(sub("prior_expiration"), sub("post_activate")) & (
        sub("prior_expiration") > none
    )
    not_back_yet = at.between(
        sub("expiration_dt_ut"), sem.add_seconds(sub("next_activation"), 90)
    ) & (sub("next_activation") == never_again)
    removed_trial = (
        purchase
        & any_status
        & (type_cd == "renewal")
        & billed.between(own("activate_dt_ut"), sem.add_seconds(own("post_activate"), 8 * 60))
    )
    restart_removed = removed_trial & (own("prior_expiration") > none)
    if rules == STANDARD:
        restart_removed &= F.trim(F.coalesce(origin, F.lit(""))) != "force_collect"
        plan_change = origin.like("%sub%change%")
    elif rules == REACHED:
        plan_change = origin.isin("recurly_admin_sub_ch", "api_sub_change")
    else:
        raise ValueError(f"unknown rule set {rules!r}")
    return (
        F.when(
            api & verify & ((bad & (first_time | unknown_account)) | (good & first_time)),
            "auth_initial",
        )
        .when(api & verify & any_status & (coming_back | not_back_yet), "auth_restart")
        .when(api & verify, "auth_card-update")
        .when(verify, "auth_other")
        .when(
            api & purchase & ((any_status & first_time) | (bad & unknown_account)),
            "purch_initial",
        )
        .when(removed_trial & (own("prior_activation") == none), "purch_initial_trial_removed")
        # as upstream, the open-ended window is not limited to declines
        .when(
            api & purchase & ((bad & coming_back) | not_back_yet | (good & coming_back)),
            "purch_restart",
        )
        .when(restart_removed, "purch_restart_trial_removed")
        .when(
            purchase
            & (type_cd == "renewal")
            & billed.between(own("pre_trial_end"), own("post_trial_end"))
            & any_status,
            "purch_trial-to-paid",
        )
        .when(
            purchase
            & type_cd.isin("renewal", "immediate_change")
            & billed.between(
                own("post_trial_end"), sem.add_seconds(own("post_trial_end"), 75 * 60)
            )
            & any_status,
            "purch_trial-upgrade-to-paid",
        )
        .when(type_cd == "renewal", "recurring")
        .when((origin == "force_collect") & purchase & any_status, "purch_auto-card-update")
        .when(purchase & ((type_cd == "immediate_change") | plan_change), "purch_sub_change")
        .otherwise(
            F.concat(F.lit("unclassified_"), origin, F.lit("_"), F.coalesce(type_cd, F.lit("")))
        )
    )


def classify(
    attempts: DataFrame, history: DataFrame, since: dt.date, as_of: dt.date, rules: str = STANDARD
) -> DataFrame:
    """Attempts with their class and one value per subscription attribute.

    The disjunctive join is a single interval join over typed intervals; an
    attempt claimed by several subscriptions can carry several classes and
    keeps a row for each.
    """
    cols = [c for c in dict.fromkeys((*_RULE_COLUMNS, *_ATTRIBUTES)) if c in history.columns]
    ever = history.select(*ACCOUNT).distinct().withColumn("ever_sub", F.lit(True))
    own = history.select(*SUBSCRIPTION, *[F.col(c).alias(f"_own_{c}") for c in cols])
    base = attempts.join(own, list(SUBSCRIPTION), "left").join(ever, list(ACCOUNT), "left")
    claimed = interval_join(
        base,
        _reaches(history),
        F.col("trans_dt_ut"),
        "reach_from",
        "reach_to",
        since,
        as_of,
        when=_claims(),
    )
    same = Window.partitionBy(*ACCOUNT, "transaction_guid")
    defaults = {"original_activation", "prior_activation"} if rules == STANDARD else set()
    attributes = {}
    for c in cols:
        if c not in _ATTRIBUTES:
            continue
        parts = [F.col(f"_sub_{c}"), F.col(f"_own_{c}")]
        if c == "subscription_guid":
            parts.insert(0, F.col("subscription_guid"))
        if c in defaults:
            parts.append(sem.ts(sem.NO_PRIOR))
        attributes[f"sub_{c}"] = F.max(F.coalesce(*parts)).over(same)
    out = claimed.withColumn("txn_classify", attempt_class(rules)).withColumns(attributes)
    # equal rows become one; the attributes depend on the attempt alone, and as
    # aggregates those that nobody reads are not computed
    return out.groupBy(*attempts.columns, "txn_classify").agg(
        *[F.max(c).alias(c) for c in attributes]
    )


def with_details(
    classified: DataFrame, next_rows: bool = True, dealt: bool = False
) -> DataFrame:
    """Fraud flag of the invoice and, optionally, what comes next.

    The rows are dealt by account once, unless they are ``dealt`` so already;
    all windows stay in its partitions.
    """
    is_fraud = F.trim(F.coalesce("failure_type", F.lit(""))) == FRAUD
    # attempts of an account without an invoice form a group of their own
    invoice = Window.partitionBy(*ACCOUNT, "invoice_nbr")
    rows = classified if dealt else classified.repartition(*ACCOUNT)
    out = rows.withColumn("fraud_chk", F.max(F.when(is_fraud, 1).otherwise(0)).over(invoice))
    if not next_rows:
        return out
    order = Window.partitionBy(*ACCOUNT, "sub_guid").orderBy(
        "trans_dt_ut", "transaction_guid", "invoice_nbr", "txn_classify", "success_ind",
        "win_prior_expiration",
    )
    return out.withColumns(
        {
            "next_inv_nbr": F.lead("invoice_nbr").over(order),
            "next_inv_dt": F.lead("invoice_billed_dt_ut").over(order),
            "next_txn_classify": F.lead("txn_classify").over(order),
        }
    )


def business_class(fix_sub_change: bool = False, all_verify: bool = False) -> Column:
    """Roll the detailed classes up.

    The roll-up tests for a spelling of the plan-change class the classifier
    never produces; ``fix_sub_change`` maps the produced spelling instead.
    ``all_verify`` counts every verification as a trial one.
    """
    c = F.col("txn_classify")
    trial = c.startswith("auth") if all_verify else c.isin("auth_initial", "auth_restart")
    direct = [
        "purch_initial", "purch_initial_trial_removed", "purch_restart",
        "purch_restart_trial_removed", "purch_auto-card-update",
    ]
    change = "purch_sub_change" if fix_sub_change else "purch_sub-change"
    if all_verify:
        direct.append(change)
    out = F.when(trial, "trial_verify").when(c.startswith("purch_trial"), "trial_to_paid")
    out = out.when(c.isin(*direct), "direct_to_paid")
    if not all_verify:
        out = out.when(c == change, "sub_change")
    return out.when(c == "recurring", "renewals").otherwise(c)


# -------------------------------------------------------------- reports

_REPORT_COLUMNS = (
    "src_system_id", "account_cd", "transaction_guid", "invoice_nbr", "trans_dt_ut",
    "trans_status_desc", "trans_gateway_type_desc", "failure_type", "invoice_billed_dt_ut",
    "invoice_state_desc", "success_ind", "fraud_chk", "txn_classify",
    "sub_overall_sub_start_type_desc",
)
GROUP = ("src_system_id", "dt", "overall_sub_start_type_desc", "trans_gateway_type_desc", "txn_classify")


def _report_rows(details: DataFrame, fix_sub_change: bool) -> DataFrame:
    not_fraud = F.trim(F.coalesce("failure_type", F.lit(""))) != FRAUD
    return details.select(*_REPORT_COLUMNS).withColumns(
        {
            "overall_sub_start_type_desc": F.coalesce(
                "sub_overall_sub_start_type_desc", F.lit("new_start")
            ),
            "txn_classify": business_class(fix_sub_change),
            "clean": not_fraud,
        }
    )


def _distinct_counts(
    rows: DataFrame, unit: str, flags: dict[str, Column], examples: dict[str, Column]
) -> DataFrame:
    """Distinct units per flag: one row per unit first, then sums of flags.

    A unit's flags travel as the bits of one number.
    """
    known = F.col(unit).isNotNull()
    marks = [F.when(c & known, 1 << i).otherwise(0) for i, c in enumerate([*flags.values(), *examples.values()])]
    per_unit = rows.groupBy(*GROUP, unit).agg(F.bit_or(reduce(Column.bitwiseOR, marks)).alias("_bits"))
    has = [F.getbit("_bits", F.lit(i)).cast("int") for i in range(len(marks))]
    counts = [F.sum(bit).alias(n) for n, bit in zip(flags, has, strict=False)]
    picks = []
    for n, bit in zip(examples, has[len(flags) :], strict=True):
        value = F.when(bit == 1, F.col(unit))
        picks += [F.min(value).alias(f"{n}_ex1"), F.max(value).alias(f"{n}_ex2")]
    # few rows; computed here so that the units are counted in small partitions
    return computed_once(per_unit.groupBy(*GROUP).agg(*counts, *picks))


def _rates(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.withColumns(
        {n: sem.round_ratio(F.col(a), F.col(b), 5) for n, (a, b) in pairs.items()}
    )


def mixed_report(
    details: DataFrame, fix_sub_change: bool = False, stored: bool = False
) -> DataFrame:
    """Attempt and invoice success per month, start type, gateway and class.

    ``stored`` details are a table, which is read twice instead of written anew.
    """
    rows = _report_rows(details, fix_sub_change).withColumn(
        "dt", F.trunc(F.to_date(F.coalesce("invoice_billed_dt_ut", "trans_dt_ut")), "month")
    )
    rows = rows if stored else computed_once(rows)
    good, bad = sem.succeeded(F.col("trans_status_desc")), sem.declined(F.col("trans_status_desc"))
    clean, any_ = F.col("clean"), F.lit(True)
    won, lost, no_fraud = (
        F.col("success_ind") == 1, F.col("success_ind") == 0, F.col("fraud_chk") == 0
    )
    txn = _distinct_counts(
        rows,
        "transaction_guid",
        {
            "txn_success_ct": good, "txn_decline_ct": bad, "txn_tot_ct": any_,
            "no_fraud_txn_success_ct": good & clean, "no_fraud_txn_decline_ct": bad & clean,
            "no_fraud_txn_tot_ct": clean,
        },
        {"txn_success": good, "txn_decline": bad, "no_fraud_txn_decline": bad & clean},
    )
    inv = _distinct_counts(
        rows,
        "invoice_nbr",
        {
            "inv_success_ct": won, "inv_decline_ct": lost, "inv_tot_ct": any_,
            "no_fraud_inv_success_ct": won & no_fraud, "no_fraud_inv_decline_ct": lost & no_fraud,
            "no_fraud_inv_tot_ct": no_fraud,
        },
        {"inv_success": F.col("invoice_state_desc") == "paid", "inv_decline": lost},
    )
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"i.{k}")) for k in GROUP]
    joined = txn.alias("t").join(inv.alias("i"), same).select(
        *[F.col(f"t.{k}") for k in GROUP],
        *[F.col(f"t.{c}") for c in txn.columns if c not in GROUP],
        *[F.col(f"i.{c}") for c in inv.columns if c not in GROUP],
    )
    return _rates(
        joined,
        {
            f"{p}{k}_success_rate": (f"{p}{k}_success_ct", f"{p}{k}_tot_ct")
            for p in ("", "no_fraud_")
            for k in ("txn", "inv")
        },
    )


def level_report(
    details: DataFrame, fix_sub_change: bool = False, stored: bool = False
) -> DataFrame:
    """The same counts as separate attempt and invoice rows, each dated by its
    own event in the reporting zone; ``stored`` as in `mixed_report`."""
    rows = _report_rows(details, fix_sub_change)
    rows = rows if stored else computed_once(rows)

    def month(c: str) -> Column:
        return F.trunc(sem.zone_date(F.col(c), fv.REPORT_ZONE), "month")

    good, bad = sem.succeeded(F.col("trans_status_desc")), sem.declined(F.col("trans_status_desc"))
    clean, any_ = F.col("clean"), F.lit(True)
    paid = F.coalesce(F.col("invoice_state_desc"), F.lit("")) == "paid"
    won = F.coalesce(F.col("success_ind") == 1, F.lit(False)) | paid
    lost, no_fraud = (F.col("success_ind") == 0) & ~paid, F.col("fraud_chk") == 0

    def counts(df: DataFrame, level: str, unit: str, g, b, ok) -> DataFrame:
        return _distinct_counts(
            df,
            unit,
            {
                "success_ct": g, "decline_ct": b, "tot_ct": any_,
                "no_fraud_success_ct": g & ok, "no_fraud_decline_ct": b & ok, "no_fraud_tot_ct": ok,
            },
            {"success": g, "decline": b, "no_fraud_decline": b & ok},
        ).withColumn("metric_level", F.lit(level))

    txn = counts(
        rows.withColumn("dt", month("trans_dt_ut")), "txn", "transaction_guid", good, bad, clean
    )
    inv = counts(
        rows.withColumns(
            {
                "dt": month("invoice_billed_dt_ut"),
                "invoice_nbr": F.col("invoice_nbr").cast("string"),
            }
        ),
        "invoice", "invoice_nbr", won, lost, no_fraud,
    )
    return _rates(
        txn.unionByName(inv),
        {
            f"{p}success_rate": (f"{p}success_ct", f"{p}tot_ct") for p in ("", "no_fraud_")
        },
    )


def one_class_per_account_day(details: DataFrame) -> DataFrame:
    """The last class by name of every account and day.

    The maximum is what a descending row number would keep, without a sort.
    """
    return details.groupBy(
        "src_system_id", F.to_date(F.coalesce("invoice_billed_dt_ut", "trans_dt_ut")).alias("dt"),
        "account_cd",
    ).agg(F.max("txn_classify").alias("txn_classify"))


def repeated_transactions(classified: DataFrame) -> DataFrame:
    """Attempts that carry more than one class or invoice."""
    return (
        classified.groupBy(*ACCOUNT, "transaction_guid")
        .agg(F.count(F.lit(1)).alias("row_ct"), F.count_distinct("txn_classify").alias("class_ct"))
        .where(F.col("row_ct") > 1)
    )
