"""Subscription histories: status, churn reason, sequence, cohorts, value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem

ACCOUNT = ("src_system_id", "account_cd")
SUBSCRIPTION = (*ACCOUNT, "subscription_guid")

# tolerance around activation and trial end, in seconds (fixed values)
BAND_SECONDS = 120
WIDE_BAND_SECONDS = 150
WIDE_BAND_SOURCE = 134


def plan_parts(plan_nm: Column, plan_cd: Column) -> dict[str, Column]:
    """Base name, parenthesised qualifier and billing duration of a plan."""
    bare = F.regexp_replace(plan_nm, r"\([^()]*\)", "")
    code = F.lower(plan_cd)
    return {
        "base_plan_nm": F.trim(F.split(bare, " -").getItem(0)),
        "plan_qualifier": sem.extract_or_null(plan_nm, r"\((.*?)\)"),
        "plan_dur": F.when(code.contains("monthly"), "monthly")
        .when(code.contains("annual"), "annual")
        .otherwise("other"),
    }


def bands() -> dict[str, Column]:
    """Tolerance windows around activation and around the end of the trial."""

    def around(c: Column, seconds: int) -> tuple[Column, Column]:
        return sem.add_seconds(c, -seconds), sem.add_seconds(c, seconds)

    wide = F.col("src_system_id") == WIDE_BAND_SOURCE
    activate, trial_end = F.col("activate_dt_ut"), F.col("trial_end_dt_ut")
    pre_w, post_w = around(activate, WIDE_BAND_SECONDS)
    pre, post = around(activate, BAND_SECONDS)
    pre_trial, post_trial = around(trial_end, BAND_SECONDS)
    return {
        "pre_activate": F.when(wide, pre_w).otherwise(pre),
        "post_activate": F.when(wide, post_w).otherwise(post),
        "pre_trial_end": pre_trial,
        "post_trial_end": post_trial,
    }


def derived_times() -> dict[str, Column]:
    """Columns of a history that follow from its other columns."""
    return {**bands(), "activate_dt_et": sem.in_zone(F.col("activate_dt_ut"), fv.BILLING_ZONE)}


def derived_expiration(as_of: dt.date) -> Column:
    """Open monthly/annual subscriptions whose period ended two months ago or
    more have expired at the period end; other open ones get the sentinel."""
    stale = F.to_date("curr_period_end_dt_ut") <= F.add_months(F.lit(as_of), -2)
    return F.coalesce(
        F.col("expiration_dt_ut"),
        F.when((F.col("plan_dur") != "other") & stale, F.col("curr_period_end_dt_ut")),
        sem.ts(sem.OPEN_ENDED),
    )


def _ordered(expiration: Column) -> Window:
    """History order; the subscription id breaks ties."""
    return Window.partitionBy(*ACCOUNT).orderBy(
        "creation_dt_ut", "activate_dt_ut", expiration, "subscription_guid"
    )


def normalize_subs(subs: DataFrame, as_of: dt.date) -> DataFrame:
    """Cleaned subscriptions with their place in the account's history."""
    whole = Window.partitionBy(*ACCOUNT)
    history = _ordered(F.coalesce(F.col("expiration_dt_ut"), sem.ts(sem.OPEN_ENDED)))
    first = F.row_number().over(history)
    out = subs.withColumns(
        {
            **plan_parts(F.col("plan_nm"), F.col("plan_cd")),
            "frn": first,
            # the reverse order of a total order needs no second sort
            "lrn": (F.count(F.lit(1)).over(whole) - first + 1).cast("int"),
            "prior_plan": F.lag("plan_nm").over(history),
            "prior_activation": F.coalesce(
                F.lag("activate_dt_ut").over(history), sem.ts(sem.NO_PRIOR)
            ),
            "next_plan": F.lead("plan_nm").over(history),
            "next_activation": F.coalesce(
                F.lead("activate_dt_ut").over(history), sem.ts(sem.OPEN_ENDED)
            ),
        }
    )
    return out.withColumns(
        {
            **bands(),
            "cancel_dt_ut": F.coalesce("cancel_dt_ut", sem.ts(sem.OPEN_ENDED)),
            "expiration_dt_ut": derived_expiration(as_of),
        }
    )


def sub_status(as_of: dt.date) -> Column:
    """canceled / expired / active by billing-zone days, else the raw status."""
    expires = sem.in_zone(F.col("expiration_dt_ut"), fv.BILLING_ZONE)
    midnight = F.lit(as_of).cast("timestamp")
    return (
        F.when(
            expires.between(
                sem.add_seconds(midnight, -1), sem.ts("2999-12-01 23:59:59")
            ),
            "canceled",
        )
        .when(expires < midnight, "expired")
        .when(F.col("expiration_dt_ut") == sem.ts(sem.OPEN_ENDED), "active")
        .otherwise(F.col("status_desc"))
    )


def cancel_reason(days_mode: str = "periods") -> Column:
    """Why a subscription ended.

    ``days_mode`` decides how the dunning length is counted: complete 24-hour
    ``periods`` or ``calendar`` dates. The two differ when the times of day do.
    """
    start, end = F.col("curr_period_start_dt_ut"), F.col("curr_period_end_dt_ut")
    cancel, expire = F.col("cancel_dt_ut"), F.col("expiration_dt_ut")
    days = sem.whole_days(expire, start) if days_mode == "periods" else F.date_diff(expire, start)
    in_period = cancel.between(start, end)
    after_change = F.to_date(start) > F.lit(fv.POLICY_CHANGE_DATE)
    dunned = days == F.when(after_change, fv.DUNNING_DAYS).otherwise(fv.LEGACY_DUNNING_DAYS)
    return (
        F.when(in_period & (cancel == expire) & dunned, "involuntary_fail_dunning")
        .when(in_period & (cancel != expire) & dunned, "voluntary_cancel_in_dunning_fail")
        .when(
            in_period & (cancel != expire) & (end == expire),
            "voluntary_cancel_expire_end_of_cycle",
        )
        .when(
            (cancel == expire) & (start == cancel), "involuntary_gift_card_expired_no_more_credit"
        )
        .when(F.to_date(cancel) == F.lit(fv.OPEN_ENDED_DATE).cast("date"), None)
        .otherwise("voluntary_likely_agent_cancel")
    )


def sub_category() -> dict[str, Column]:
    """initial/restart, and original/winback split by paid or trial start."""
    frn, trial_end = F.col("frn"), F.col("trial_end_dt_ut")
    path = F.when(trial_end.isNull(), "dtp").otherwise("trial")
    return {
        "subscription_category": F.when(frn == 1, "initial").otherwise("restart"),
        "start_category": F.concat(
            F.when(frn == 1, "original_").otherwise("winback_"), path
        ),
    }


def sub_history(
    subs: DataFrame, as_of: dt.date, days_mode: str = "periods", sources=()
) -> DataFrame:
    """The full subscription history.

    All windows share the (source, account) partitioning, so the history costs
    one shuffle. `prior_expiration` follows the derived expiration and is
    therefore a second pass over the same partitions.
    """
    if sources:
        subs = subs.where(F.col("src_system_id").isin(*sources))
    base = normalize_subs(subs, as_of)
    history = _ordered(F.col("expiration_dt_ut"))
    whole = Window.partitionBy(*ACCOUNT)
    first_only = F.col("frn") == 1
    out = base.withColumns(
        {
            "prior_expiration": F.coalesce(
                F.lag("expiration_dt_ut").over(history), sem.ts(sem.NO_PRIOR)
            ),
            "original_activation": F.max(F.when(first_only, F.col("activate_dt_ut"))).over(
                history
            ),
            "account_earliest_expiration": F.max(
                F.when(first_only, F.col("expiration_dt_ut"))
            ).over(whole),
            "activate_dt_et": sem.in_zone(F.col("activate_dt_ut"), fv.BILLING_ZONE),
            "cancel_chk": cancel_reason(days_mode),
            **sub_category(),
        }
    )
    return out.withColumn("status_desc", sub_status(as_of))


# ------------------------------------------------------------- value


def months_active(as_of: dt.date) -> Column:
    expires = F.to_date("expiration_dt_ut")
    last = F.when(expires >= F.lit(dt.date(2999, 1, 1)), F.lit(as_of)).otherwise(expires)
    return sem.month_boundaries(last, F.to_date("activate_dt_ut"))


def with_value(history: DataFrame, paid: DataFrame, as_of: dt.date) -> DataFrame:
    """Histories with paid amounts and months active."""
    return history.join(paid, list(SUBSCRIPTION), "left").withColumn(
        "mths_active", months_active(as_of)
    )


def ltv_summary(
    valued: DataFrame, cohort_start: dt.date, cohort_end: dt.date, plan_dur: str = "monthly"
) -> DataFrame:
    """Revenue per subscription times average tenure, per source.

    As defined upstream, arpu is over the subscription's lifetime rather than
    per month, and ltv multiplies it with the tenure.
    """
    chosen = valued.where(
        F.to_date("activate_dt_et").between(F.lit(cohort_start), F.lit(cohort_end))
        & (F.col("sub_paid_amt") > 0)
        & (F.col("plan_dur") == plan_dur)
    )
    # one row per subscription first: the distinct count becomes a plain count
    per_sub = chosen.groupBy("src_system_id", "subscription_guid").agg(
        F.sum("sub_paid_total_amt").alias("rev"), F.sum("mths_active").alias("mths")
    )
    totals = per_sub.groupBy("src_system_id").agg(
        F.count("subscription_guid").alias("sub_ct"),
        F.sum("rev").alias("tot_rev"),
        F.sum("mths").alias("tot_mths_active"),
    )
    arpu = sem.ratio(F.col("tot_rev"), F.col("sub_ct"))
    tenure = sem.ratio(F.col("tot_mths_active"), F.col("sub_ct"))
    return totals.withColumns(
        {"arpu": arpu, "avg_tenure": tenure, "ltv": arpu * tenure}
    )


def cohort_subs(valued: DataFrame) -> DataFrame:
    """One row per subscription with its own and its account's cohort month."""

    def month(c: Column) -> Column:
        return F.trunc(F.to_date(c), "month")

    original = sem.in_zone(F.col("original_activation"), fv.BILLING_ZONE)
    return valued.select(
        "src_system_id",
        month(F.col("activate_dt_et")).alias("cohort_dt"),
        month(original).alias("cohort_dt_account"),
        "subscription_guid",
        "account_cd",
        "mths_active",
        "sub_paid_total_amt",
        "sub_paid_amt",
        "activate_dt_et",
        "plan_dur",
        "status_desc",
        "frn",
    )


def retention_curve(cohorts: DataFrame) -> DataFrame:
    """Subscriptions still active n months in, per activation cohort.

    Counting subscriptions per tenure first leaves (cohort, tenure) rows; only
    those are expanded to months, so the expansion does not grow with the data.
    """
    per_tenure = (
        cohorts.where(F.col("mths_active") >= 0)
        .groupBy("cohort_dt", "mths_active")
        .agg(F.count(F.lit(1)).alias("ct"))
    )
    months = per_tenure.select(
        "cohort_dt", "ct", F.explode(F.sequence(F.lit(0), "mths_active")).alias("month_number")
    )
    curve = months.groupBy("cohort_dt", "month_number").agg(F.sum("ct").alias("retained_count"))
    size = F.max("retained_count").over(Window.partitionBy("cohort_dt"))
    return curve.select(
        "cohort_dt",
        "month_number",
        "retained_count",
        sem.ratio(F.col("retained_count"), size).alias("retained_pct"),
    )


def cohort_ltv(cohorts: DataFrame) -> DataFrame:
    per_sub = cohorts.groupBy("cohort_dt", "subscription_guid").agg(
        F.sum("sub_paid_total_amt").alias("rev"), F.sum("mths_active").alias("mths")
    )
    size = F.col("cohort_size")
    return (
        per_sub.groupBy("cohort_dt")
        .agg(
            F.count("subscription_guid").alias("cohort_size"),
            F.sum("rev").alias("total_rev"),
            F.sum("mths").alias("mths"),
        )
        .select(
            "cohort_dt",
            "cohort_size",
            "total_rev",
            sem.ratio(F.col("total_rev"), size).alias("ltv"),
            sem.ratio(F.col("mths"), size).alias("avg_tenure"),
        )
    )


# -------------------------------------------------------- definitions


def mrr(history: DataFrame, as_of: dt.date) -> DataFrame:
    """Recurring amount of subscriptions active on a day, annual plans by 12."""
    day = F.lit(as_of)
    active = (F.to_date("activate_dt_ut") <= day) & (F.to_date("expiration_dt_ut") > day)
    monthly = F.when(
        F.col("plan_dur") == "annual", F.col("total_recur_amt") / F.lit(12)
    ).otherwise(F.col("total_recur_amt"))
    return (
        history.where(active)
        .groupBy("src_system_id", "plan_dur")
        .agg(F.count(F.lit(1)).alias("active_subs"), F.round(F.sum(monthly), 2).alias("mrr"))
    )


def churn(history: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Subscriptions ended in a range over those active at its start."""
    expires, activates = F.to_date("expiration_dt_ut"), F.to_date("activate_dt_ut")
    ended = expires.between(F.lit(start), F.lit(end))
    opening = (activates < F.lit(start)) & (expires >= F.lit(start))

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    reason = F.col("cancel_chk")
    return (
        history.groupBy("src_system_id")
        .agg(
            count(opening).alias("opening_subs"),
            count(ended).alias("churned_subs"),
            count(ended & reason.startswith("voluntary")).alias("voluntary_churn"),
            count(ended & reason.startswith("involuntary")).alias("involuntary_churn"),
        )
        .withColumn(
            "gross_churn_rate", sem.round_ratio(F.col("churned_subs"), F.col("opening_subs"), 5)
        )
    )
