import datetime as dt
from decimal import Decimal

from paylens.operators import invoices as inv
from paylens.operators import subscriptions as sub

AS_OF = dt.date(2026, 4, 1)
SUB_SCHEMA = (
    "src_system_id long, account_cd string, subscription_guid string, plan_cd string, plan_nm string, "
    "total_recur_amt decimal(18,2), status_desc string, creation_dt_ut timestamp, activate_dt_ut timestamp, "
    "trial_end_dt_ut timestamp, curr_period_start_dt_ut timestamp, curr_period_end_dt_ut timestamp, "
    "cancel_dt_ut timestamp, expiration_dt_ut timestamp"
)


def d(*a):
    return dt.datetime(*a)


def subs(spark, *rows):
    data = []
    for i, r in enumerate(rows):
        base = dict(
            src=115, acc="a", guid=f"S{i}", cd="x-monthly", nm="Base (Q) - Monthly", trial=None,
            act=d(2025, 1, 1), start=d(2025, 3, 1), end=d(2025, 4, 1), cancel=None, exp=None,
        )
        base.update(r)
        data.append(
            (base["src"], base["acc"], base["guid"], base["cd"], base["nm"], Decimal("12.00"), "future",
             base["act"], base["act"], base["trial"], base["start"], base["end"], base["cancel"], base["exp"])
        )
    return spark.createDataFrame(data, SUB_SCHEMA)


def history(spark, *rows, **kw):
    out = sub.sub_history(subs(spark, *rows), AS_OF, **kw).orderBy("frn").collect()
    return out if len(out) > 1 else out[0]


def test_open_subscription_whose_period_ended_long_ago_has_expired(spark):
    assert history(spark, {}).expiration_dt_ut == d(2025, 4, 1)
    edge = history(spark, {"end": d(2026, 2, 1)})  # exactly two months
    assert edge.expiration_dt_ut == d(2026, 2, 1)
    still = history(spark, {"end": d(2026, 2, 2)})
    assert still.expiration_dt_ut == d(2999, 12, 31, 23, 59, 59) and still.status_desc == "active"
    assert history(spark, {"cd": "special"}).status_desc == "active"


def test_plan_parts(spark):
    r = history(spark, {"nm": "Family (Gift) - Monthly"})
    assert (r.base_plan_nm, r.plan_qualifier, r.plan_dur) == ("Family", "Gift", "monthly")
    assert history(spark, {"nm": "Basic"}).plan_qualifier is None


def test_dunning_length_follows_the_policy_change(spark):
    def reason(start, days, same=True):
        exp = start + dt.timedelta(days=days)
        cancel = exp if same else start + dt.timedelta(days=3)
        row = {"start": start, "end": start + dt.timedelta(days=30), "cancel": cancel, "exp": exp}
        return history(spark, row).cancel_chk

    before, after = d(2025, 11, 6), d(2025, 11, 7)
    assert reason(before, 28) == "involuntary_fail_dunning"
    assert reason(before, 27) == "voluntary_likely_agent_cancel"
    assert reason(after, 27) == "involuntary_fail_dunning"
    assert reason(after, 27, same=False) == "voluntary_cancel_in_dunning_fail"
    assert reason(after, 30, same=False) == "voluntary_cancel_expire_end_of_cycle"
    assert reason(after, 0) == "involuntary_gift_card_expired_no_more_credit"


def test_dunning_days_mode(spark):
    row = {
        "start": d(2025, 1, 1, 12), "end": d(2025, 2, 10), "cancel": d(2025, 1, 29, 11), "exp": d(2025, 1, 29, 11),
    }
    assert history(spark, row).cancel_chk == "voluntary_likely_agent_cancel"  # 27 periods
    assert history(spark, row, days_mode="calendar").cancel_chk == "involuntary_fail_dunning"


def test_status_changes_at_billing_zone_midnight(spark):
    # midnight in New York on 2026-04-01 is 04:00 UTC
    assert history(spark, {"exp": d(2026, 4, 1, 3, 59, 58)}).status_desc == "expired"
    assert history(spark, {"exp": d(2026, 4, 1, 4, 0, 0)}).status_desc == "canceled"


def test_sequence_and_bands(spark):
    rows = history(
        spark,
        {"act": d(2024, 1, 1), "exp": d(2024, 2, 1), "nm": "One"},
        {"act": d(2024, 3, 1), "exp": d(2024, 4, 1), "nm": "Two", "trial": d(2024, 3, 8)},
    )
    first, second = rows
    assert (first.frn, first.lrn, second.frn, second.lrn) == (1, 2, 2, 1)
    assert second.prior_expiration == d(2024, 2, 1) and first.next_activation == d(2024, 3, 1)
    assert first.prior_expiration == d(1900, 1, 1, 0, 0, 1)
    assert second.original_activation == d(2024, 1, 1)
    assert (first.start_category, second.start_category) == ("original_dtp", "winback_trial")
    wide = history(spark, {"src": 134})
    assert (wide.post_activate - wide.activate_dt_ut).seconds == 150
    assert (first.post_activate - first.activate_dt_ut).seconds == 120


def test_retention_counts_every_month_up_to_the_tenure(spark):
    rows = spark.createDataFrame(
        [(dt.date(2024, 1, 1), 0), (dt.date(2024, 1, 1), 2), (dt.date(2024, 2, 1), 1)],
        "cohort_dt date, mths_active int",
    )
    got = {(r.cohort_dt.month, r.month_number): (r.retained_count, r.retained_pct) for r in sub.retention_curve(rows).collect()}
    assert got == {(1, 0): (2, 1.0), (1, 1): (1, 0.5), (1, 2): (1, 0.5), (2, 0): (1, 1.0), (2, 1): (1, 1.0)}


def lines(spark, rows):
    data = [
        (115, "a", "S", g, n, d(2025, 1, n), d(2025, 1, n), d(2025, 2, n), t, "paid", d(2025, 1, n), None,
         "credit" if t == "gift_card" else "charge", "Gift Card", Decimal(a), Decimal(a), dt.date(2025, 1, n))
        for g, n, t, a in rows
    ]
    return spark.createDataFrame(
        data,
        "src_system_id long, account_cd string, subscription_guid string, invoice_guid string, invoice_nbr long, "
        "invoice_billed_dt_ut timestamp, start_dt_ut timestamp, end_dt_ut timestamp, invoice_type_cd string, "
        "invoice_state_desc string, invoice_closed_dt_ut timestamp, coupon_cd string, type_desc string, "
        "adj_desc string, adj_amt decimal(18,2), adj_total_amt decimal(18,2), creation_dt date",
    )


def test_gift_card_pays_the_next_invoice_only_if_it_covers_it(spark):
    got = {
        r.invoice_guid: r
        for r in inv.invoice_rollup(
            lines(
                spark,
                [
                    ("I1", 1, "gift_card", "-10"), ("I2", 2, "renewal", "4"), ("I2", 2, "renewal", "5"),
                    ("I3", 3, "renewal", "9"), ("I4", 4, "gift_card", "-3"), ("I5", 5, "renewal", "9"),
                ],
            )
        ).collect()
    }
    assert got["I2"].paid_by_gc_chk == "paid_by_gift_card" and got["I2"].adj_amt == 9
    assert got["I3"].paid_by_gc_chk == "null" and got["I5"].paid_by_gc_chk == "null"
    assert got["I1"].gift_card_chk == 1 and got["I2"].renewal_earliest_inv == 1
    assert got["I1"].renewal_earliest_inv is None and got["I3"].earliest_inv == 3


def test_dunning_looks_at_the_first_and_last_attempt(spark):
    def att(rows):
        return spark.createDataFrame(
            [(115, "a", "S", g, f"T{i}", at, o, "purchase", s, v) for i, (g, at, o, s, v) in enumerate(rows)],
            "src_system_id long, account_cd string, subscription_guid string, invoice_guid string, "
            "transaction_guid string, trans_dt_ut timestamp, origin_desc string, trans_type_desc string, "
            "trans_status_desc string, txn_origin string",
        )

    rows = [
        ("I1", d(2025, 1, 1), "recurring", "declined", "recurly"),
        ("I1", d(2025, 1, 2), "api", "success", "recurly"),
        ("I2", d(2025, 1, 1), "recurring", "success", "recurly"),
        ("I3", d(2025, 1, 1), "recurring", "declined", "recurly"),
        ("I3", d(2025, 1, 5), "recurring", "success", "vindicia"),
    ]
    got = {r.invoice_guid: (r.dun_chk, r.dun_paid_type, r.vindicia_chk) for r in inv.dunning(att(rows)).collect()}
    assert got == {"I1": (1, "cust_paid", 0), "I2": (0, None, 0), "I3": (1, "vindicia_paid", 1)}
    rate = inv.recovery_rate(att(rows), 3).first()
    assert (rate.failed_invoices, rate.recovered_invoices, rate.recovery_rate) == (2, 1, 0.5)
