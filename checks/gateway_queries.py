"""Gateway performance reports."""

from __future__ import annotations

import datetime as dt

from checks import oracle_gateway as orc
from checks.classify_queries import tables
from checks.oracle_lifecycle import AS_OF
from checks.registry import register
from paylens.operators import gateway as gw
from paylens.plans import gateway_reports as gr

SINCE = dt.date(2024, 6, 1)
# the fixture has ten BINs
TOP = 4


def _report(build, **kw):
    return lambda spark, sf_dir: build(tables(spark, sf_dir), SINCE, AS_OF, **kw)


def _categories(rules: str):
    def run(spark, sf_dir):
        t = tables(spark, sf_dir)
        base, _, _ = gw._parts(
            t.txn, t.lines, gr.category_history(t, AS_OF), SINCE, rules, True, None
        )
        return base.select(
            "transaction_guid",
            "transaction_category",
            "invoice_category",
            "invoice_grouper",
            "sub_win_subscription_guid",
        )

    return run


register("attempt_categories_window", _categories(gw.BY_WINDOW), orc.category_sql("window"))
register("attempt_categories_band", _categories(gw.BY_BAND), orc.category_sql("band"))
register("gateway_comparison", _report(gr.comparison), orc.comparison_sql())
register("gateway_grains", _report(gr.grains, top=TOP), orc.grains_sql(TOP))
register("gateway_by_bin", _report(gr.by_bin, top=TOP), orc.by_bin_sql(TOP))
