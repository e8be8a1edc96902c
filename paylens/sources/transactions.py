"""Reading and scoping payment attempts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.functions import fixed_values as fv
from paylens.functions import semantics as sem

TXN_COLUMNS = (
    "src_system_id", "account_cd", "subscription_guid", "invoice_guid", "transaction_guid",
    "trans_dt", "trans_dt_ut", "origin_desc", "trans_type_desc", "trans_status_desc",
    "trans_amt", "tax_amt", "currency_cd", "country_cd", "trans_gateway_type_desc",
    "gateway_cd", "gateway_error_cd", "failure_type", "payment_method_desc", "cc_type_desc",
    "cc_first_6_nbr", "card_brand_nm", "card_type_cd", "card_level_cd", "card_issuer_nm",
    "card_issuing_country_cd", "approval_desc", "avs_result_cd", "trans_msg_desc", "reference_cd",
)

# near-real-time column -> canonical column, where the names differ
NRT_RENAMES = {
    "account_code": "account_cd",
    "subscription_id": "subscription_guid",
    "invoice_id": "invoice_guid",
    "transaction_id": "transaction_guid",
    "date": "trans_dt_ut",
    "origin": "origin_desc",
    "type": "trans_type_desc",
    "status": "trans_status_desc",
    "amount": "trans_amt",
    "tax_amount": "tax_amt",
    "currency": "currency_cd",
    "country": "country_cd",
    "transaction_gateway_type": "trans_gateway_type_desc",
    "gateway_code": "gateway_cd",
    "gateway_error_codes": "gateway_error_cd",
    "payment_method": "payment_method_desc",
    "cc_type": "cc_type_desc",
    "cc_first_6": "cc_first_6_nbr",
    "card_brand": "card_brand_nm",
    "card_type": "card_type_cd",
    "card_level": "card_level_cd",
    "card_issuer": "card_issuer_nm",
    "card_issuing_country": "card_issuing_country_cd",
    "approval_code": "approval_desc",
    "avs_result": "avs_result_cd",
    "message": "trans_msg_desc",
    "reference": "reference_cd",
}


def norm_bin(c: Column) -> Column:
    """Float-like BIN text to its rounded integer text."""
    return sem.round_to_long(c.cast("double")).cast("string")


def is_attempt() -> Column:
    return F.col("trans_type_desc").isin(*fv.TRANS_TYPES) & F.col("trans_status_desc").isin(
        *fv.TRANS_STATUSES
    )


def txn_scope(
    txn: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    sources: Sequence[int] = (),
    origins: Sequence[str] | None = fv.API_ORIGINS,
    method: str | None = fv.CARD_METHOD,
    bins: Sequence[str] = (),
    avs_not_passed: bool = False,
) -> DataFrame:
    """Analysed attempts: only predicates, so all of them reach the scan.

    An empty ``sources``/``bins`` and a None ``origins``/``method`` mean no
    restriction.
    """
    keep = is_attempt()
    if start is not None:
        keep &= F.col("trans_dt") >= F.lit(start)
    if end is not None:
        keep &= F.col("trans_dt") <= F.lit(end)
    if sources:
        keep &= F.col("src_system_id").isin(*sources)
    if origins is not None:
        keep &= F.col("origin_desc").isin(*origins)
    if method is not None:
        keep &= F.col("payment_method_desc") == method
    if bins:
        keep &= F.col("cc_first_6_nbr").isin(*bins)
    if avs_not_passed:
        keep &= sem.avs_not_passed(F.col("avs_result_cd"))
    return txn.where(keep)


def project_txn(txn: DataFrame) -> DataFrame:
    """The canonical projection, limited to the columns the input carries."""
    present = set(txn.columns)
    return txn.select(*[c for c in TXN_COLUMNS if c in present])


def from_nrt(nrt: DataFrame) -> DataFrame:
    """Near-real-time rows in the historical layout."""
    out = nrt.withColumnsRenamed({k: v for k, v in NRT_RENAMES.items() if k in nrt.columns})
    return project_txn(
        out.withColumns(
            {
                "account_cd": F.col("account_cd").cast("string"),
                "cc_first_6_nbr": norm_bin(F.col("cc_first_6_nbr")),
                "trans_dt": sem.zone_date(F.col("trans_dt_ut"), fv.REPORT_ZONE),
            }
        )
    )


def nrt_union(nrt: DataFrame, hist: DataFrame, dedupe: bool = True) -> DataFrame:
    """Near-real-time rows on top of history.

    ``dedupe`` drops rows that are equal in every column, which moves every row
    through a shuffle. Distinct counts and min/max are unchanged by repeated
    rows, so the anomaly jobs pass ``dedupe=False``.
    """
    both = from_nrt(nrt).where(is_attempt()).unionByName(project_txn(hist).where(is_attempt()))
    return both.distinct() if dedupe else both
