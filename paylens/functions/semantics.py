"""Column helpers that pin down the numeric and date semantics of the jobs.

Rounding is done on integers wherever a ratio is rounded, so a half-way value
rounds away from zero exactly instead of depending on its binary image.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def ts(text: str) -> Column:
    """Literal UTC timestamp."""
    return F.lit(text).cast("timestamp")


NO_PRIOR = fv.NO_PRIOR_TS
OPEN_ENDED = fv.OPEN_ENDED_TS


def round_to_long(x: Column) -> Column:
    """Float to integer, half away from zero (a plain cast truncates)."""
    return F.round(x).cast("long")


def mean_half_up(total: Column, n: Column) -> Column:
    """Mean of non-negative whole numbers, rounded half up; NULL when n is 0."""
    return F.when(n > 0, F.call_function("div", total * 2 + n, n * 2))


def div_half_up(num: Column, den: Column) -> Column:
    """Integer quotient rounded half away from zero; NULL when ``den`` is 0.

    ``den`` must not be negative and ``num`` must stay below 2**62.
    """
    size = F.call_function("div", F.abs(num) * 2 + den, den * 2)
    return F.when(den > 0, F.signum(num).cast("long") * size)


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """``round(num / den, digits)`` for integer operands, as a double."""
    scale = 10**digits
    return div_half_up(num * F.lit(scale).cast("long"), den) / F.lit(float(scale))


def ratio(num: Column, den: Column) -> Column:
    """Unrounded safe division."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def sample_stddev(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from moments; NULL below two values.

    The numerator is the small difference of large numbers, so that it is taken
    on exact decimals; only its root is a double.
    """
    n, total, squares = (x.cast("decimal(38,0)") for x in (n, total, squares))
    spread = (squares * n - total * total).cast("double")
    pairs = n.cast("double") * (n.cast("double") - 1)
    return F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / pairs))


def week_start_sunday(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def month_boundaries(later: Column, earlier: Column) -> Column:
    """Number of month boundaries crossed between two dates."""
    return (F.year(later) * 12 + F.month(later)) - (F.year(earlier) * 12 + F.month(earlier))


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour periods between two timestamps."""
    return F.timestamp_diff("DAY", earlier, later)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def extract_or_null(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def in_zone(c: Column, zone: str) -> Column:
    """Wall-clock time of a UTC instant in a zone."""
    return F.from_utc_timestamp(c, zone)


def zone_date(c: Column, zone: str) -> Column:
    return F.to_date(in_zone(c, zone))


def zone_hour(c: Column, zone: str) -> Column:
    return F.hour(in_zone(c, zone))


def add_seconds(c: Column, seconds: int) -> Column:
    return c + F.expr(f"INTERVAL '{seconds}' SECOND")


def flag_by_score(score: Column, threshold: float) -> Column:
    """large_increase / large_decrease / NULL; the threshold is inclusive."""
    return F.when(score >= F.lit(float(threshold)), F.lit("large_increase")).when(
        score <= F.lit(-float(threshold)), F.lit("large_decrease")
    )


def market(gateway_cd: Column) -> Column:
    """Gateway code to market; unknown codes fall through unchanged."""
    out = F
    for region, codes in fv.GATEWAYS_BY_MARKET.items():
        out = out.when(gateway_cd.isin(*codes), region)
    return out.otherwise(gateway_cd)


def succeeded(status: Column) -> Column:
    return status.isin(*fv.SUCCESS_STATUSES)


def declined(status: Column) -> Column:
    return status == fv.DECLINED_STATUS


def avs_failed(avs: Column) -> Column:
    """AVS present and not a pass (NULL stays unknown)."""
    return ~avs.isin(*fv.AVS_PASSED)


def avs_not_passed(avs: Column) -> Column:
    """AVS not a pass, counting a missing result as not passed."""
    return ~F.coalesce(avs, F.lit("")).isin(*fv.AVS_PASSED)
