"""Null-safe arithmetic, rounding and band labels.

Sums that must not depend on row order are taken over scaled integers (``scaled``), which are exact, and
divided back once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import spec


def clean(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(value), value)


def to_float(value: Column) -> Column:
    return clean(value.try_cast("double"))


def to_int(value: Column) -> Column:
    return value.try_cast("bigint")


def to_bool(value: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return t.isin(*spec.TRUE_WORDS) | F.coalesce(t.try_cast("double") != 0, F.lit(False))


def rounded(value: Column, digits: int) -> Column:
    """Half-even on the scaled binary value."""
    return F.rint(value * float(10**digits)) / float(10**digits)


def scaled(value: Column, digits: int) -> Column:
    """Fixed-point integer of ``value`` with ``digits`` decimals, for order-free exact sums."""
    return F.rint(value * float(10**digits)).cast("bigint")


def unscaled(total: Column, digits: int) -> Column:
    return total.cast("double") / float(10**digits)


def first_present(*names: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names])


def percent_to_ratio(value: Column) -> Column:
    return F.when(F.abs(value) > 1, value / 100.0).otherwise(value)


def to_yi(amount: Column) -> Column:
    return amount / 1e8


def market_cap_yi(price: Column, shares: Column) -> Column:
    return price * shares / 1e8


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def return_pct(now: Column, base: Column) -> Column:
    """Change in percent; NULL on a zero base."""
    return (F.try_divide(now, base) - 1.0) * 100.0


def rolling_return_pct(now: Column, base: Column) -> Column:
    return F.try_divide(now - base, base) * 100.0


def yoy_pct(current: Column, previous: Column) -> Column:
    return F.try_divide(current - previous, F.abs(previous)) * 100.0


def gross_margin(direct_pct: Column, revenue: Column, op_cost: Column) -> Column:
    return F.coalesce(percent_to_ratio(direct_pct), F.try_divide(revenue - op_cost, revenue))


def annualized_eps(quarter: Column, eps: Column) -> Column:
    return F.when(quarter == 4, eps).when(quarter == 1, eps * 4.0).when(quarter == 2, eps * 2.0).when(quarter == 3, eps * 4.0 / 3.0)


def ttm_eps(quarter: Column, eps: Column, prev_annual: Column, prev_same: Column) -> Column:
    full = eps.isNotNull() & prev_annual.isNotNull() & prev_same.isNotNull()
    return (
        F.when(quarter == 4, eps)
        .when(full, eps + prev_annual - prev_same)
        .otherwise(annualized_eps(quarter, eps))
    )


def clamp_heat(value: Column, limit: float = 5.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(value, F.lit(0.0))))


def band(value: Column, bands) -> Column:
    out: Column | None = None
    for upper, label in bands:
        if upper is None:
            return out.when(value.isNotNull(), label)
        out = F.when(value < upper, label) if out is None else out.when(value < upper, label)
    return out


def percentile_band(value: Column) -> Column:
    return band(value, spec.PERCENTILE_BANDS)


def temperature_label(value: Column) -> Column:
    return band(value, spec.TEMPERATURE_BANDS)


def trend(current: Column, previous: Column, lower_is_better: Column) -> Column:
    """unknown / cautious / positive, by the indicator's good direction. No change counts as positive."""
    worse = F.when(lower_is_better, current > previous).otherwise(current < previous)
    return (
        F.when(current.isNull() | previous.isNull(), "unknown")
        .when(worse, "cautious")
        .otherwise("positive")
    )


def yoy_direction(yoy: Column, lower_is_better: Column) -> Column:
    good = F.when(lower_is_better, yoy < 0).otherwise(yoy > 0)
    return F.when(yoy.isNull(), "unknown").when(yoy == 0, "flat").when(good, "positive").otherwise("cautious")


def empirical_percentile(below: Column, equal: Column, size: Column) -> Column:
    """Percentile of a value from how many sample members lie below and at it.

    Empty sample: NULL. One member: 100. Ties take the average rank. An absent value takes its insertion rank.
    """
    tied = (2 * below + 1 + equal) / 2.0 / size * 100.0
    absent = F.least(below + 1, size) / size * 100.0
    return F.when(size == 1, 100.0).when((size > 1) & (equal > 0), tied).when(size > 1, absent)
