"""Reporting periods and trading days.

A period is ``2025Q1|Q2|Q3|A``. Two integers derive from it: ``period_ord = year*10 + quarter`` sorts, and
``period_idx = year*4 + quarter - 1`` is dense, so "one quarter earlier" is plain subtraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Lookups instead of CASE chains: each input column appears once, so stacked period expressions stay small after the
# optimizer has merged projections.
QUARTER_ENDS = (331, 630, 930, 1231)
QUARTER_SUFFIX = ("Q1", "Q2", "Q3", "A")
MONTH_SUFFIX = ("A", "A", "Q1", "Q1", "Q1", "Q2", "Q2", "Q2", "Q3", "Q3", "Q3", "A")


def _pick(table: tuple[str, ...], position: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in table]), position)


def period_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), _pick(QUARTER_SUFFIX, quarter.cast("int")))


def period_from_yyyymmdd(value: Column) -> Column:
    """Quarter-end months name their quarter; any other month falls into the last finished quarter."""
    month = F.floor(value / 100) % 100
    return F.concat(F.floor(value / 10000).cast("string"), _pick(MONTH_SUFFIX, month.cast("int")))


def strict_period_label(text: Column) -> Column:
    """Only the four quarter ends are labelled; anything else passes through."""
    t = F.trim(text)
    tail = F.substring(t, 5, 4)
    suffix = F.when(tail == "0331", "Q1").when(tail == "0630", "Q2").when(tail == "0930", "Q3").when(tail == "1231", "A")
    ok = t.rlike(r"^\d{8}$") & suffix.isNotNull()
    return F.when(ok, F.concat(F.substring(t, 1, 4), suffix)).otherwise(t)


def period_year(period: Column) -> Column:
    return F.substring(period, 1, 4).try_cast("int")


def period_quarter(period: Column) -> Column:
    return F.translate(F.right(period, F.lit(1)), "A", "4").try_cast("int")


def period_ord(period: Column) -> Column:
    return period_year(period) * 10 + period_quarter(period)


def period_idx(period: Column) -> Column:
    return period_year(period) * 4 + period_quarter(period) - 1


def period_from_idx(idx: Column) -> Column:
    return period_label(F.floor(idx / 4).cast("int"), (idx % 4 + 1).cast("int"))


def period_end_yyyymmdd(period: Column) -> Column:
    ends = F.array(*[F.lit(x) for x in QUARTER_ENDS])
    return period_year(period) * 10000 + F.coalesce(F.try_element_at(ends, period_quarter(period)), F.lit(1231))


def period_end_day(period: Column) -> Column:
    return F.last_day(F.make_date(period_year(period), period_quarter(period) * 3, F.lit(1)))


def previous_year_date(report_date: Column) -> Column:
    return report_date - 10000


def announce_date(raw: Column) -> Column:
    """YYMMDD number to YYYYMMDD; two-digit years below 50 are 20xx; unknown is 0."""
    v = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    v = F.when(F.isnan(v), 0.0).otherwise(v).cast("int")
    century = F.when(F.floor(v / 10000) < 50, 20000000).otherwise(19000000)
    return F.when(v == 0, 0).otherwise(v + century).cast("int")


def strict_day(text: Column) -> Column:
    """Keep only well-formed YYYY-MM-DD strings."""
    t = F.trim(text)
    return F.when(t.rlike(r"^.{4}-.{2}-.{2}$"), t)


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def cutoff_text(day: Column) -> Column:
    return F.concat(day_text(day), F.lit(" 15:00:00"))


def year_to_date(day: Column, anchor: Column) -> Column:
    return (day >= F.trunc(anchor, "YEAR")) & (day <= anchor)
