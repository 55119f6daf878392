"""Statement rows in time: neighbours on the dense period index, trailing sums, latest and previous rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import periods as P

KEY = ("market", "symbol")


def steps_back(column: str, k: Column | int) -> Column:
    """Value exactly k quarters earlier, NULL over a gap: a value frame on the dense index, not a row offset."""
    return F.max(column).over(W.partitionBy(*KEY).orderBy("period_idx").rangeBetween(-k, -k))


def with_neighbours(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <c>_q1.._q3 (three previous quarters), <c>_prev_annual and <c>_prev_same for every column.

    All frames share one partitioning and order, so the neighbours cost one shuffle and no self-join.
    """
    q = P.period_quarter(F.col("period"))
    out = rows
    for c in columns:
        b1, b2, b3, b4 = (steps_back(c, k) for k in (1, 2, 3, 4))
        annual = F.when(q == 1, b1).when(q == 2, b2).when(q == 3, b3).when(q == 4, b4)
        out = out.select(
            "*", b1.alias(f"{c}_q1"), b2.alias(f"{c}_q2"), b3.alias(f"{c}_q3"), annual.alias(f"{c}_prev_annual"), b4.alias(f"{c}_prev_same"))
    return out


def ttm(c: str) -> Column:
    """Trailing twelve months: four quarters if all are there, else cumulative arithmetic, else the current value."""
    now, q1, q2, q3 = F.col(c), F.col(f"{c}_q1"), F.col(f"{c}_q2"), F.col(f"{c}_q3")
    annual, same = F.col(f"{c}_prev_annual"), F.col(f"{c}_prev_same")
    interim = P.period_quarter(F.col("period")) != 4
    quarters = now.isNotNull() & q1.isNotNull() & q2.isNotNull() & q3.isNotNull()
    cumulative = interim & now.isNotNull() & annual.isNotNull() & same.isNotNull()
    return F.when(quarters, now + (q1 + q2 + q3)).when(cumulative, now + annual - same).otherwise(now)


def latest(rows: DataFrame) -> DataFrame:
    """Newest period per code."""
    w = W.partitionBy(*KEY).orderBy(F.col("period_ord").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def warehouse_periods(rows: DataFrame) -> DataFrame:
    """Distinct periods with their predecessor in the warehouse. A handful of rows per year."""
    periods = rows.select("period", "period_ord").distinct()
    return periods.withColumn("previous_period", F.lag("period").over(W.orderBy("period_ord")))


def latest_with_previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Newest row per code next to the same code's row of the adjacent warehouse period."""
    newest = latest(rows).join(warehouse_periods(rows).select("period", "previous_period"), "period", "left")
    before = rows.select(*KEY, F.col("period").alias("previous_period"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return newest.join(before, [*KEY, "previous_period"], "left")


def resolve_period(rows: DataFrame, wanted: str = "latest") -> DataFrame:
    """The newest period equal to or starting with ``wanted``; ``latest`` takes the newest of all."""
    periods = rows.select("period", "period_ord").distinct()
    if wanted != "latest":
        periods = periods.where(F.col("period").startswith(wanted))
    exact = F.when(F.col("period") == wanted, 0).otherwise(1)
    return periods.orderBy(exact, F.col("period_ord").desc()).limit(1)


def recent_reports(rows: DataFrame, years: int = 3) -> DataFrame:
    """Reports of the newest ``years`` calendar years per code, oldest first by report date."""
    newest = F.max("report_date").over(W.partitionBy(*KEY))
    year = lambda c: F.floor(c / 10000)
    return rows.withColumn("_newest", newest).where(year(F.col("report_date")) >= year(F.col("_newest")) - (years - 1)).drop("_newest")
