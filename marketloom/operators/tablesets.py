"""Joins and set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import text as T

KEYS = ["market", "symbol"]


def with_names(rows: DataFrame, securities: DataFrame, industry: DataFrame | None = None) -> DataFrame:
    """Left joins to the security master and, if given, the industry display. The sides are broadcast only while their
    measured size allows it; beyond that Spark falls back to a sort-merge join with skew splitting."""
    out = rows.join(securities.select(*KEYS, "stock_name", "name_initials"), KEYS, "left")
    if industry is None:
        return out
    display = T.industry_display(F.col("industry_level_1_name"), F.col("industry_level_2_name"))
    named = industry.select(*KEYS, display.alias("industry_display"))
    return out.join(named, KEYS, "left").withColumn("industry_display", F.coalesce("industry_display", F.lit("")))


def any_match(pool: DataFrame, memberships: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Keys with at least one membership in ``wanted``; an empty list does not filter."""
    names = [w.strip() for w in wanted if w.strip()]
    return pool.join(memberships.where(F.col(column).isin(*names)), KEYS, "left_semi") if names else pool


def replace_keys(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    return existing.join(incoming, key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present, key, "left_anti").select(key).distinct()


def trading_days(*frames: DataFrame) -> DataFrame:
    """Distinct days over several tables; duplicates go before the shuffle."""
    out = frames[0].select("trading_day")
    for f in frames[1:]:
        out = out.union(f.select("trading_day"))
    return out.distinct()
