"""Intraday tables: time-of-day windows, bar resampling, cumulative VWAP and the frozen day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.operators.prefix import running_totals

CELL = ("market", "symbol", "trading_day")


def usable_points(ticks: DataFrame) -> DataFrame:
    """Drop points without a price or without volume."""
    return ticks.where(F.col("price").isNotNull() & F.col("volume").isNotNull() & (F.col("volume") != 0))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def window_sums(ticks: DataFrame, specs=spec.WINDOW_SPECS) -> DataFrame:
    """Volume, amount and bar count per symbol, day and named time-of-day window, both ends inclusive.

    Ticks are matched to at most ``len(specs)`` windows in place and summed map-side.
    """
    at = clock(F.col("ts"))
    hits = F.filter(
        F.array(*[F.when(at.between(f"{start}:00", f"{end}:00"), F.lit(name)) for name, start, end in specs]),
        lambda x: x.isNotNull())
    return ticks.select(*CELL, "volume", "amount_cents", F.explode(hits).alias("indicator_name")).groupBy(*CELL, "indicator_name").agg(
        F.sum("volume").alias("volume_sum"), (F.sum("amount_cents") / 100.0).alias("amount_sum"), F.count(F.lit(1)).alias("bar_count"))


def window_columns(ticks: DataFrame, specs=spec.WINDOW_SPECS) -> DataFrame:
    """The same sums as columns, one row per symbol and day with any tick."""
    at = clock(F.col("ts"))
    out = []
    for name, start, end in specs:
        inside = at.between(f"{start}:00", f"{end}:00")
        out += [
            F.sum(F.when(inside, F.coalesce("volume", F.lit(0))).otherwise(0)).alias(name),
            F.count_if(inside).alias(f"{name.removesuffix('_volume')}_bar_count"),
        ]
    return ticks.groupBy(*CELL).agg(*out)


def volume_history(daily: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """Days with both a daily close and intraday data; the newest ``limit`` per symbol, or all."""
    rows = daily.select(*CELL, "close").join(windows, list(CELL))
    if limit is None:
        return rows
    newest = F.row_number().over(W.partitionBy("market", "symbol").orderBy(F.col("trading_day").desc()))
    return rows.withColumn("_rn", newest).where(F.col("_rn") <= limit).drop("_rn")


def floor_minutes(ts: Column, minutes: int) -> Column:
    """Start of the ``minutes`` bucket, counted from midnight."""
    return F.window(ts, f"{minutes} minutes")["start"]


def resample(ticks: DataFrame, minutes: int) -> DataFrame:
    """OHLCV bars of ``minutes``; open and close by first and last tick. Every aggregate combines map-side."""
    order = F.struct("ts", "event_id")
    return ticks.groupBy(*CELL, floor_minutes(F.col("ts"), minutes).alias("bar_start")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
        (F.sum("amount_cents") / 100.0).alias("amount"), F.count(F.lit(1)).alias("tick_count"))


def coarsen(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars of a longer interval from shorter bars."""
    return bars.groupBy(*CELL, floor_minutes(F.col("bar_start"), minutes).alias("bar_start")).agg(
        F.min_by("open", "bar_start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "bar_start").alias("close"), F.sum("volume").alias("volume"), F.sum(F.rint(F.col("amount") * 100.0).cast("bigint")).alias("cents"),
    ).withColumn("amount", F.col("cents") / 100.0).drop("cents")


def derive_bars(five: DataFrame, one: DataFrame, minutes: int) -> DataFrame:
    """Bars from the 5-minute base; intervals it misses fall back to the 1-minute base."""
    keys = [*CELL, "bar_start"]
    a, b = coarsen(five, minutes), coarsen(one, minutes)
    fields = ("open", "high", "low", "close", "volume", "amount")
    main = a.select(*keys, F.struct(*fields).alias("main"))
    spare = b.select(*keys, F.struct(*fields).alias("spare"))
    return main.join(spare, keys, "full_outer").select(
        *keys, *[F.coalesce(F.col("main")[c], F.col("spare")[c]).alias(c) for c in fields],
        F.when(F.col("main").isNotNull(), "5m").otherwise("1m").alias("base_interval"))


def cumulative_vwap(ticks: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Each usable point with the VWAP of the day so far. Totals are scaled integers, exact in any order.

    ``base`` (``CELL``, ``base_cents``, ``base_volume``) holds what a cell had before these points.
    """
    points = usable_points(ticks)
    out = running_totals(points, list(CELL), ["ts", "event_id"], {"cum_cents": F.col("amount_cents"), "cum_volume": F.col("volume")})
    if base is not None:
        more = lambda total, before: F.col(total) + F.coalesce(F.col(before), F.lit(0))
        out = out.join(base, list(CELL), "left").withColumns({"cum_cents": more("cum_cents", "base_cents"), "cum_volume": more("cum_volume", "base_volume")}).drop(
            "base_cents", "base_volume")
    return out.where(F.col("cum_volume") > 0).withColumn("vwap", (F.col("cum_cents") / 100.0) / (F.col("cum_volume") * 100.0))


def vwap_strength(points: DataFrame, *, min_ratio_pct: float = 80.0, max_breach_pct: float = 0.3) -> DataFrame:
    """Per symbol and day: how many points hold the VWAP and whether the day passes the strength test."""
    return with_verdict(point_counts(points, max_breach_pct), min_ratio_pct)


def point_counts(points: DataFrame, max_breach_pct: float = 0.3) -> DataFrame:
    """Per symbol and day: points, points at or above the VWAP, and whether any falls too far below."""
    floor = F.col("vwap") * (1.0 - max_breach_pct / 100.0)
    above = F.col("price") >= F.col("vwap")
    return points.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("valid_points"), F.count_if(above).alias("above_count"), F.max(~above & (F.col("price") < floor)).alias("breached"))


def with_verdict(counts: DataFrame, min_ratio_pct: float = 80.0) -> DataFrame:
    return counts.withColumn("passes", ~F.col("breached") & (F.col("above_count") / F.col("valid_points") * 100.0 >= min_ratio_pct))


def quote_vwap_passes(amount: Column, volume: Column, low: Column, max_breach_pct: float = 0.3) -> Column:
    """Strength test for a quote without intraday points."""
    vwap = F.try_divide(amount, volume * spec.LOT_SIZE)
    return F.coalesce(low >= vwap * (1.0 - max_breach_pct / 100.0), F.lit(False))


def splice(final: DataFrame, provisional: DataFrame) -> DataFrame:
    """History plus today's provisional bars; a final row replaces the provisional row of the same day."""
    both = final.withColumn("data_status", F.lit("final")).unionByName(provisional.withColumn("data_status", F.lit("provisional")))
    rank = F.row_number().over(W.partitionBy(*CELL).orderBy(F.col("data_status").asc()))  # 'final' < 'provisional'
    return both.withColumn("_rn", rank).where(F.col("_rn") == 1).drop("_rn")


def freeze(ticks: DataFrame, cutoff: str = "15:00:00") -> DataFrame:
    """The day as it stood at the cutoff time."""
    return ticks.where(clock(F.col("ts")) <= cutoff)
