"""Industry views: heatmap, industry momentum and the equal-weight index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.operators import rolling as L
from marketloom.session import settle

INDUSTRY = ("industry_level_2_code", "industry_level_2_name")


def industry_rps(industry: DataFrame, rps: DataFrame) -> DataFrame:
    """Mean RPS per industry and window over the members that have one; members are counted regardless."""
    joined = industry.join(rps, ["market", "symbol"], "left")
    mean = [
        (N.unscaled(F.sum(N.scaled(F.col(f"rps_{n}"), 2)), 2) / F.nullif(F.count(f"rps_{n}"), F.lit(0))).alias(f"rps_{n}")
        for n in spec.RPS_WINDOWS
    ]
    return joined.groupBy("industry_level_1_name", "industry_level_2_name").agg(F.count(F.lit(1)).alias("member_count"), *mean)


def industry_sizes(industry: DataFrame, limit: int | None = None) -> DataFrame:
    """Industries by distinct member count; an explicit limit keeps at least one."""
    known = industry.where(
        (F.col("industry_level_2_code") != "") & (F.col("industry_level_2_name") != "")
        & (F.col("market") != "") & (F.col("symbol") != ""))
    members = known.dropDuplicates(["industry_level_2_code", "market", "symbol"])
    sized = members.groupBy("industry_level_2_code").agg(
        F.min("industry_level_2_name").alias("industry_level_2_name"), F.count(F.lit(1)).alias("member_count"))
    ordered = sized.orderBy(F.col("member_count").desc(), "industry_level_2_code", "industry_level_2_name")
    return ordered if limit is None else ordered.limit(max(1, limit))


def member_keys(industry: DataFrame, selected: DataFrame) -> DataFrame:
    return (
        industry.where((F.col("market") != "") & (F.col("symbol") != ""))
        .join(selected, "industry_level_2_code", "left_semi")
        .select("industry_level_2_code", "market", "symbol").distinct()
    )


def daily_returns(bars: DataFrame) -> DataFrame:
    value = N.rounded(N.return_pct(F.col("close"), L.lagged("close", 1)), 4)
    return bars.select("market", "symbol", "trading_day", value.alias("pct_change"), "volume")


def heat_cells(industry: DataFrame, bars: DataFrame) -> DataFrame:
    """Mean member return, member count and volume per industry and day on which a member traded."""
    rows = daily_returns(bars).join(industry.select("market", "symbol", *INDUSTRY).distinct(), ["market", "symbol"])
    n = F.count("pct_change")
    mean = N.rounded(N.unscaled(F.sum(N.scaled(F.col("pct_change"), 4)), 4) / F.nullif(n, F.lit(0)), 4)
    return rows.groupBy(*INDUSTRY, "trading_day").agg(
        mean.alias("pct_change"), n.alias("stock_count"), F.sum("volume").cast("double").alias("daily_volume"))


def heatmap(industry: DataFrame, bars: DataFrame, *, anchor: Column, limit: int | None = None) -> DataFrame:
    """Year-to-date grid of industries and days; a day no member traded on keeps an empty cell.

    The grid comes from exploding the list of days (at most one year) onto each industry row, so no cross join runs.
    """
    selected = industry_sizes(industry, limit)
    # The first return of the year needs the close before it; only the year's rows are kept, once, for both days and cells.
    returns = settle(daily_returns(bars.where(F.col("trading_day") <= anchor)).where(F.col("trading_day") >= F.trunc(anchor, "YEAR")))
    days = returns.select("trading_day").distinct().agg(F.array_sort(F.collect_set("trading_day"))).scalar()  # <= 366 days
    grid = selected.select(*INDUSTRY, "member_count", F.explode(days).alias("trading_day"))
    keyed = returns.join(member_keys(industry, selected), ["market", "symbol"])
    n = F.count("pct_change")
    cells = keyed.groupBy("industry_level_2_code", "trading_day").agg(
        N.rounded(N.unscaled(F.sum(N.scaled(F.col("pct_change"), 4)), 4) / F.nullif(n, F.lit(0)), 4).alias("pct_change"),
        n.alias("stock_count"), F.sum("volume").cast("double").alias("daily_volume"))
    return grid.join(cells, ["industry_level_2_code", "trading_day"], "left").withColumn(
        "stock_count", F.coalesce("stock_count", F.lit(0).cast("bigint")))


def _index_order() -> W:
    return W.partitionBy(*INDUSTRY).orderBy("trading_day")


def index_levels(cells: DataFrame, start: float = 100.0) -> DataFrame:
    """Compounded index level without per-step rounding, and its logarithm, which cannot overflow."""
    growth = F.log1p(F.coalesce(F.col("pct_change"), F.lit(0.0)) / 100.0)
    total = F.sum(growth).over(_index_order().rowsBetween(W.unboundedPreceding, 0))
    return cells.select("*", total.alias("log_growth")).withColumn("level", F.exp("log_growth") * start)


def synthetic_index(cells: DataFrame, start: float = 100.0) -> DataFrame:
    """Index bars with the close rounded to four decimals at every step, each step feeding the next.

    The fold runs year by year: a year's closes (at most 366) continue from the last close of the year before, so its cost is linear in
    days. Arrays hold one small struct per calendar day, a bound that does not depend on how many trades an industry has.
    """
    day = F.struct(
        "trading_day", F.coalesce("pct_change", F.lit(0.0)).alias("pct"),
        F.coalesce("stock_count", F.lit(0)).alias("n"), F.col("daily_volume").alias("volume"))
    years = cells.groupBy(*INDUSTRY, F.year("trading_day").alias("y")).agg(F.array_sort(F.collect_list(day)).alias("days"))
    series = years.groupBy(*INDUSTRY).agg(F.array_sort(F.collect_list(F.struct("y", "days"))).alias("years"))

    def step(closes: Column, x: Column) -> Column:
        return F.concat(closes, F.array(N.rounded(F.element_at(closes, -1) * (1.0 + x["pct"] / 100.0), 4)))

    def year(done: Column, y: Column) -> Column:
        before = F.element_at(F.element_at(done, -1), -1)
        return F.concat(done, F.array(F.aggregate(y["days"], F.array(before), step)))

    # one array per year: the close before its first day, then the close of each day
    closes = F.slice(F.aggregate("years", F.array(F.array(F.lit(start))), year), 2, F.size("years"))
    each = series.select(*INDUSTRY, F.inline(F.arrays_zip(F.col("years.days").alias("days"), closes.alias("closes"))))
    rows = each.select(*INDUSTRY, F.inline(F.arrays_zip("days", F.slice("closes", 1, F.size("days")).alias("before"))))
    rows = rows.select(*INDUSTRY, "days.*", F.col("before").alias("open"))
    rows = rows.withColumn("close", F.col("open") * (1.0 + F.col("pct") / 100.0))
    high, low = F.greatest("open", "close"), F.least("open", "close")
    pad = F.greatest(high * 0.002, F.abs(F.col("close") - F.col("open")) * 0.25)
    fallback = F.round(F.abs("pct") * F.greatest(F.col("n"), F.lit(1)) * 1000)
    return rows.select(
        *INDUSTRY, "trading_day", N.rounded(F.col("open"), 4).alias("open"), N.rounded(high + pad, 4).alias("high"),
        N.rounded(F.greatest(F.lit(0.0001), low - pad), 4).alias("low"), N.rounded(F.col("close"), 4).alias("close"),
        F.coalesce(F.nullif(F.col("volume"), F.lit(0.0)), fallback).alias("volume"))


def industry_index_rps(index_bars: DataFrame, windows=spec.RPS_WINDOWS, frame: int = spec.RPS_SELF_WINDOW) -> DataFrame:
    """Self-percentile history of the index; short histories use the frame they have."""
    order = _index_order()
    rows = index_bars.withColumn("_i", F.row_number().over(order))
    for n in windows:
        oldest = F.first("close").over(order.rowsBetween(-n, 0))
        rows = rows.withColumn(f"raw_{n}", F.when(F.col("_i") > 1, N.rolling_return_pct(F.col("close"), oldest)))
    for n in windows:
        current = F.col(f"raw_{n}")
        values = F.collect_list(current).over(order.rowsBetween(-(frame - 1), 0))
        pct = N.rounded(F.size(F.filter(values, lambda v: v < current)) / F.size(values) * 100.0, 2)
        rows = rows.withColumn(f"rps_{n}", F.when(current.isNotNull(), pct))
    return rows.select(*INDUSTRY, "trading_day", *[f"rps_{n}" for n in windows])
