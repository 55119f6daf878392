"""Data quality rules: status grades, backfill by source priority, timeframe alignment and execution grades.

The rules name grades and their order but few numbers; the numbers below are this package's parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.operators import rolling as L

DAY_KEY = ["market", "symbol", "trading_day"]


def with_status(bars: DataFrame, max_suspension: int = 20) -> DataFrame:
    """Trading status from gaps in the symbol's own sessions against the market calendar, with the symbol's last session before.

    A session number on the calendar turns gaps into differences of neighbours, so no symbol x day grid is built. A symbol that does
    not trade on the calendar's newest day has one more row there, without bar: suspended since its last session.
    """
    calendar = bars.select("trading_day").distinct()
    numbered = calendar.withColumn("_session", F.row_number().over(W.orderBy("trading_day")))  # one row per day
    newest = numbered.agg(F.max_by("trading_day", "_session").alias("trading_day"), F.max("_session").alias("_session"))
    rows = bars.join(numbered, "trading_day")
    last = rows.groupBy("market", "symbol").agg(F.max("_session").alias("_last"))
    absent = last.where(F.col("_last") < newest.select("_session").scalar()).select(
        "market", "symbol", newest.select("trading_day").scalar().alias("trading_day"), newest.select("_session").scalar().alias("_session"), F.lit(True).alias("_absent"))
    rows = rows.withColumn("_absent", F.lit(False)).unionByName(absent, allowMissingColumns=True)
    gap = F.coalesce(F.col("_session") - F.lag("_session").over(L.by_day()) - 1, F.lit(0)) + F.col("_absent").cast("int")
    rows = rows.withColumns({"suspension_days": gap.cast("bigint"), "last_trading_date": F.lag("trading_day").over(L.by_day())})
    status = F.when(F.col("_absent"), "suspended").when(F.col("suspension_days") > 0, "resumed").otherwise("trading")
    return rows.withColumn("trading_status", status).withColumn(
        "eligible_for_intraday", ~F.col("_absent") & (F.col("suspension_days") <= max_suspension)).drop("_session", "_absent")


def data_quality(prices: list[str], volumes: list[str], auxiliaries: list[str]) -> Column:
    """invalid without key prices, low without trade fields, medium without auxiliary fields, else high."""
    lacks = lambda names: reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    return F.when(lacks(prices), "invalid").when(lacks(volumes), "low").when(lacks(auxiliaries), "medium").otherwise("high")


def comparability(price_mode: Column, wanted: Column) -> Column:
    return F.when(price_mode == wanted, "comparable").when(price_mode == "raw", "converted").otherwise("not_comparable")


def signal_permission(quality: Column, status: Column, comparable: Column) -> Column:
    """executable > observable > restricted > invalid, by the worst finding."""
    return (
        F.when((quality == "invalid") | ((quality == "low") & (comparable == "not_comparable")), "invalid")
        .when(comparable == "not_comparable", "restricted")
        .when((quality == "low") | (status != "trading"), "observable")
        .otherwise("executable")
    )


def backfill(sources: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """First source in order that has a row wins the row; holes inside it are filled from later sources.

    ``fill_status`` is original (first source, no hole filled), partial (holes filled) or backfilled.
    """
    rows: DataFrame | None = None
    for name, df in sources:
        side = df.select(*DAY_KEY, F.struct(*columns).alias("s_" + name))
        rows = side if rows is None else rows.join(side, DAY_KEY, "full_outer")
    names = [n for n, _ in sources]
    has = lambda n: F.col("s_" + n).isNotNull()
    origin = F.coalesce(*[F.when(has(n), F.lit(n)) for n in names])
    own = lambda c: F.coalesce(*[F.when(origin == n, F.col("s_" + n)[c]) for n in names])
    filled = reduce(lambda a, b: a | b, [own(c).isNull() & F.coalesce(*[F.col("s_" + n)[c] for n in names]).isNotNull() for c in columns])
    status = F.when(filled, "partial").when(origin == names[0], "original").otherwise("backfilled")
    return rows.select(
        *DAY_KEY, *[F.coalesce(own(c), *[F.col("s_" + n)[c] for n in names]).alias(c) for c in columns], origin.alias("fill_source"), status.alias("fill_status"))


@dataclass(frozen=True)
class AlignmentRule:
    weekly_sessions: int = 5
    weekly_neutral_pct: float = 1.0
    volume_factor: float = 1.2


def alignment(bars: DataFrame, rule: AlignmentRule = AlignmentRule()) -> DataFrame:
    """Weekly bias, daily structure and intraday trigger per session, their agreement and the execution note."""
    c = F.col
    rows = L.with_moving_averages(bars.select(*DAY_KEY, "open", "close", "volume"), [("close", 20, 0, "ma_20"), ("close", 50, 0, "ma_50"), ("volume", 5, 0, "volume_ma_5")])
    weekly = N.return_pct(c("close"), L.lagged("close", rule.weekly_sessions))
    rows = rows.withColumn("_weekly", weekly)
    bias = F.when(c("_weekly") > rule.weekly_neutral_pct, "bullish").when(c("_weekly") < -rule.weekly_neutral_pct, "bearish").otherwise("neutral")
    structure = (
        F.when((c("close") > c("ma_20")) & (c("ma_20") > c("ma_50")), "setup_ready")
        .when(c("close") > c("ma_20"), "setup_pending").otherwise("setup_invalid"))
    up = c("close") > c("open")
    trigger = F.when(up & (c("volume") > rule.volume_factor * c("volume_ma_5")), "triggered").when(up, "waiting").otherwise("failed")
    rows = rows.select(*DAY_KEY, bias.alias("weekly_bias"), structure.alias("daily_structure"), trigger.alias("intraday_trigger"))
    good = (c("weekly_bias") == "bullish") & (c("daily_structure") == "setup_ready") & (c("intraday_trigger") == "triggered")
    clash = ((c("weekly_bias") == "bearish") & (c("intraday_trigger") == "triggered")) | ((c("daily_structure") == "setup_invalid") & (c("weekly_bias") == "bullish"))
    note = (
        F.when(good, "priority_execution").when(c("weekly_bias") == "bearish", "counter_trend")
        .when(c("daily_structure") != "setup_ready", "watching").when(c("intraday_trigger") != "triggered", "awaiting_trigger").otherwise("trial"))
    return rows.withColumn("timeframe_alignment", F.when(good, "aligned").when(clash, "conflicted").otherwise("mixed")).withColumn("execution_note", note)


def one_step_down(action: Column) -> Column:
    ladder = spec.ACTION_LADDER
    out = F.when(action == ladder[0], ladder[1])
    for a, b in zip(ladder[1:-1], ladder[2:]):
        out = out.when(action == a, b)
    return out.otherwise(ladder[-1])


def execution_grade(rows: DataFrame, passed: Column, total: int, veto: Column) -> DataFrame:
    """S when all conditions hold, A with one missing, B with at least half, else C; a risk veto lowers the action one
    step. The position cap follows the final action."""
    grade = F.when(passed == total, "S").when(passed == total - 1, "A").when(passed * 2 >= total, "B").otherwise("C")
    out = rows.withColumn("signal_grade", grade)
    pick = lambda key, table: reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), list(table.items())[1:], F.when(key == list(table)[0], list(table.values())[0]))
    base = pick(F.col("signal_grade"), spec.GRADE_ACTION)
    out = out.withColumn("action_grade", F.when(veto, one_step_down(base)).otherwise(base))
    return out.withColumn("position_cap_pct", pick(F.col("action_grade"), spec.ACTION_CAP_PCT))
