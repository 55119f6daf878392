"""Frames over one symbol's sessions. Bars are unique per (symbol, day), so a frame partition never exceeds the
number of calendar days, whatever share of the raw ticks a symbol holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom import spec
from marketloom.functions import numeric as N

SYMBOL = ("market", "symbol")


def by_day() -> W:
    return W.partitionBy(*SYMBOL).orderBy("trading_day")


def newest_first() -> W:
    return W.partitionBy(*SYMBOL).orderBy(F.col("trading_day").desc())


def lagged(column: str, n: int) -> Column:
    return F.lag(column, n).over(by_day())


def session_return(n: int, at: int = 0, digits: int | None = 4) -> Column:
    """N-session return in percent as of ``at`` sessions ago."""
    now = F.col("close") if at == 0 else lagged("close", at)
    value = N.return_pct(now, lagged("close", n + at))
    return value if digits is None else N.rounded(value, digits)


def with_moving_averages(df: DataFrame, specs: list[tuple[str, int, int, str]], digits: int = 6) -> DataFrame:
    """Adds means of ``n`` rows ending ``at`` sessions ago for (column, n, at, out); NULL while warming up or when a
    value is missing.

    Each mean is a difference of two running totals, so the cost per row does not grow with n; the totals are scaled
    integers, so the difference is exact.
    """
    running = by_day().rowsBetween(W.unboundedPreceding, 0)
    columns = sorted({c for c, _n, _at, _out in specs})
    work = df.select(
        "*",
        *[F.sum(N.scaled(F.col(c), digits)).over(running).alias(f"_sum_{c}") for c in columns],
        *[F.count(c).over(running).alias(f"_cnt_{c}") for c in columns],
        F.row_number().over(by_day()).alias("_row"),
    )

    def ago(name: str, n: int) -> Column:
        return F.col(name) if n == 0 else F.coalesce(F.lag(name, n).over(by_day()), F.lit(0))

    means = []
    for c, n, at, out in specs:
        total = ago(f"_sum_{c}", at) - ago(f"_sum_{c}", at + n)
        present = ago(f"_cnt_{c}", at) - ago(f"_cnt_{c}", at + n)
        ready = (F.col("_row") >= n + at) & (present == n)
        means.append(F.when(ready, N.unscaled(total, digits) / n).alias(out))
    return work.select(*df.columns, *means)


def highest(column: str, n: int) -> Column:
    return F.max(column).over(by_day().rowsBetween(-(n - 1), 0))


def _counter():
    """``below_counts`` as a local function, which travels to the workers as it is: they need not have this package."""

    def below_counts(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For every value, how many of the last n (itself included) lie strictly below it, and how many are there. NaN is missing."""
        padded = np.concatenate([np.full(n - 1, np.nan), values])
        here = np.concatenate([[0], np.cumsum(~np.isnan(padded))])
        below = np.empty(len(values), dtype=np.int64)
        for start in range(0, len(values), 4096):  # a block of frames at a time
            frames = np.lib.stride_tricks.sliding_window_view(padded[start:start + 4096 + n - 1], n)
            below[start:start + 4096] = (frames < values[start:start + 4096, None]).sum(axis=1)
        return below, here[n:] - here[:-n]

    return below_counts


below_counts = _counter()


def with_self_percentiles(df: DataFrame, names: dict[str, str], n: int, partial: dict[str, str] | None = None, digits: int = 2) -> DataFrame:
    """Share of the last n values strictly below the current one, in percent, for {value column: output column}.

    ``names`` need a full frame of n rows; ``partial`` outputs use whatever history there is. Values are numbers, and NaN counts as missing.
    Spark brings each symbol's sessions together (never more than calendar days); the frames are compared in numpy, which returns only counts.
    """
    columns = sorted({*names, *(partial or {})})
    given, counter = df.columns, _counter()
    counts = [f"{kind}_{c}" for c in columns for kind in ("_below", "_here")] + ["_row"]

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("trading_day")
        out = [rows[c] for c in given]
        for c in columns:
            out += map(pa.array, counter(rows[c].to_numpy().astype(np.float64), n))
        return pa.Table.from_arrays([*out, pa.array(np.arange(1, rows.num_rows + 1))], names=[*given, *counts])

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])
    work = df.groupBy(*SYMBOL).applyInArrow(count, schema)

    def pct(c: str) -> Column:
        return N.rounded(F.col(f"_below_{c}") / F.col(f"_here_{c}") * 100.0, digits)

    present = {c: F.col(c).isNotNull() & ~F.isnan(c) for c in columns}
    full = [F.when(present[c] & (F.col("_row") >= n), pct(c)).alias(out) for c, out in names.items()]
    short = [F.when(present[c], pct(c)).alias(out) for c, out in (partial or {}).items()]
    return work.select(*df.columns, *full, *short)


def with_recent_limit_up(df: DataFrame, n: int, limit_pct: float = spec.LIMIT_UP_PCT) -> DataFrame:
    """Did any of the last n sessions close at least ``limit_pct`` above the one before?"""
    rows = df.withColumn("_ret", N.return_pct(F.col("close"), lagged("close", 1)))
    hit = F.max("_ret").over(by_day().rowsBetween(-(n - 1), 0)) >= limit_pct
    return rows.withColumn("recent_limit_up", F.coalesce(hit, F.lit(False))).drop("_ret")


def latest_snapshot(bars: DataFrame) -> DataFrame:
    """Last session per symbol: close, the close before, volume, the mean of up to five earlier non-zero volumes and
    the mean volume of the last five sessions."""
    recent = tail(bars.select(*SYMBOL, "trading_day", "open", "high", "low", "close", "volume", "amount"), 6)
    earlier = by_day().rowsBetween(-5, -1)
    nonzero = F.when(F.col("volume") != 0, F.col("volume"))
    last5 = by_day().rowsBetween(-4, 0)
    rows = recent.select(
        *SYMBOL, "trading_day", "open", "high", "low", F.col("close").alias("latest_close"), lagged("close", 1).alias("previous_close"),
        F.col("volume").alias("latest_volume"), F.col("amount").alias("latest_amount"),
        (F.sum(nonzero).over(earlier) / F.nullif(F.count(nonzero).over(earlier), F.lit(0))).alias("avg_volume_5"),
        (F.sum("volume").over(last5) / F.count("volume").over(last5)).alias("avg_volume_last_5"),
    )
    return latest(rows)


def with_listed_days(bars: DataFrame) -> DataFrame:
    return bars.select(
        "*", F.row_number().over(by_day()).cast("bigint").alias("listed_days"),
        F.count(F.lit(1)).over(W.partitionBy(*SYMBOL)).alias("total_days"))


def tail(df: DataFrame, n: int) -> DataFrame:
    """Newest n sessions per symbol."""
    return df.withColumn("_rn", F.row_number().over(newest_first())).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame) -> DataFrame:
    return tail(df, 1)


def with_returns(bars: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    return bars.select("*", *[session_return(n).alias(f"return_{n}_pct") for n in windows])
