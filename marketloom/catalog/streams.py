"""STM queries and the stream sides of SRC-13 and JON-16.

Streams read the event table as an arriving file, drain it and return what the sink holds.
"""

from pyspark.sql import functions as F

from marketloom.catalog import query
from marketloom.catalog import valuation as cv
from marketloom.catalog.momentum import DAY, day_text
from marketloom.catalog.screeners import FLAG_COLUMNS, FLAGS_SQL, recent_bars, recent_stats
from marketloom.catalog.views import add_view, sql_round, sql_symbol
from marketloom.operators import rolling as L
from marketloom.plans import intraday as D
from marketloom.session import fresh_path, settle
from marketloom.sources import tables as S
from marketloom.streaming import ticks as T

col = F.col


def quote_stream(spark, d):
    """Ticks as quotes of the security their user stands for."""
    rows = T.tick_stream(spark, d)
    return rows.select(
        S.market_of(col("user_id")).alias("market"), S.symbol_of(col("user_id")).alias("symbol"), col("ts").alias("quote_time"), "event_id", "price", "volume",
        (col("amount_cents") / 100.0).alias("amount"))


def static_side(spark, d):
    """What the conditions need beside the quote; one row per security, so it is settled once for all batches."""
    recent = recent_bars(spark, d)
    snap = L.latest_snapshot(recent).select("market", "symbol", col("latest_close").alias("last_close"), "open", "low")
    caps = cv.inputs(spark, d).select("market", "symbol", "total_market_cap", "free_float_market_cap")
    return settle(snap.join(caps, ["market", "symbol"]).join(recent_stats(recent), ["market", "symbol"]).withColumn("points_pass", F.lit(None).cast("boolean")))


def screened(spark, d):
    path = fresh_path(spark, "screen")
    T.drain(T.realtime_screener(quote_stream(spark, d), static_side(spark, d), path, interval=None))
    return T.screener_result(spark, path)


# Every quoted symbol keeps its row; what it lacks leaves conditions unmet.
add_view("stream_rows", f"""SELECT q.market, q.symbol, q.price, q.volume, q.amount, s.last_close, s.open, s.low, s.avg_volume_last_5, s.recent_limit_up, s.total_market_cap, s.free_float_market_cap, NULL::BOOLEAN AS points_pass,
  {sql_round('(q.price / nullif(s.last_close, 0) - 1.0) * 100.0', 4)} AS gain_pct, CASE WHEN s.avg_volume_last_5 > 0 THEN q.volume / s.avg_volume_last_5 END AS volume_ratio, coalesce(nullif(s.free_float_market_cap, 0), s.total_market_cap) AS float_cap
  FROM (SELECT CASE user_id % 3 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE 'bj' END AS market, {sql_symbol('user_id')} AS symbol, arg_max(price, (ts, event_id)) AS price, arg_max(volume, (ts, event_id)) AS volume, arg_max(amount_cents, (ts, event_id))::DOUBLE / 100.0::DOUBLE AS amount FROM ticks GROUP BY 1, 2) q
  LEFT JOIN (SELECT f.market, f.symbol, f.close AS last_close, f.open, f.low, f.avg_volume_last_5, l.recent_limit_up, v.total_market_cap, v.free_float_market_cap FROM (SELECT * FROM volume_frames WHERE rn = 1) f JOIN limit_up l USING (market, symbol) JOIN val_inputs v USING (market, symbol)) s USING (market, symbol)""")


@query("stm_01_realtime_screener", FLAGS_SQL.format("stream_rows"))
def stm_01(spark, d):
    return screened(spark, d).select(*FLAG_COLUMNS)


@query("jon_16_stream_static_join", "SELECT market, symbol, price, last_close, total_market_cap, avg_volume_last_5 FROM stream_rows")
def jon_16(spark, d):
    return screened(spark, d).select("market", "symbol", "price", "last_close", "total_market_cap", "avg_volume_last_5")


@query("src_13_quote_scan", "SELECT CASE user_id % 3 WHEN 0 THEN 'sz' ELSE 'sh' END AS market, count(*) AS quotes FROM events WHERE user_id % 3 <> 2 GROUP BY 1")
def src_13(spark, d):
    """Quotes of the two covered exchanges, counted from what the stream delivered."""
    path = fresh_path(spark, "quotes")
    rows = quote_stream(spark, d).where(col("market").isin("sh", "sz"))
    T.drain(T.start(rows, path, lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/quotes/batch={i}")))
    return spark.read.parquet(f"{path}/quotes").groupBy("market").agg(F.count(F.lit(1)).alias("quotes"))


@query("stm_02_vwap_state", f"SELECT symbol, {DAY}, valid_points, above_count, breached, NOT breached AND above_count / valid_points::DOUBLE * 100.0 >= 80 AS passes FROM vwap_strength")
def stm_02(spark, d):
    path = fresh_path(spark, "vwap")
    T.drain(T.vwap_state(T.tick_stream(spark, d), path))
    return day_text(T.vwap_result(spark, path)).select("symbol", "trading_day", "valid_points", "above_count", "breached", "passes")


def sql_bars(minutes, source="ticks"):
    return f"""SELECT market, symbol, trading_day, time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '2000-01-01') AS bar_start, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, event_id)) AS close, sum(volume)::BIGINT AS volume, sum(amount_cents)::DOUBLE / 100.0::DOUBLE AS amount FROM {source} GROUP BY 1, 2, 3, 4"""


BAR_SQL = f"SELECT symbol, {DAY}, strftime(bar_start, '%Y-%m-%d %H:%M:%S') AS bar_start, open, high, low, close, volume, amount"
BAR_COLUMNS = ("symbol", "trading_day", "bar_start", "open", "high", "low", "close", "volume", "amount")


def bar_text(df):
    return day_text(df).withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss"))


@query("stm_03_bars_15m", f"{BAR_SQL} FROM ({sql_bars(15)})")
def stm_03(spark, d):
    return bar_text(D.coarsen(D.resample(S.ticks(spark, d), 1), 15)).select(*BAR_COLUMNS)


add_view("main_bars", sql_bars(30, "(SELECT * FROM ticks WHERE hour(ts) <> 10)"))
add_view("spare_bars", sql_bars(30))


@query("stm_04_bars_with_fallback", f"{BAR_SQL}, '5m' AS base_interval FROM main_bars UNION ALL {BAR_SQL}, '1m' FROM spare_bars WHERE hour(bar_start) = 10")
def stm_04(spark, d):
    """The 5-minute base lacks one hour of every day; those intervals come from the 1-minute base."""
    ticks = S.ticks(spark, d)
    five = D.resample(ticks.where(F.hour("ts") != 10), 5)
    return bar_text(D.derive_bars(five, D.resample(ticks, 1), 30)).select(*BAR_COLUMNS, "base_interval")


@query("stm_05_window_volume", f"SELECT market, symbol, {DAY}, indicator_name, volume_sum, amount_sum, bar_count FROM window_sums")
def stm_05(spark, d):
    path = fresh_path(spark, "windows")
    T.drain(T.window_volume(T.tick_stream(spark, d), path))
    return day_text(T.window_result(spark, path))


DAYS = "SELECT market, symbol, trading_day, sum(volume)::BIGINT AS volume, sum(amount_cents)::BIGINT AS amount_cents FROM ticks GROUP BY 1, 2, 3"


def tick_days(ticks):
    return ticks.groupBy("market", "symbol", "trading_day").agg(F.sum("volume").alias("volume"), F.sum("amount_cents").alias("amount_cents"))


@query("stm_06_splice", f"SELECT symbol, {DAY}, volume, amount_cents, CASE WHEN trading_day < DATE '2024-01-20' THEN 'final' ELSE 'provisional' END AS data_status FROM ({DAYS})")
def stm_06(spark, d):
    """History is final up to a day; provisional rows overlap it by five days."""
    days = tick_days(S.ticks(spark, d))
    cut = lambda s: F.lit(s).cast("date")
    out = D.splice(days.where(col("trading_day") < cut("2024-01-20")), days.where(col("trading_day") >= cut("2024-01-15")))
    return day_text(out).select("symbol", "trading_day", "volume", "amount_cents", "data_status")


@query("stm_07_freeze", f"SELECT symbol, {DAY}, count(*) AS n, sum(volume)::BIGINT AS volume FROM ticks WHERE strftime(ts, '%H:%M:%S') <= '15:00:00' GROUP BY 1, 2")
def stm_07(spark, d):
    frozen = D.freeze(S.ticks(spark, d))
    return day_text(frozen.groupBy("symbol", "trading_day").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")))


@query("stm_08_late_replacement", f"SELECT symbol, {DAY}, volume, amount_cents, CASE WHEN trading_day < DATE '2024-01-25' THEN 'final' ELSE 'provisional' END AS data_status FROM ({DAYS})")
def stm_08(spark, d):
    """Days streamed provisionally; the days already closed are replaced by the batch recompute."""
    path = fresh_path(spark, "late")
    T.drain(T.provisional_days(T.tick_stream(spark, d), path))
    closed = tick_days(S.ticks(spark, d)).where(col("trading_day") < F.lit("2024-01-25").cast("date"))
    return day_text(T.replace_with_final(spark, path, closed)).select("symbol", "trading_day", "volume", "amount_cents", "data_status")


@query("stm_09_freshness_tiers", " UNION ALL ".join(f"SELECT '{t}' AS tier, count(*) AS rows_seen, count(DISTINCT event_type) AS symbols FROM events" for t in T.TIERS))
def stm_09(spark, d):
    """Each tier runs as its own query over the stream and reports what it has seen."""
    path = fresh_path(spark, "tiers")

    def report(tier):
        return lambda batch, i: batch.select(F.lit(tier).alias("tier"), "symbol").write.mode("overwrite").parquet(f"{path}/seen/tier_name={tier}/batch={i}")

    for q in T.start_tiers(T.tick_stream(spark, d), path, {t: report(t) for t in T.TIERS}, drain_only=True):
        T.drain(q)
    return spark.read.parquet(f"{path}/seen").groupBy("tier").agg(F.count(F.lit(1)).alias("rows_seen"), F.countDistinct("symbol").alias("symbols"))
