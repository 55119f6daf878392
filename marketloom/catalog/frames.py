"""WIN queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.momentum import DAY, REFS, RETURNS, SYMBOL_FRAME, UNIVERSE, WINDOWS, _ref_ret, _ref_rps, day_text, rps, sql_ma
from marketloom.catalog.views import add_view, sql_round
from marketloom.functions import numeric as N
from marketloom.operators import ranking as R
from marketloom.operators import rolling as L
from marketloom.plans import industry as I
from marketloom.plans import intraday as D
from marketloom.plans import momentum as M
from marketloom.plans import statements as X
from marketloom.sources import tables as S

col = F.col


@query("win_01_cross_section_rank", f"SELECT {DAY}, market, symbol, " + ", ".join(f"rank_{n}" for n in WINDOWS) + ", universe_size FROM daily_rps")
def win_01(spark, d):
    rows = M.daily_rps(S.bars(spark, d), bound=S.universe_bound(spark, d), rows=S.line_bound(spark, d))
    return day_text(rows).select("trading_day", "market", "symbol", *[f"rank_{n}" for n in WINDOWS], "universe_size")


NULLS_OUT = ("count(return_250_pct) OVER (PARTITION BY trading_day)::DOUBLE", "row_number() OVER (PARTITION BY trading_day ORDER BY return_250_pct DESC NULLS LAST, market, symbol)")


@query("win_02_rps_value", f"""SELECT {DAY}, market, symbol, rps_250 AS rps_with_nulls,
CASE WHEN return_250_pct IS NOT NULL THEN {sql_round(f'({NULLS_OUT[0]} - {NULLS_OUT[1]} + 1) / {NULLS_OUT[0]} * 100.0', 2)} END AS rps_without_nulls FROM daily_rps""")
def win_02(spark, d):
    bound = S.universe_bound(spark, d)
    base = M.daily_rps(S.bars(spark, d), bound=bound, rows=S.line_bound(spark, d)).select("trading_day", "market", "symbol", "return_250_pct", col("rps_250").alias("rps_with_nulls"))
    out = R.momentum_ranks(base, (250,), max_group_rows=bound, rank_nulls=False)
    return day_text(out).select("trading_day", "market", "symbol", "rps_with_nulls", col("rps_250").alias("rps_without_nulls"))


add_view("win_sample", "SELECT period, revenue FROM statements WHERE net_profit > 0")


@query("win_06_empirical_percentile", """SELECT market, symbol, period, CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN 100.0::DOUBLE
WHEN eq > 0 THEN (2 * lt + 1 + eq) / 2.0::DOUBLE / n * 100.0 ELSE least(lt + 1, n) / n::DOUBLE * 100.0 END AS percentile
FROM (SELECT p.market, p.symbol, p.period, count(s.revenue) FILTER (s.revenue < p.revenue) AS lt, count(s.revenue) FILTER (s.revenue = p.revenue) AS eq, count(s.revenue) AS n
FROM statements p LEFT JOIN win_sample s ON s.period = p.period GROUP BY 1, 2, 3)""")
def win_06(spark, d):
    rows = S.statements(spark, d).select("market", "symbol", "period", "revenue", "net_profit")
    sample = rows.where(col("net_profit") > 0).select("period", "revenue")
    out = R.sample_percentiles(rows, sample, ["period"], "revenue", "revenue", "percentile", max_group_rows=S.universe_bound(spark, d))
    return out.select("market", "symbol", "period", "percentile")


MAS = [("close", n, 0, f"ma_{n}") for n in spec.MA_WINDOWS] + [("volume", 50, 0, "volume_ma_50"), ("close", 50, 5, "ma_50_ago5")]


@query("win_07_moving_average", f"SELECT market, symbol, {DAY}, {', '.join(sql_ma(*m) for m in MAS)} FROM bars")
def win_07(spark, d):
    rows = L.with_moving_averages(S.bars(spark, d).select("market", "symbol", "trading_day", "close", "volume"), MAS)
    return day_text(rows.drop("close", "volume"))


@query("win_08_trailing_high", f"SELECT market, symbol, {DAY}, " + ", ".join(
    f"max(high) OVER (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hhv_{n}" for n in (40, 60)) + " FROM bars")
def win_08(spark, d):
    return day_text(S.bars(spark, d).select("market", "symbol", "trading_day", *[L.highest("high", n).alias(f"hhv_{n}") for n in (40, 60)]))


@query("win_09_daily_return", f"SELECT market, symbol, {DAY}, {sql_round('(close / nullif(lag(close) OVER s, 0) - 1.0) * 100.0', 4)} AS pct_change FROM bars {SYMBOL_FRAME}")
def win_09(spark, d):
    return day_text(I.daily_returns(S.bars(spark, d)).drop("volume"))


@query("win_10_rolling_return", f"""SELECT market, symbol, {DAY}, (close - lag(close, 20) OVER s) / nullif(lag(close, 20) OVER s, 0) * 100.0 AS full_20,
CASE WHEN row_number() OVER s > 1 THEN (close - first_value(close) OVER p) / nullif(first_value(close) OVER p, 0) * 100.0 END AS partial_20
FROM bars {SYMBOL_FRAME}, p AS (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def win_10(spark, d):
    oldest = F.first("close").over(L.by_day().rowsBetween(-20, 0))
    partial = F.when(F.row_number().over(L.by_day()) > 1, N.rolling_return_pct(col("close"), oldest))
    return day_text(S.bars(spark, d).select(
        "market", "symbol", "trading_day", N.rolling_return_pct(col("close"), L.lagged("close", 20)).alias("full_20"), partial.alias("partial_20")))


def _below(frame):
    return sql_round(f"len(list_filter(list(raw_20) OVER {frame}, lambda x: x < raw_20)) / len(list_filter(list(raw_20) OVER {frame}, lambda x: x IS NOT NULL))::DOUBLE * 100.0", 2)


@query("win_11_self_percentile", f"""SELECT market, symbol, {DAY}, CASE WHEN i >= 120 AND raw_20 IS NOT NULL THEN {_below('f')} END AS full_frame,
CASE WHEN raw_20 IS NOT NULL THEN {_below('f')} END AS partial_frame
FROM self_returns WINDOW f AS (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""")
def win_11(spark, d):
    rows = S.bars(spark, d).select("market", "symbol", "trading_day", "close")
    rows = rows.withColumn("raw", N.rolling_return_pct(col("close"), L.lagged("close", 20)))
    return day_text(L.with_self_percentiles(rows, {"raw": "full_frame"}, 120, partial={"raw": "partial_frame"}).drop("close", "raw"))


add_view("heat_cells", f"""SELECT industry_level_2_code, industry_level_2_name, trading_day,
  {sql_round('sum(CAST(pct_change * 10000.0::DOUBLE AS BIGINT))::DOUBLE / 10000.0::DOUBLE / nullif(count(pct_change), 0)', 4)} AS pct_change,
  count(pct_change) AS stock_count, sum(volume)::DOUBLE AS daily_volume
  FROM (SELECT *, {sql_round('(close / nullif(lag(close) OVER s, 0) - 1.0) * 100.0', 4)} AS pct_change FROM bars {SYMBOL_FRAME}) JOIN industry USING (market, symbol) GROUP BY 1, 2, 3""")


@query("win_12_index_level", f"""SELECT industry_level_2_code, {DAY}, {sql_round('sum(ln(1 + coalesce(pct_change, 0) / 100.0::DOUBLE)) OVER (PARTITION BY industry_level_2_code ORDER BY trading_day)', 6)} AS log_growth FROM heat_cells""")
def win_12(spark, d):
    """Compounded levels outgrow fixed point over years of data, so the check compares their logarithm."""
    cells = I.heat_cells(S.industry(spark, d), S.bars(spark, d))
    return day_text(I.index_levels(cells)).select("industry_level_2_code", "trading_day", N.rounded(col("log_growth"), 6).alias("log_growth"))


@query("win_13_recent_limit_up", f"""SELECT market, symbol, {DAY}, coalesce(max((close / nullif(p, 0) - 1.0) * 100.0) OVER (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 9.8, false) AS recent_limit_up
FROM (SELECT *, lag(close) OVER s AS p FROM bars {SYMBOL_FRAME})""")
def win_13(spark, d):
    return day_text(L.with_recent_limit_up(S.bars(spark, d).select("market", "symbol", "trading_day", "close"), 20).drop("close"))


@query("win_14_latest_previous", f"""SELECT market, symbol, {DAY}, close AS latest_close, previous_close, volume AS latest_volume FROM
(SELECT *, lag(close) OVER s AS previous_close, row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day DESC) AS rn FROM bars {SYMBOL_FRAME}) WHERE rn = 1""")
def win_14(spark, d):
    return day_text(L.latest_snapshot(S.bars(spark, d))).select("market", "symbol", "trading_day", "latest_close", "previous_close", "latest_volume")


@query("win_15_listed_days", f"SELECT market, symbol, {DAY}, row_number() OVER s AS listed_days, count(*) OVER (PARTITION BY market, symbol) AS total_days FROM bars {SYMBOL_FRAME}")
def win_15(spark, d):
    return day_text(L.with_listed_days(S.bars(spark, d).select("market", "symbol", "trading_day")))


@query("win_16_latest_statement", """SELECT n.market, n.symbol, n.period, n.revenue, n.net_profit, b.revenue AS prev_revenue, b.net_profit AS prev_net_profit
FROM (SELECT * FROM statements QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY period_ord DESC) = 1) n
LEFT JOIN (SELECT period, lag(period) OVER (ORDER BY period_ord) AS previous_period FROM (SELECT DISTINCT period, period_ord FROM statements)) w ON w.period = n.period
LEFT JOIN statements b ON b.market = n.market AND b.symbol = n.symbol AND b.period = w.previous_period""")
def win_16(spark, d):
    out = X.latest_with_previous(S.statements(spark, d), ["revenue", "net_profit"])
    return out.select("market", "symbol", "period", "revenue", "net_profit", "prev_revenue", "prev_net_profit")


@query("win_17_keep_last", """SELECT l_suppkey, y, q, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, year(l_shipdate) AS y, quarter(l_shipdate) AS q FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_suppkey, y, q ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1""")
def win_17(spark, d):
    from marketloom.plans import warehouse as H

    rows = S.table(spark, d, "lineitem").select(
        "l_suppkey", F.year("l_shipdate").cast("bigint").alias("y"), F.quarter("l_shipdate").cast("bigint").alias("q"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    newest = [col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return H.keep_first(rows, ["l_suppkey", "y", "q"], newest).drop("l_partkey", "l_shipdate")


add_view("vwap_points", """SELECT *, (cum_cents::DOUBLE / 100.0::DOUBLE) / (cum_volume::DOUBLE * 100.0::DOUBLE) AS vwap FROM (SELECT *, sum(amount_cents) OVER o AS cum_cents, sum(volume) OVER o AS cum_volume
  FROM ticks WHERE price IS NOT NULL AND volume <> 0 WINDOW o AS (PARTITION BY market, symbol, trading_day ORDER BY ts, event_id)) WHERE cum_volume > 0""")
add_view("vwap_strength", """SELECT market, symbol, trading_day, count(*) AS valid_points, count(*) FILTER (price >= vwap) AS above_count,
  bool_or(price < vwap AND price < vwap * (1.0::DOUBLE - 0.3::DOUBLE / 100.0::DOUBLE)) AS breached FROM vwap_points GROUP BY 1, 2, 3""")


@query("win_18_cumulative_vwap", "SELECT event_id, symbol, vwap, price >= vwap AS above FROM vwap_points")
def win_18(spark, d):
    return D.cumulative_vwap(S.ticks(spark, d)).select("event_id", "symbol", "vwap", (col("price") >= col("vwap")).alias("above"))


add_view("ref_base", f"SELECT * FROM (SELECT *, {', '.join(_ref_ret(n, k) for n, k in REFS)}, row_number() OVER s AS i FROM bars {SYMBOL_FRAME}) WHERE i >= 121")


@query("win_19_lagged_rps", f"SELECT market, symbol, {DAY}, {', '.join(_ref_rps(n, k) for n, k in REFS)} FROM ref_base")
def win_19(spark, d):
    out = M.reference_rps(M.reference_returns(S.bars(spark, d)), bound=S.universe_bound(spark, d), rows=S.line_bound(spark, d))
    return day_text(out).select("market", "symbol", "trading_day", *[f"ref{k}_rps_{n}" for n, k in REFS])


@query("win_20_industry_rank", """SELECT market, symbol, industry_level_2_name, row_number() OVER (PARTITION BY industry_level_2_name ORDER BY rps_20 DESC, market, symbol) AS industry_rank_20
FROM rps JOIN industry USING (market, symbol) WHERE rps_20 IS NOT NULL""")
def win_20(spark, d):
    rows = rps(spark, d).where(col("rps_20").isNotNull()).join(S.industry(spark, d), ["market", "symbol"])
    order = [col("rps_20").desc(), col("market").asc(), col("symbol").asc()]
    out = R.ordinal_rank(rows, ["industry_level_2_name"], order, "industry_rank_20", max_group_rows=S.universe_bound(spark, d))
    return out.select("market", "symbol", "industry_level_2_name", "industry_rank_20")
