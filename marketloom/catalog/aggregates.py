"""AGG queries that belong to no larger plan."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.momentum import DAY, SYMBOL_FRAME, WINDOWS, day_text, rps
from marketloom.catalog.views import add_view, sql_round
from marketloom.operators import rolling as L
from marketloom.plans import concepts as C
from marketloom.plans import industry as I
from marketloom.plans import intraday as D
from marketloom.plans import screener as P
from marketloom.sources import tables as S

col = F.col


@query("agg_01_industry_sizes", """SELECT industry_level_2_code, min(industry_level_2_name) AS industry_level_2_name, count(DISTINCT (market, symbol)) AS member_count
FROM industry GROUP BY 1 ORDER BY 3 DESC, 1, 2""")
def agg_01(spark, d):
    return I.industry_sizes(S.industry(spark, d))


@query("agg_02_heat_cell", f"SELECT industry_level_2_code, industry_level_2_name, {DAY}, pct_change, stock_count, daily_volume FROM heat_cells")
def agg_02(spark, d):
    return day_text(I.heat_cells(S.industry(spark, d), S.bars(spark, d)))


DISPLAY = "i.industry_level_1_name || ' / ' || i.industry_level_2_name"
INDEX_SQL = f"""SELECT sha1('tdx_local:' || c.concept_name) AS concept_id, c.concept_name, n.member_count, c.market, c.symbol, s.stock_name, s.name_initials, coalesce({DISPLAY}, '') AS industry_display
FROM concepts c JOIN (SELECT concept_name, count(*) AS member_count FROM concepts GROUP BY 1) n USING (concept_name)
LEFT JOIN securities s USING (market, symbol) LEFT JOIN industry i USING (market, symbol)"""


@query("agg_03_concept_members", INDEX_SQL)
def agg_03(spark, d):
    return C.concept_index(
        S.concepts(spark, d), S.securities(spark, d), S.industry(spark, d), bound=S.universe_bound(spark, d), members=S.line_bound(spark, d))


@query("agg_04_industry_tree", "SELECT DISTINCT industry_level_1_name, industry_level_2_name FROM industry WHERE industry_level_1_name <> '' AND industry_level_2_name <> ''")
def agg_04(spark, d):
    rows = S.industry(spark, d).where((col("industry_level_1_name") != "") & (col("industry_level_2_name") != ""))
    return rows.select("industry_level_1_name", "industry_level_2_name").distinct()


def sql_mean(n):
    return sql_round(f"sum(CAST(rps_{n} * 100.0::DOUBLE AS BIGINT))::DOUBLE / 100.0::DOUBLE / nullif(count(rps_{n}), 0)", 2) + f" AS industry_rps_{n}"


add_view("industry_means", f"SELECT industry_level_2_name, {', '.join(sql_mean(n) for n in WINDOWS)} FROM rps JOIN industry USING (market, symbol) GROUP BY 1")


@query("agg_05_industry_rps_mean", "SELECT * FROM industry_means")
def agg_05(spark, d):
    return P.industry_rps_means(rps(spark, d), S.industry(spark, d))


CLOCK = "strftime(ts, '%H:%M:%S')"
WINDOW_ROWS = " UNION ALL ".join(f"SELECT *, '{n}' AS indicator_name FROM ticks WHERE {CLOCK} BETWEEN '{a}:00' AND '{b}:00'" for n, a, b in spec.WINDOW_SPECS)
add_view("window_sums", f"SELECT market, symbol, trading_day, indicator_name, sum(volume)::BIGINT AS volume_sum, sum(amount_cents)::DOUBLE / 100.0::DOUBLE AS amount_sum, count(*) AS bar_count FROM ({WINDOW_ROWS}) GROUP BY 1, 2, 3, 4")


@query("agg_08_window_sums", f"SELECT market, symbol, {DAY}, indicator_name, volume_sum, amount_sum, bar_count FROM window_sums")
def agg_08(spark, d):
    return day_text(D.window_sums(S.ticks(spark, d)))


@query("agg_16_latest_day", "SELECT industry_level_2_name, strftime(max(trading_day), '%Y-%m-%d') AS latest_trading_day FROM bars JOIN industry USING (market, symbol) GROUP BY 1")
def agg_16(spark, d):
    last = S.bars(spark, d).groupBy("market", "symbol").agg(F.max("trading_day").alias("day"))
    return last.join(S.industry(spark, d), ["market", "symbol"]).groupBy("industry_level_2_name").agg(F.date_format(F.max("day"), "yyyy-MM-dd").alias("latest_trading_day"))


add_view("volume_frames", f"""SELECT *, lag(close) OVER s AS previous_close, sum(nullif(volume, 0)) OVER e / nullif(count(nullif(volume, 0)) OVER e, 0)::DOUBLE AS avg_volume_5, sum(volume) OVER l / count(volume) OVER l::DOUBLE AS avg_volume_last_5,
  row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day DESC) AS rn FROM bars {SYMBOL_FRAME}, e AS (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  l AS (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")


@query("agg_17_average_volume", "SELECT market, symbol, avg_volume_5, avg_volume_last_5 FROM volume_frames WHERE rn = 1")
def agg_17(spark, d):
    return L.latest_snapshot(S.bars(spark, d)).select("market", "symbol", "avg_volume_5", "avg_volume_last_5")


@query("agg_18_symbol_count", "SELECT trading_day, count(DISTINCT market || ':' || symbol) AS symbol_count FROM (SELECT market, symbol, strftime(trading_day, '%Y-%m-%d') AS trading_day FROM bars) GROUP BY 1")
def agg_18(spark, d):
    return day_text(S.bars(spark, d).groupBy("trading_day").agg(F.countDistinct("market", "symbol").alias("symbol_count")))
