"""SRT queries."""

from pyspark.sql import functions as F

from marketloom.catalog import query
from marketloom.catalog.momentum import DAY, day_text, rps
from marketloom.catalog.screeners import CONCEPT_SEARCH
from marketloom.operators import filters as X
from marketloom.operators import ranking as R
from marketloom.operators import rolling as L
from marketloom.plans import concepts as C
from marketloom.plans import scoring as K
from marketloom.sources import tables as S

col = F.col


def position(df, group, order, spark, d, out="position"):
    """The sorted position as a value, so that the order itself is compared."""
    return R.ordinal_rank(df, group, order, out, max_group_rows=S.universe_bound(spark, d))


@query("srt_01_multi_key_nulls_last", "SELECT market, symbol, return_250_pct, row_number() OVER (ORDER BY return_250_pct DESC NULLS LAST, return_20_pct NULLS LAST, market, symbol) AS position FROM rps")
def srt_01(spark, d):
    rows = rps(spark, d).select("market", "symbol", "return_250_pct", "return_20_pct", F.lit(1).alias("g"))
    order = [col("return_250_pct").desc_nulls_last(), col("return_20_pct").asc_nulls_last(), col("market").asc(), col("symbol").asc()]
    return position(rows, ["g"], order, spark, d).select("market", "symbol", "return_250_pct", "position")


@query("srt_02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def srt_02(spark, d):
    return S.table(spark, d, "orders").orderBy(col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("srt_03_page", "SELECT o_orderkey, o_totalprice, total, total_pages AS page, total_pages FROM (SELECT *, count(*) OVER () AS total, (count(*) OVER () + 199) // 200 AS total_pages, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn > (total_pages - 1) * 200")
def srt_03(spark, d):
    """A page far beyond the end is clamped to the last one; the page size is capped at 200."""
    rows = S.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return X.page(rows, [col("o_totalprice").desc(), col("o_orderkey").asc()], number_wanted=999_999, size=5000)


@query("srt_04_nulls_last_both_ways", "SELECT market, symbol, row_number() OVER (ORDER BY return_250_pct NULLS LAST, market, symbol) AS ascending, row_number() OVER (ORDER BY return_250_pct DESC NULLS LAST, market, symbol) AS descending FROM rps")
def srt_04(spark, d):
    rows = rps(spark, d).select("market", "symbol", "return_250_pct", F.lit(1).alias("g"))
    tie = [col("market").asc(), col("symbol").asc()]
    rows = position(rows, ["g"], [col("return_250_pct").asc_nulls_last(), *tie], spark, d, "ascending")
    return position(rows, ["g"], [col("return_250_pct").desc_nulls_last(), *tie], spark, d, "descending").drop("g", "return_250_pct")


@query("srt_05_exact_then_partial", CONCEPT_SEARCH.replace("LIMIT 20", "LIMIT 50"))
def srt_05(spark, d):
    return C.search_concepts(C.concept_sizes(S.concepts(spark, d)), "brand#1 economy 1", 50)


@query("srt_06_best_direction", """SELECT market, symbol, industry_level_2_name, position AS best_debt, row_number() OVER (PARTITION BY industry_level_2_name ORDER BY raw_revenue_growth DESC NULLS LAST, market, symbol) AS best_growth
FROM (SELECT *, row_number() OVER (PARTITION BY industry_level_2_name ORDER BY raw_debt_ratio NULLS LAST, market, symbol) AS position FROM newest_pair JOIN industry USING (market, symbol))""")
def srt_06(spark, d):
    newest = K.newest_with_year_ago(S.statements(spark, d))
    ind, bound = S.industry(spark, d), S.universe_bound(spark, d)
    debt = K.peer_benchmark(newest, ind, "debt_ratio", bound=bound).select("market", "symbol", "industry_level_2_name", col("position").alias("best_debt"))
    growth = K.peer_benchmark(newest, ind, "revenue_growth", bound=bound).select("market", "symbol", col("position").alias("best_growth"))
    return debt.join(growth, ["market", "symbol"])


@query("srt_07_tail_sessions", f"SELECT market, symbol, {DAY}, close FROM bars QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day DESC) <= 40")
def srt_07(spark, d):
    return day_text(L.tail(S.bars(spark, d).select("market", "symbol", "trading_day", "close"), 40))


@query("srt_08_peers_by_percentile", "SELECT market, symbol, sample_key, row_number() OVER (PARTITION BY industry_level_2_name, sample_key ORDER BY valuation_percentile NULLS LAST, market, symbol) AS position FROM peer_rows")
def srt_08(spark, d):
    from marketloom.catalog.valuation import val_08

    order = [col("valuation_percentile").asc_nulls_last(), col("market").asc(), col("symbol").asc()]
    return position(val_08(spark, d), ["industry_level_2_name", "sample_key"], order, spark, d).select("market", "symbol", "sample_key", "position")
