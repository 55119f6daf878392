"""VAL queries and the joins and aggregates they are made of."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.functions import sql_band
from marketloom.catalog.momentum import DAY, day_text
from marketloom.catalog.views import add_view, sql_scaled
from marketloom.functions import numeric as N
from marketloom.functions import periods as P
from marketloom.operators import asof
from marketloom.plans import statements as X
from marketloom.plans import valuation as V
from marketloom.session import settle
from marketloom.sources import tables as S

col = F.col
SINCE = 1999  # the given tables end in 2001
ANNUAL = {c: f"CASE period_ord % 10 WHEN 1 THEN {c}_q1 WHEN 2 THEN {c}_q2 WHEN 3 THEN {c}_q3 ELSE {c}_q4 END" for c in ("net_profit", "revenue", "eps")}


def sql_ttm(c):
    return (f"CASE WHEN {c} IS NOT NULL AND {c}_q1 IS NOT NULL AND {c}_q2 IS NOT NULL AND {c}_q3 IS NOT NULL THEN {c} + ({c}_q1 + {c}_q2 + {c}_q3) "
            f"WHEN period_ord % 10 <> 4 AND {c} IS NOT NULL AND {ANNUAL[c]} IS NOT NULL AND {c}_q4 IS NOT NULL THEN {c} + {ANNUAL[c]} - {c}_q4 ELSE {c} END")


FRAMES = ", ".join(f"b{k} AS (PARTITION BY market, symbol ORDER BY period_idx RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)" for k in (1, 2, 3, 4))
add_view("neighbours", "SELECT *, " + ", ".join(f"max({c}) OVER b{k} AS {c}_q{k}" for c in ("net_profit", "revenue", "eps") for k in (1, 2, 3, 4)) + f" FROM statements WINDOW {FRAMES}")
EPS_TTM = f"""CASE WHEN period_ord % 10 = 4 THEN eps WHEN eps IS NOT NULL AND {ANNUAL['eps']} IS NOT NULL AND eps_q4 IS NOT NULL THEN eps + {ANNUAL['eps']} - eps_q4
WHEN period_ord % 10 = 1 THEN eps * 4.0::DOUBLE WHEN period_ord % 10 = 2 THEN eps * 2.0::DOUBLE ELSE eps * 4.0::DOUBLE / 3.0::DOUBLE END"""
add_view("trailing_rows", f"SELECT *, {sql_ttm('net_profit')} / 1e8 AS ttm_net_profit, {sql_ttm('revenue')} / 1e8 AS ttm_revenue, {EPS_TTM} AS ttm_eps FROM neighbours")
PRICED = """SELECT *, CASE WHEN total_market_cap IS NOT NULL AND ttm_net_profit <> 0 THEN total_market_cap / ttm_net_profit WHEN ttm_eps > 0 THEN current_price / ttm_eps END AS pe_ttm,
  total_market_cap / nullif(ttm_revenue, 0) AS ps_ttm, CASE WHEN abs(revenue_growth) > 1 THEN revenue_growth / 100.0::DOUBLE ELSE revenue_growth END AS revenue_yoy,
  coalesce(CASE WHEN abs(gross_margin_pct) > 1 THEN gross_margin_pct / 100.0::DOUBLE ELSE gross_margin_pct END, (revenue - op_cost) / nullif(revenue, 0)) AS gross_margin,
  bvps AS book_value_per_share, false AS is_suspended
  FROM (SELECT *, current_price * total_shares / 1e8 AS total_market_cap, current_price * free_float_shares / 1e8 AS free_float_market_cap FROM {} r)"""
add_view("val_current_rows", """SELECT t.*, c.current_price, c.listed_days, i.industry_level_1_name, i.industry_level_2_name
  FROM (SELECT * FROM trailing_rows QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY period_ord DESC) = 1) t
  LEFT JOIN (SELECT market, symbol, arg_max(close, trading_day) AS current_price, count(*) AS listed_days FROM bars GROUP BY 1, 2) c USING (market, symbol)
  JOIN region_industry i USING (market, symbol)""")
add_view("val_inputs", PRICED.format("val_current_rows"))
add_view("period_probes", f"SELECT *, last_day(make_date(CAST(period_ord // 10 AS INTEGER), CAST(period_ord % 10 * 3 AS INTEGER), 1)) AS trading_day FROM trailing_rows WHERE period_ord // 10 >= {SINCE}")
add_view("bars_seen", "SELECT market, symbol, trading_day, close, row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day) AS sessions FROM bars")
add_view("val_period_rows", """SELECT p.*, b.close AS current_price, b.sessions AS listed_days, i.industry_level_1_name, i.industry_level_2_name
  FROM period_probes p ASOF LEFT JOIN bars_seen b ON p.market = b.market AND p.symbol = b.symbol AND p.trading_day >= b.trading_day
  JOIN region_industry i ON i.market = p.market AND i.symbol = p.symbol""")
add_view("val_period_inputs", PRICED.format("val_period_rows"))
REASON = """CASE WHEN is_suspended THEN 'suspended' WHEN listed_days < 60 THEN 'new_listing' WHEN book_value_per_share IS NULL OR book_value_per_share <= 0 THEN 'invalid_book_value'
  WHEN ttm_net_profit IS NULL OR ttm_net_profit <= 0 THEN 'loss' END"""


def sql_weighted(num, den):
    ok = f"reason IS NULL AND {num} IS NOT NULL AND {den} > 0"
    n, m = (f"(sum({sql_scaled(c, 10)}) FILTER ({ok}))::DOUBLE / 10000000000.0::DOUBLE" for c in (num, den))
    return f"CASE WHEN {m} > 0 THEN ({n}) / ({m}) END"


def sql_snapshot(source, by):
    return f"""SELECT *, CASE WHEN weighted_pe_ttm IS NOT NULL THEN least(greatest(weighted_pe_ttm * 5.0::DOUBLE, 50.0::DOUBLE), 200.0::DOUBLE) END AS pe_invalid_threshold,
  CASE WHEN valid_member_count < 10 THEN 'insufficient' ELSE 'ok' END AS sample_status FROM (SELECT {by}, count(*) AS total_member_count,
  count(*) FILTER (reason IS NULL) AS valid_member_count, count(*) FILTER (reason = 'loss') AS loss_count, count(*) FILTER (reason = 'invalid_book_value') AS invalid_book_value_count,
  count(*) FILTER (reason = 'new_listing') AS new_listing_filtered_count, count(*) FILTER (reason = 'suspended') AS suspended_filtered_count,
  coalesce({sql_weighted('total_market_cap', 'ttm_net_profit')}, {sql_weighted('free_float_market_cap', 'ttm_net_profit')}) AS weighted_pe_ttm,
  coalesce({sql_weighted('total_market_cap', 'ttm_revenue')}, {sql_weighted('free_float_market_cap', 'ttm_revenue')}) AS weighted_ps_ttm,
  {sql_weighted('free_float_market_cap', 'ttm_net_profit')} AS free_float_weighted_pe_ttm, {sql_weighted('free_float_market_cap', 'ttm_revenue')} AS free_float_weighted_ps_ttm
  FROM (SELECT *, {REASON} AS reason FROM {source}) GROUP BY ALL)"""


add_view("val_snapshot_base", sql_snapshot("val_inputs", "industry_level_2_name"))
add_view("val_period_snapshot", sql_snapshot("val_period_inputs", "industry_level_2_name, trading_day"))
add_view("val_history", "SELECT industry_level_2_name, trading_day, weighted_pe_ttm FROM val_period_snapshot WHERE sample_status = 'ok' AND weighted_pe_ttm IS NOT NULL")


def sql_percentile(probe, sample, on, value, sample_value, out):
    """Empirical percentile by counting sample rows per probe row."""
    return f"""SELECT * EXCLUDE (lt, eq, n, probe_id), CASE WHEN {value} IS NULL OR n = 0 THEN NULL WHEN n = 1 THEN 100.0::DOUBLE WHEN eq > 0 THEN (2 * lt + 1 + eq) / 2.0::DOUBLE / n * 100.0
  ELSE least(lt + 1, n) / n::DOUBLE * 100.0 END AS {out} FROM (SELECT p.*, count(s.{sample_value}) FILTER (s.{sample_value} < p.{value}) AS lt,
  count(s.{sample_value}) FILTER (s.{sample_value} = p.{value}) AS eq, count(s.{sample_value}) AS n FROM (SELECT *, row_number() OVER () AS probe_id FROM {probe}) p
  LEFT JOIN {sample} s ON {' AND '.join(f's.{c} = p.{c}' for c in on)} GROUP BY ALL)"""


add_view("val_probe", "SELECT *, CASE WHEN sample_status = 'ok' THEN weighted_pe_ttm END AS now_pe FROM val_snapshot_base")
add_view("val_snapshot", f"SELECT * EXCLUDE (now_pe), {sql_band('temperature_percentile_since_2022', spec.TEMPERATURE_BANDS)} AS temperature_label FROM ("
         + sql_percentile("val_probe", "val_history", ["industry_level_2_name"], "now_pe", "weighted_pe_ttm", "temperature_percentile_since_2022") + ")")
add_view("val_classified", """SELECT *, coalesce(listed_days < 60, false) AS is_new_listing, concat_ws('|', primary_metric, classification, sub_classification) AS sample_key,
  CASE primary_metric WHEN 'pe_ttm' THEN pe_ttm WHEN 'ps_ttm' THEN ps_ttm END AS primary_value,
  CASE classification WHEN 'A_NORMAL_EARNING' THEN 'A类 正常盈利' WHEN 'B_THIN_PROFIT_DISTORTED' THEN 'B类 微盈利畸高'
    ELSE CASE WHEN sub_classification IN ('C3_NO_REVENUE_CONCEPT', 'C4_LIQUIDATION_RISK') THEN 'D类 高风险例外' ELSE 'C类 亏损经营' END END AS classification_label
  FROM (SELECT *, CASE WHEN classification = 'A_NORMAL_EARNING' THEN 'pe_ttm' WHEN classification = 'B_THIN_PROFIT_DISTORTED' OR sub_classification IN ('C1_REVENUE_LOSS', 'C2_GROWTH_LOSS') THEN 'ps_ttm' END AS primary_metric
  FROM (SELECT *, CASE WHEN classification = 'C_LOSS' THEN CASE WHEN book_value_per_share <= 0 THEN 'C4_LIQUIDATION_RISK'
    WHEN CASE WHEN ttm_revenue > 10000 THEN ttm_revenue < 1000000 ELSE ttm_revenue < 0.01 END THEN 'C3_NO_REVENUE_CONCEPT'
    WHEN gross_margin >= 0.10 AND revenue_yoy >= 0.20 THEN 'C2_GROWTH_LOSS' ELSE 'C1_REVENUE_LOSS' END END AS sub_classification
  FROM (SELECT i.*, s.pe_invalid_threshold, CASE WHEN ttm_net_profit > 0 AND pe_ttm > 0 AND pe_ttm <= s.pe_invalid_threshold THEN 'A_NORMAL_EARNING' WHEN ttm_net_profit > 0 THEN 'B_THIN_PROFIT_DISTORTED' ELSE 'C_LOSS' END AS classification
  FROM val_inputs i LEFT JOIN val_snapshot_base s USING (industry_level_2_name))))""")
add_view("val_samples", """SELECT industry_level_2_name, 'pe_ttm|A_NORMAL_EARNING' AS sample_key, pe_ttm AS sample_value FROM val_classified WHERE NOT is_new_listing AND classification = 'A_NORMAL_EARNING' AND pe_ttm > 0
  UNION ALL SELECT industry_level_2_name, 'ps_ttm|B_THIN_PROFIT_DISTORTED', ps_ttm FROM val_classified WHERE NOT is_new_listing AND classification IN ('A_NORMAL_EARNING', 'B_THIN_PROFIT_DISTORTED') AND ps_ttm > 0
  UNION ALL SELECT industry_level_2_name, 'ps_ttm|C_LOSS|' || sub_classification, ps_ttm FROM val_classified WHERE NOT is_new_listing AND sub_classification IN ('C1_REVENUE_LOSS', 'C2_GROWTH_LOSS') AND ps_ttm > 0""")
add_view("val_members", f"SELECT *, CASE WHEN is_new_listing THEN '次新股' ELSE {sql_band('primary_percentile', spec.PERCENTILE_BANDS)} END AS valuation_band_label FROM ("
         + sql_percentile("val_classified", "val_samples", ["industry_level_2_name", "sample_key"], "primary_value", "sample_value", "primary_percentile") + ")")


class Tables:
    """Statements and closes of one query, materialised once because several branches read them."""

    def __init__(self, spark, d):
        self.statements = settle(S.statements(spark, d))
        self.closes = settle(S.bars(spark, d).select("market", "symbol", "trading_day", "close"))


def inputs(spark, d, tables=None):
    """One row per stock; every later step reads it, so it is settled once."""
    statements = tables.statements if tables else S.statements(spark, d)
    bars = tables.closes if tables else S.bars(spark, d)
    return settle(V.current_inputs(statements, bars, S.region_industry(spark, d)))


def period_inputs(spark, d, tables=None):
    statements = tables.statements if tables else S.statements(spark, d)
    bars = tables.closes if tables else S.bars(spark, d)
    return V.period_inputs(statements, bars, S.region_industry(spark, d), SINCE, bar_rows=S.line_bound(spark, d))


def history(spark, d, tables=None):
    return V.temperature_history(period_inputs(spark, d, tables))


def classified(spark, d):
    return classified_from(inputs(spark, d))


def classified_from(rows):
    return V.classified_members(rows, V.industry_snapshot(rows, ["industry_level_2_name"]))


def members(spark, d):
    return members_from(classified(spark, d), S.universe_bound(spark, d))


def members_from(rows, bound):
    return V.member_rows(rows, V.percentile_samples(rows), bound=bound)


@query("agg_09_ttm", f"SELECT market, symbol, period, {sql_ttm('net_profit')} AS ttm_net_profit, {sql_ttm('revenue')} AS ttm_revenue FROM neighbours")
def agg_09(spark, d):
    rows = X.with_neighbours(S.statements(spark, d), ["net_profit", "revenue"])
    return rows.select("market", "symbol", "period", X.ttm("net_profit").alias("ttm_net_profit"), X.ttm("revenue").alias("ttm_revenue"))


@query("jon_10_period_neighbours", f"SELECT market, symbol, period, revenue, revenue_q1, revenue_q2, revenue_q3, {ANNUAL['revenue']} AS revenue_prev_annual, revenue_q4 AS revenue_prev_same FROM neighbours")
def jon_10(spark, d):
    rows = X.with_neighbours(S.statements(spark, d), ["revenue"])
    return rows.select("market", "symbol", "period", "revenue", *[f"revenue_{x}" for x in ("q1", "q2", "q3", "prev_annual", "prev_same")])


@query("jon_09_asof_close", f"SELECT market, symbol, period, {DAY}, current_price AS asof_close, listed_days AS sessions FROM val_period_rows")
def jon_09(spark, d):
    rows = S.statements(spark, d).where(P.period_year(col("period")) >= SINCE).select("market", "symbol", "period", P.period_end_day(col("period")).alias("trading_day"))
    return day_text(asof.close_on_or_before(S.bars(spark, d), rows, "trading_day", rows=S.line_bound(spark, d)))


INPUT_SQL = ", ".join(V.INPUT_COLUMNS)


@query("val_01_inputs", f"SELECT {INPUT_SQL} FROM val_inputs")
def val_01(spark, d):
    return inputs(spark, d)


@query("val_02_period_inputs", f"SELECT {INPUT_SQL}, {DAY} FROM val_period_inputs")
def val_02(spark, d):
    return day_text(period_inputs(spark, d))


@query("val_03_classification", "SELECT market, symbol, classification, sub_classification, is_new_listing, primary_metric, classification_label FROM val_classified")
def val_03(spark, d):
    return classified(spark, d).select("market", "symbol", "classification", "sub_classification", "is_new_listing", "primary_metric", "classification_label")


SNAPSHOT = ("industry_level_2_name", "total_member_count", "valid_member_count", "loss_count", "invalid_book_value_count", "new_listing_filtered_count", "suspended_filtered_count",
            "weighted_pe_ttm", "weighted_ps_ttm", "free_float_weighted_pe_ttm", "free_float_weighted_ps_ttm", "pe_invalid_threshold", "sample_status")


@query("flt_06_member_cascade", f"SELECT market, symbol, period, {REASON} AS reason FROM val_period_inputs")
def flt_06(spark, d):
    rows = period_inputs(spark, d)
    return rows.select("market", "symbol", "period", V.rejection().alias("reason"))


@query("agg_06_weighted_ratio", f"SELECT industry_level_2_name, {sql_weighted('total_market_cap', 'ttm_net_profit')} AS weighted_pe, {sql_weighted('total_market_cap', 'ttm_revenue')} AS weighted_ps FROM (SELECT *, NULL AS reason FROM val_inputs) GROUP BY 1")
def agg_06(spark, d):
    every = F.lit(True)
    return inputs(spark, d).groupBy("industry_level_2_name").agg(
        V.weighted_ratio("total_market_cap", "ttm_net_profit", every).alias("weighted_pe"),
        V.weighted_ratio("total_market_cap", "ttm_revenue", every).alias("weighted_ps"))


@query("agg_07_industry_snapshot", f"SELECT {', '.join(SNAPSHOT)}, {DAY} FROM val_period_snapshot")
def agg_07(spark, d):
    rows = period_inputs(spark, d)
    return day_text(V.industry_snapshot(rows, ["industry_level_2_name", "trading_day"])).select(*SNAPSHOT, "trading_day")


@query("val_04_snapshot", f"SELECT {', '.join(SNAPSHOT)}, temperature_percentile_since_2022, temperature_label FROM val_snapshot")
def val_04(spark, d):
    tables = Tables(spark, d)
    snap = V.industry_snapshot(inputs(spark, d, tables), ["industry_level_2_name"])
    return V.with_temperature(snap, history(spark, d, tables)).select(*SNAPSHOT, "temperature_percentile_since_2022", "temperature_label")


HISTORY_SQL = f"SELECT industry_level_2_name, {DAY}, weighted_pe_ttm FROM val_history"


@query("val_05_temperature_history", HISTORY_SQL)
def val_05(spark, d):
    return day_text(history(spark, d))


@query("flt_10_history_filter", HISTORY_SQL)
def flt_10(spark, d):
    return day_text(history(spark, d))


@query("flt_14_periods_since", f"SELECT market, symbol, period FROM statements WHERE period_ord // 10 >= {SINCE}")
def flt_14(spark, d):
    return S.statements(spark, d).where(P.period_year(col("period")) >= SINCE).select("market", "symbol", "period")


@query("agg_13_percentile_samples", "SELECT * FROM val_samples")
def agg_13(spark, d):
    return V.percentile_samples(classified(spark, d))


@query("flt_09_sample_eligibility", "SELECT industry_level_2_name, sample_key, count(*) AS sample_size, min(sample_value) AS low, max(sample_value) AS high FROM val_samples GROUP BY 1, 2")
def flt_09(spark, d):
    return V.percentile_samples(classified(spark, d)).groupBy("industry_level_2_name", "sample_key").agg(
        F.count(F.lit(1)).alias("sample_size"), F.min("sample_value").alias("low"), F.max("sample_value").alias("high"))


MEMBER = ("market", "symbol", "industry_level_2_name", "classification", "sub_classification", "classification_label", "primary_metric", "primary_percentile", "valuation_band_label")


@query("val_06_member_rows", f"SELECT {', '.join(MEMBER)} FROM val_members")
def val_06(spark, d):
    return members(spark, d).select(*MEMBER)


@query("jon_11_percentile_probe", "SELECT market, symbol, sample_key, primary_value, primary_percentile FROM val_members")
def jon_11(spark, d):
    return members(spark, d).select("market", "symbol", "sample_key", "primary_value", "primary_percentile")


add_view("val_status", """SELECT m.* EXCLUDE (primary_percentile, valuation_band_label), CASE WHEN is_new_listing THEN 'new_listing' ELSE s.sample_status END AS sample_status,
  CASE WHEN NOT is_new_listing AND s.sample_status = 'ok' THEN primary_percentile END AS primary_percentile, s.temperature_label, s.weighted_pe_ttm FROM val_members m LEFT JOIN val_snapshot s USING (industry_level_2_name)""")
VERDICT = ("market", "symbol", "classification", "sub_classification", "sample_status", "primary_metric", "primary_percentile", "valuation_band_label", "weighted_pe_ttm", "notes", "risk_flags")


@query("val_07_relative_valuation", f"""SELECT market, symbol, classification, sub_classification, sample_status, primary_metric, primary_percentile, weighted_pe_ttm,
CASE WHEN sample_status = 'new_listing' THEN '次新股' WHEN sample_status <> 'ok' THEN '样本不足' ELSE {sql_band('primary_percentile', spec.PERCENTILE_BANDS)} END AS valuation_band_label,
CASE WHEN classification = 'B_THIN_PROFIT_DISTORTED' THEN 'PE invalid, fallback to PS percentile' ELSE '' END AS notes,
concat_ws('|', CASE WHEN is_new_listing THEN '上市未满60个交易日' END, CASE WHEN primary_percentile > 80 THEN '80%以上分位风险非线性上升' END,
CASE WHEN temperature_label IN ('行业偏热', '行业过热') THEN '行业环境偏热/过热' END) AS risk_flags FROM val_status""")
def val_07(spark, d):
    tables = Tables(spark, d)
    rows = inputs(spark, d, tables)
    snap = V.with_temperature(V.industry_snapshot(rows, ["industry_level_2_name"]), history(spark, d, tables))
    return V.relative_valuation(members_from(classified_from(rows), S.universe_bound(spark, d)), snap).select(*VERDICT)


add_view("val_peer_probe", """SELECT c.market, c.symbol, industry_level_2_name, k.sample_key, CASE WHEN starts_with(k.sample_key, 'pe_ttm') THEN CASE WHEN pe_ttm > 0 THEN pe_ttm END ELSE CASE WHEN ps_ttm > 0 THEN ps_ttm END END AS value
  FROM val_classified c JOIN (SELECT DISTINCT industry_level_2_name, sample_key FROM val_samples) k USING (industry_level_2_name)""")


add_view("peer_rows", f"SELECT market, symbol, industry_level_2_name, sample_key, value, valuation_percentile, coalesce({sql_band('valuation_percentile', spec.PERCENTILE_BANDS)}, '估值不可比') AS valuation_band FROM ("
         + sql_percentile("val_peer_probe", "val_samples", ["industry_level_2_name", "sample_key"], "value", "sample_value", "valuation_percentile") + ")")


@query("val_08_peer_percentiles", "SELECT * FROM peer_rows")
def val_08(spark, d):
    rows = classified(spark, d)
    out = V.peer_percentiles(rows, V.percentile_samples(rows), bound=S.universe_bound(spark, d))
    return out.select("market", "symbol", "industry_level_2_name", "sample_key", "value", "valuation_percentile", "valuation_band")


add_view("val_complete", """SELECT industry_level_2_name, member_valuation_row_count, coalesce(percentile_sample_count, 0) AS percentile_sample_count, member_valuation_row_count > 0 AS is_complete
  FROM (SELECT industry_level_2_name, count(*) AS member_valuation_row_count FROM val_classified GROUP BY 1) LEFT JOIN (SELECT industry_level_2_name, count(*) AS percentile_sample_count FROM val_samples GROUP BY 1) USING (industry_level_2_name)""")


@query("val_09_rebuild_incomplete", "SELECT *, CASE WHEN percentile_sample_count > 15 THEN 'reused' ELSE 'rebuilt' END AS origin FROM val_complete")
def val_09(spark, d):
    """The stored table has complete rows only for industries with more than 15 sample values."""
    rows = classified(spark, d)
    fresh = V.completeness(rows, V.percentile_samples(rows))
    stored = fresh.withColumn("is_complete", col("percentile_sample_count") > 15)
    return V.rebuild_incomplete(stored, fresh)


@query("agg_15_completeness", "SELECT count(*) AS industry_count, sum(member_valuation_row_count)::BIGINT AS member_rows, sum(percentile_sample_count)::BIGINT AS sample_values, count(*) FILTER (is_complete) AS complete_industries FROM val_complete")
def agg_15(spark, d):
    rows = classified(spark, d)
    return V.completeness(rows, V.percentile_samples(rows)).agg(
        F.count(F.lit(1)).alias("industry_count"), F.sum("member_valuation_row_count").alias("member_rows"),
        F.sum("percentile_sample_count").alias("sample_values"), F.count_if("is_complete").alias("complete_industries"))
