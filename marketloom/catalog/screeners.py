"""PRO, HEA, SCR, IND and VOL queries."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import aggregates, query, scores
from marketloom.catalog import valuation as cv
from marketloom.catalog.functions import sql_concept_rule, sql_tier
from marketloom.catalog.momentum import DAY, SYMBOL_FRAME, WINDOWS, day_text, last_day, rps, strategy_table
from marketloom.catalog.views import add_view, sql_round, sql_symbol
from marketloom.functions import numeric as N
from marketloom.functions import text as T
from marketloom.operators import rolling as L
from marketloom.plans import concepts as C
from marketloom.plans import industry as I
from marketloom.plans import intraday as D
from marketloom.plans import profile as R
from marketloom.plans import screener as X
from marketloom.plans import valuation as V
from marketloom.session import settle
from marketloom.sources import tables as S

col = F.col


@query("pro_01_stock_search", f"SELECT * FROM (SELECT *, {sql_tier('s00')} AS tier FROM securities) WHERE tier IS NOT NULL ORDER BY tier, symbol, market LIMIT 20")
def pro_01(spark, d):
    return C.search_stocks(S.securities(spark, d), " S00", 20)


CONCEPT_SEARCH = """SELECT concept_name, member_count, CASE WHEN lower(concept_name) = 'brand#1 economy 1' THEN 0 ELSE 1 END AS tier FROM (SELECT concept_name, count(*) AS member_count FROM concepts GROUP BY 1)
WHERE contains(lower(concept_name), 'brand#1 economy 1') ORDER BY tier, member_count DESC, concept_name LIMIT 20"""


@query("pro_02_concept_search", CONCEPT_SEARCH)
def pro_02(spark, d):
    return C.search_concepts(C.concept_sizes(S.concepts(spark, d)), "Brand#1 ECONOMY 1", 20)


EPS = "(SELECT market, symbol, eps, ttm_eps, total_shares, free_float_shares FROM trailing_rows QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY period_ord DESC) = 1)"
add_view("live_quotes", f"""SELECT CASE user_id % 3 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE 'bj' END AS market, {sql_symbol('user_id')} AS symbol, arg_max(price, (ts, event_id)) AS q_price, arg_max(volume, (ts, event_id)) AS q_volume
  FROM ticks GROUP BY 1, 2""")
add_view("basic_info", f"""SELECT market, symbol, coalesce(q_price, close) AS current_price, (coalesce(q_price, close) - previous_close) / nullif(previous_close, 0) * 100.0 AS change_pct,
  CASE WHEN coalesce(q_volume, volume) <> 0 THEN coalesce(q_volume, volume) / nullif(avg_volume_5, 0) END AS volume_ratio,
  total_shares / 1e8 AS total_shares, free_float_shares / 1e8 AS float_shares, close * total_shares / 1e8 AS a_share_market_cap, eps, CASE WHEN ttm_eps > 0 THEN close / ttm_eps END AS dynamic_pe
  FROM (SELECT * FROM volume_frames WHERE rn = 1) LEFT JOIN {EPS} USING (market, symbol) LEFT JOIN live_quotes USING (market, symbol)""")


@query("pro_03_basic_info", "SELECT * FROM basic_info")
def pro_03(spark, d):
    """A user's newest tick is the quote of the security it stands for; a security without ticks has none."""
    order = F.struct("ts", "event_id")
    ticks = S.ticks(spark, d).withColumn("market", S.market_of(col("user_id"))).withColumn("symbol", S.symbol_of(col("user_id")))
    quotes = ticks.groupBy("market", "symbol").agg(F.max_by("price", order).alias("price"), F.max_by("volume", order).alias("volume"))
    return R.basic_info(S.bars(spark, d), S.statements(spark, d), quotes.withColumn("last_close", F.lit(None).cast("double")))


# A few brands carry names the rules hide, so both verdicts occur.
add_view("labelled_concepts", "SELECT market, symbol, CASE WHEN starts_with(concept_name, 'Brand#1 ') THEN concept_name || ' 融资融券' WHEN starts_with(concept_name, 'Brand#2 ') THEN 'KDJ ' || concept_name ELSE concept_name END AS concept_name FROM concepts")


def labelled(spark, d):
    name = col("concept_name")
    return S.concepts(spark, d).withColumn("concept_name", F.when(name.startswith("Brand#1 "), F.concat(name, F.lit(" 融资融券"))).when(
        name.startswith("Brand#2 "), F.concat(F.lit("KDJ "), name)).otherwise(name))


RPS_LIST = ", ".join(f"r.rps_{n}" for n in WINDOWS)
MEAN_LIST = ", ".join(f"m.industry_rps_{n}" for n in WINDOWS)


def _irank(n):
    return f"CASE WHEN r.rps_{n} IS NOT NULL THEN row_number() OVER (PARTITION BY i.industry_level_2_name, r.symbol IS NULL ORDER BY r.rps_{n} DESC NULLS LAST, s.market, s.symbol) END AS industry_rank_{n}"


@query("pro_04_stock_profile", f"""SELECT s.market, s.symbol, s.stock_name, s.name_initials, i.industry_level_1_name || ' / ' || i.industry_level_2_name AS industry_display, coalesce(c.core, 0) AS core_concept_count,
coalesce(c.auxiliary, 0) AS auxiliary_concept_count, {RPS_LIST}, {MEAN_LIST}, {_irank(20)}, {_irank(50)} FROM securities s LEFT JOIN industry i USING (market, symbol)
LEFT JOIN (SELECT market, symbol, count(*) FILTER (rule = 'default_keep_core') AS core, count(*) FILTER (rule <> 'default_keep_core') AS auxiliary FROM (SELECT *, {sql_concept_rule('concept_name', 'rule_id')} AS rule FROM labelled_concepts) GROUP BY 1, 2) c USING (market, symbol)
LEFT JOIN rps r USING (market, symbol) LEFT JOIN industry_means m ON m.industry_level_2_name = i.industry_level_2_name""")
def pro_04(spark, d):
    return R.profiles(S.securities(spark, d), S.industry(spark, d), labelled(spark, d), settle(rps(spark, d)), bound=S.universe_bound(spark, d), members=S.line_bound(spark, d))


@query("pro_04_concept_lists", f"""SELECT market, symbol, sha1('tdx_local:' || concept_name) AS concept_id, concept_name, {sql_concept_rule('concept_name', 'bucket')} AS bucket, {sql_concept_rule('concept_name', 'rule_id')} = 'default_keep_core' AS is_core
FROM (SELECT DISTINCT market, symbol, concept_name FROM labelled_concepts)""")
def pro_04_lists(spark, d):
    """The core and auxiliary concepts of every security, one row each."""
    return R.concept_listing(labelled(spark, d), members=S.line_bound(spark, d)).select("market", "symbol", "concept_id", "concept_name", "bucket", (col("decision") == "keep_core").alias("is_core"))


@query("hea_01_industry_heatmap", f"""SELECT k.industry_level_2_code, k.industry_level_2_name, k.member_count, strftime(t.trading_day, '%Y-%m-%d') AS trading_day, c.pct_change, coalesce(c.stock_count, 0) AS stock_count, c.daily_volume
FROM (SELECT industry_level_2_code, min(industry_level_2_name) AS industry_level_2_name, count(*) AS member_count FROM industry GROUP BY 1) k
CROSS JOIN (SELECT DISTINCT trading_day FROM bars WHERE year(trading_day) = (SELECT year(max(l_shipdate)) FROM lineitem)) t
LEFT JOIN heat_cells c ON c.industry_level_2_code = k.industry_level_2_code AND c.trading_day = t.trading_day""")
def hea_01(spark, d):
    return day_text(I.heatmap(S.industry(spark, d), S.bars(spark, d), anchor=last_day(spark, d)))


# ---- stock screener -----------------------------------------------------------------------------------
def screener_table(spark, d, strategy=None):
    bound = S.universe_bound(spark, d)
    tables = cv.Tables(spark, d)
    scored = settle(scores.scored(spark, d, tables.statements))
    ranked = scores.C.with_ranks(scores.C.snapshot(scored), bound=bound)
    subs = scores.wide_scores(scored, "market_score").withColumnsRenamed({k: "sub_" + k for k in spec.SUB_KEYS})
    rows = cv.inputs(spark, d, tables)
    snap = V.industry_snapshot(rows, ["industry_level_2_name"])
    temperature = V.with_temperature(snap, cv.history(spark, d, tables)).select("industry_level_2_name", "temperature_label", "temperature_percentile_since_2022")
    valuation = cv.members_from(cv.classified_from(rows), bound).join(temperature, "industry_level_2_name", "left")
    strategies = strategy_table(spark, d, strategy) if strategy else None
    return X.screener_rows(ranked, subs, S.securities(spark, d), S.industry(spark, d), valuation, settle(rps(spark, d, tables.closes)), strategies, strategy)


SCREEN_COLUMNS = ["market", "symbol", "stock_name", "industry_level_1", "industry_level_2", "current_price", "pe_ttm", "ps_ttm", "total_market_cap", "free_float_market_cap", "market_total_score",
                  "industry_total_score", "market_total_rank", "market_total_universe_size", "industry_total_rank", "industry_total_universe_size", "classification", "classification_label",
                  "valuation_band_label", "primary_metric", "primary_percentile", "industry_temperature_label", "industry_temperature_percentile_since_2022", *scores.DIMS,
                  *[f"rps_{n}" for n in WINDOWS], *[f"industry_rps_{n}" for n in WINDOWS], "sub_roe_ex", "sub_debt_ratio"]
add_view("sub_scores", f"SELECT market, symbol, {', '.join(f'max(CASE WHEN sub_key = {chr(39)}{k}{chr(39)} THEN score END) AS sub_{k}' for k in spec.SUB_KEYS)} FROM market_scored GROUP BY 1, 2")
add_view("screener", f"""SELECT s.market, s.symbol, n.stock_name, coalesce(s.industry_level_1_name, i.industry_level_1_name) AS industry_level_1, coalesce(s.industry_level_2_name, i.industry_level_2_name) AS industry_level_2,
  v.current_price, v.pe_ttm, v.ps_ttm, v.total_market_cap, v.free_float_market_cap, s.market_total_score, s.ind_total_score AS industry_total_score, s.market_total_rank, s.market_total_universe_size,
  s.industry_total_rank, s.industry_total_universe_size, v.classification, v.classification_label, v.valuation_band_label, v.primary_metric, v.primary_percentile,
  t.temperature_label AS industry_temperature_label, t.temperature_percentile_since_2022 AS industry_temperature_percentile_since_2022, {', '.join('s.' + x for x in scores.DIMS)}, {RPS_LIST}, {MEAN_LIST}, u.* EXCLUDE (market, symbol)
  FROM score_ranked s LEFT JOIN sub_scores u ON u.market = s.market AND u.symbol = s.symbol LEFT JOIN securities n ON n.market = s.market AND n.symbol = s.symbol
  LEFT JOIN industry i ON i.market = s.market AND i.symbol = s.symbol LEFT JOIN val_members v ON v.market = s.market AND v.symbol = s.symbol
  LEFT JOIN val_snapshot t ON t.industry_level_2_name = v.industry_level_2_name LEFT JOIN rps r ON r.market = s.market AND r.symbol = s.symbol
  LEFT JOIN industry_means m ON m.industry_level_2_name = coalesce(s.industry_level_2_name, i.industry_level_2_name)""")
SCREEN_SQL = ", ".join(SCREEN_COLUMNS)
ORDER = "ORDER BY market_total_score DESC NULLS LAST, market_total_rank NULLS LAST, market, symbol"


@query("scr_01_stock_screener", f"""SELECT {SCREEN_SQL}, count(*) OVER () AS total, 1::BIGINT AS page, greatest(1, (count(*) OVER () + 49) // 50) AS total_pages FROM screener
WHERE market_total_score >= 40 AND max_rank_ok AND current_price <= 1000000 AND sub_debt_ratio >= 5 AND cashflow >= 2 AND primary_percentile <= 95 {ORDER} LIMIT 50""".replace("max_rank_ok", "market_total_rank <= 90"))
def scr_01(spark, d):
    rows = screener_table(spark, d).select(*SCREEN_COLUMNS)
    return X.stock_screener(rows, {"min_total_score": "40", "max_market_rank": "90", "max_current_price": "1000000", "min_sub_debt_ratio": "5", "min_dim_cashflow": "2", "max_primary_percentile": "95", "page": "1"})


@query("jon_04_screener_join", f"SELECT {SCREEN_SQL} FROM screener")
def jon_04(spark, d):
    return screener_table(spark, d).select(*SCREEN_COLUMNS)


# ---- tail session --------------------------------------------------------------------------------------
def recent_bars(spark, d):
    """The newest sessions of every symbol, all that quotes and recent statistics read; settled once."""
    return settle(L.tail(S.bars(spark, d), 21))


def quotes(recent):
    """The last session of every symbol as its quote."""
    return L.latest_snapshot(recent).select(
        "market", "symbol", col("latest_close").alias("price"), col("previous_close").alias("last_close"), "open", "high", "low",
        col("latest_volume").alias("volume"), col("latest_amount").alias("amount"))


def recent_stats(recent, sessions=spec.TAIL_SESSION["limit_up_lookback_days"]):
    limit_up = L.latest(L.with_recent_limit_up(recent.select("market", "symbol", "trading_day", "close"), sessions))
    return limit_up.select("market", "symbol", "recent_limit_up").join(L.latest_snapshot(recent).select("market", "symbol", "avg_volume_last_5"), ["market", "symbol"])


def today_points(spark, d):
    """Points of the newest day, keyed by the user that stands for a symbol."""
    t = S.ticks(spark, d)
    # compared with the stored column, so that the newest day reaches the scan as a pushed filter
    newest = S.table(spark, d, "events").agg(F.max("ts").cast("date").cast("timestamp_ntz")).scalar()
    return t.where(col("ts") >= newest).withColumn("market", S.market_of(col("user_id"))).withColumn("symbol", S.symbol_of(col("user_id")))


def tail_inputs(spark, d):
    recent = recent_bars(spark, d)
    return X.tail_session_inputs(quotes(recent), recent_stats(recent), cv.inputs(spark, d), today_points(spark, d))


FLAG_COLUMNS = ["market", "symbol", "gain_pct", "volume_ratio", "turnover_pct", *["ok_" + k for k in X.SWITCHES]]
add_view("today_points", f"""SELECT * REPLACE (CASE user_id % 3 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE 'bj' END AS market, {sql_symbol('user_id')} AS symbol)
  FROM ticks WHERE trading_day = (SELECT CAST(max(ts) AS DATE) FROM events) AND price IS NOT NULL AND volume <> 0""")
add_view("today_vwap", """SELECT market, symbol, count(*) AS valid_points, count(*) FILTER (price >= vwap) AS above, bool_or(price < vwap AND price < vwap * (1.0::DOUBLE - 0.3::DOUBLE / 100.0::DOUBLE)) AS breached
  FROM (SELECT *, (sum(amount_cents) OVER o::DOUBLE / 100.0::DOUBLE) / (sum(volume) OVER o::DOUBLE * 100.0::DOUBLE) AS vwap FROM today_points WINDOW o AS (PARTITION BY market, symbol ORDER BY ts, event_id)) GROUP BY 1, 2""")
add_view("limit_up", f"""SELECT market, symbol, coalesce(max((close / nullif(p, 0) - 1.0) * 100.0) >= 9.8, false) AS recent_limit_up FROM (SELECT *, lag(close) OVER s AS p, row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day DESC) AS rn FROM bars {SYMBOL_FRAME})
  WHERE rn <= 20 GROUP BY 1, 2""")
add_view("tail_rows", f"""SELECT f.market, f.symbol, f.close AS price, f.previous_close AS last_close, f.open, f.low, f.volume, f.amount, f.avg_volume_last_5, l.recent_limit_up, v.total_market_cap, v.free_float_market_cap,
  NOT t.breached AND t.above / t.valid_points::DOUBLE * 100.0 >= 80 AS points_pass, {sql_round('(f.close / nullif(f.previous_close, 0) - 1.0) * 100.0', 4)} AS gain_pct,
  CASE WHEN f.avg_volume_last_5 > 0 THEN f.volume / f.avg_volume_last_5 END AS volume_ratio, coalesce(nullif(v.free_float_market_cap, 0), v.total_market_cap) AS float_cap
  FROM (SELECT * FROM volume_frames WHERE rn = 1) f JOIN limit_up l USING (market, symbol) LEFT JOIN val_inputs v USING (market, symbol) LEFT JOIN today_vwap t USING (market, symbol)""")
FLAGS_SQL = """SELECT market, symbol, gain_pct, volume_ratio, turnover_pct, coalesce(gain_pct BETWEEN 3.0 AND 5.0, false) AS ok_gain_pct, coalesce(recent_limit_up, false) AS ok_limit_up_lookback_days, coalesce(volume_ratio >= 1.4, false) AS ok_min_volume_ratio,
  coalesce(total_market_cap <= 200, false) AS ok_max_market_cap_yi, coalesce(turnover_pct BETWEEN 5 AND 10, false) AS ok_turnover_pct,
  coalesce(points_pass, low >= amount / nullif(volume * 100.0::DOUBLE, 0) * (1.0::DOUBLE - 0.3::DOUBLE / 100.0::DOUBLE), false) AS ok_intraday_above_vwap, coalesce(price > open, false) AS ok_current_above_open
  FROM (SELECT *, CASE WHEN float_cap > 0 AND price > 0 THEN volume * 100.0::DOUBLE * price / (float_cap * 1e8) * 100.0 END AS turnover_pct FROM {0})"""
add_view("tail_flags", FLAGS_SQL.format("tail_rows"))


@query("scr_02_tail_session", "SELECT *, ok_gain_pct AND ok_limit_up_lookback_days AND ok_min_volume_ratio AND ok_max_market_cap_yi AND ok_turnover_pct AND ok_intraday_above_vwap AND ok_current_above_open AS matched FROM tail_flags")
def scr_02(spark, d):
    """All quotes with the verdict of each condition; the matches are the rows with ``matched``."""
    from functools import reduce

    flags = X.tail_session_flags(tail_inputs(spark, d)).select(*FLAG_COLUMNS)
    return flags.withColumn("matched", reduce(lambda a, b: a & b, [col("ok_" + k) for k in X.SWITCHES]))


SHOWN = {"gain_min_pct": -60.0, "gain_max_pct": 400.0, "min_volume_ratio": 0.5, "turnover_min_pct": 0.5, "turnover_max_pct": 1e9, "max_market_cap_yi": 200.0, "current_above_open": False, "intraday_above_vwap": False}
R2 = lambda c: sql_round(c, 2)
add_view("tail_measures", "SELECT *, CASE WHEN float_cap > 0 AND price > 0 THEN volume * 100.0::DOUBLE * price / (float_cap * 1e8) * 100.0 END AS turnover FROM tail_rows")


@query("scr_02_tail_session_rows", f"""SELECT t.market, t.symbol, coalesce(n.stock_name, t.symbol) AS stock_name, {R2('t.price')} AS current_price, {R2('t.gain_pct')} AS gain_pct, {R2('t.volume_ratio')} AS volume_ratio, {R2('t.total_market_cap')} AS market_cap_yi,
{R2('t.turnover')} AS turnover_pct, coalesce(s.industry_level_1_name, i.industry_level_1_name) AS industry_level_1, coalesce(s.industry_level_2_name, i.industry_level_2_name) AS industry_level_2, s.ind_total_score AS industry_total_score, s.industry_total_rank,
s.industry_total_universe_size, '涨幅|涨停基因|量比|市值|换手率' AS matched_conditions FROM tail_measures t LEFT JOIN securities n ON n.market = t.market AND n.symbol = t.symbol LEFT JOIN industry i ON i.market = t.market AND i.symbol = t.symbol
LEFT JOIN score_ranked s ON s.market = t.market AND s.symbol = t.symbol
WHERE t.gain_pct BETWEEN -60 AND 400 AND t.recent_limit_up AND t.volume_ratio >= 0.5 AND t.total_market_cap <= 200 AND t.turnover BETWEEN 0.5 AND 1e9""")
def scr_02_rows(spark, d):
    """The matches of wide conditions, as they are shown."""
    flags = X.tail_session_flags(tail_inputs(spark, d), SHOWN)
    matches = X.tail_session_matches(flags, conditions=SHOWN)
    ranked = scores.C.with_ranks(scores.C.snapshot(scores.scored(spark, d)), bound=S.universe_bound(spark, d))
    return X.tail_session_view(matches, S.securities(spark, d), S.industry(spark, d), ranked)


@query("flt_12_condition_switches", "SELECT market, symbol, gain_pct, '市值|全天在均价线上方|大部分时间在均价线上方' AS matched_conditions FROM tail_flags WHERE ok_max_market_cap_yi AND ok_intraday_above_vwap")
def flt_12(spark, d):
    enabled = {k: k in ("max_market_cap_yi", "intraday_above_vwap") for k in X.SWITCHES}
    return X.tail_session_matches(X.tail_session_flags(tail_inputs(spark, d)), enabled).select("market", "symbol", "gain_pct", "matched_conditions")


# ---- reference data from text ------------------------------------------------------------------------------
def industry_lines(spark, d):
    c, n = S.table(spark, d, "customer"), S.table(spark, d, "nation")
    two = lambda x: F.lpad(col(x).cast("string"), 2, "0")
    code = F.concat(F.when(col("c_custkey") % 11 == 0, "T").otherwise("X"), two("n_regionkey"), two("n_nationkey"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat_ws(
        "|", (col("c_custkey") % 2).cast("string"), F.lpad(col("c_custkey").cast("string"), 6, "0"), F.lit("T01"), F.lit(""), F.lit(""), code).alias("line"))


def concept_lines(spark, d):
    p = S.table(spark, d, "part")
    names = F.concat(F.lit(" "), col("p_name"), F.lit(" , 融资融券，"), col("p_brand"), F.lit(" ,"), col("p_type"), F.lit(","), col("p_name"), F.lit(",,"))
    return p.select(F.concat_ws("|", (col("p_partkey") % 3).cast("string"), F.lpad(col("p_partkey").cast("string"), 6, "0"), F.lit("7"), names, F.lit("0")).alias("line"))


SQL_IND = """SELECT 'industry' AS dataset, CASE c_custkey % 2 WHEN 0 THEN 'sz' ELSE 'sh' END AS market, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS symbol, n_name AS name, 'X' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, NULL::BIGINT AS rank_in_stock, r_name AS extra
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 11 <> 0"""
_CONCEPT = "SELECT 'concept', CASE p_partkey % 3 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE 'bj' END, lpad(CAST(p_partkey AS VARCHAR), 6, '0'), {0}, sha1('tdx_local:' || {0}), {1}::BIGINT, {2} FROM part"


@query("ind_01_reference_datasets", SQL_IND + "".join(" UNION ALL " + _CONCEPT.format(*x) for x in (("p_name", 1, "'core'"), ("'融资融券'", 2, "'membership'"), ("p_brand", 3, "'core'"), ("p_type", 4, "'core'"))))
def ind_01(spark, d):
    ind = S.industry(spark, d)
    names = ind.select(col("industry_level_1_code").alias("code"), col("industry_level_1_name").alias("name")).union(ind.select("industry_level_2_code", "industry_level_2_name")).distinct()
    n, r = S.table(spark, d, "nation"), S.table(spark, d, "region")
    two = lambda x: F.lpad(col(x).cast("string"), 2, "0")
    tree = n.join(r, n.n_regionkey == r.r_regionkey)
    names = tree.select(F.concat(F.lit("X"), two("r_regionkey")).alias("code"), col("r_name").alias("name")).union(
        tree.select(F.concat(F.lit("X"), two("r_regionkey"), two("n_nationkey")), "n_name")).distinct()
    industry = C.industry_rows(industry_lines(spark, d), names).select(
        F.lit("industry").alias("dataset"), "market", "symbol", col("level_2_name").alias("name"), col("level_2_code").alias("code"), F.lit(None).cast("bigint").alias("rank_in_stock"), col("level_1_name").alias("extra"))
    concept = C.concept_rows(concept_lines(spark, d)).select(
        F.lit("concept"), "market", "symbol", "concept_name", "concept_id", "concept_rank_in_stock", "bucket")
    return industry.union(concept)


add_view("tick_days", "SELECT market, symbol, trading_day, arg_max(price, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2, 3")
add_view("window_columns", "SELECT market, symbol, trading_day, " + ", ".join(
    f"sum(CASE WHEN {aggregates.CLOCK} BETWEEN '{a}:00' AND '{b}:00' THEN volume ELSE 0 END)::BIGINT AS {n}, count(*) FILTER ({aggregates.CLOCK} BETWEEN '{a}:00' AND '{b}:00') AS {n.removesuffix('_volume')}_bar_count" for n, a, b in spec.WINDOW_SPECS)
    + " FROM ticks GROUP BY 1, 2, 3")
VOLUME_SQL = f"SELECT market, symbol, {DAY}, close, open_15m_volume, open_15m_bar_count, window_1430_1445_volume, window_1430_1445_bar_count FROM tick_days JOIN window_columns USING (market, symbol, trading_day)"


def volume_rows(spark, d, limit=None):
    t = S.ticks(spark, d)
    daily = t.groupBy("market", "symbol", "trading_day").agg(F.max_by("price", F.struct("ts", "event_id")).alias("close"))
    return day_text(D.volume_history(daily, D.window_columns(t), limit))


@query("vol_01_volume_history", VOLUME_SQL + " QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day DESC) <= 20")
def vol_01(spark, d):
    return volume_rows(spark, d, 20)


@query("jon_15_daily_with_windows", VOLUME_SQL)
def jon_15(spark, d):
    return volume_rows(spark, d)
