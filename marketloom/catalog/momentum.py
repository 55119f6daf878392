"""MOM and SIG queries."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.views import add_view, sql_round, sql_round_wide
from marketloom.operators import rolling as L
from marketloom.plans import industry as I
from marketloom.plans import momentum as M
from marketloom.sources import tables as S


def last_day(spark, d):
    """Newest trading day as a scalar subquery; no row is fetched to the driver."""
    return S.table(spark, d, "lineitem").agg(F.to_date(F.max("l_shipdate"))).scalar()


def rps(spark, d, closes=None):
    return M.rps_table(closes or S.bars(spark, d), last_day(spark, d), bound=S.universe_bound(spark, d))


WINDOWS = spec.RPS_WINDOWS
UNIVERSE = "market IN ('sh', 'sz') AND substr(symbol, 1, 2) IN ('60', '68', '00', '30', '20')"


def _ret(n):
    return sql_round(f"(close / nullif(lag(close, {n}) OVER s, 0) - 1.0) * 100.0", 4) + f" AS return_{n}_pct"


def _rank(n, nulls=True):
    rank = f"row_number() OVER (PARTITION BY trading_day ORDER BY return_{n}_pct DESC NULLS LAST, market, symbol)"
    return f"{rank} AS rank_{n}, " + sql_round(f"(universe_size - {rank} + 1) / universe_size::DOUBLE * 100.0", 2) + f" AS rps_{n}"


RETURNS = ", ".join(_ret(n) for n in WINDOWS)
RANKS = ", ".join(_rank(n) for n in WINDOWS)
SYMBOL_FRAME = "WINDOW s AS (PARTITION BY market, symbol ORDER BY trading_day)"
ANY = " OR ".join(f"return_{n}_pct IS NOT NULL" for n in WINDOWS)

add_view("universe_bars", f"SELECT * FROM bars WHERE {UNIVERSE}")
add_view("universe_returns", f"SELECT *, row_number() OVER s AS sessions, {RETURNS} FROM universe_bars {SYMBOL_FRAME}")
add_view("newest_returns", """SELECT * REPLACE ((SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) AS trading_day)
  FROM universe_returns QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day DESC) = 1""")
add_view("rps_base", f"SELECT *, count(*) OVER () AS universe_size FROM newest_returns WHERE {ANY}")
add_view("rps", f"SELECT *, {RANKS} FROM rps_base")
add_view("daily_base", f"SELECT *, count(*) OVER (PARTITION BY trading_day) AS universe_size FROM (SELECT *, {RETURNS} FROM bars {SYMBOL_FRAME}) r WHERE {ANY}")
add_view("daily_rps", f"SELECT *, {RANKS} FROM daily_base")

DAY = "strftime(trading_day, '%Y-%m-%d') AS trading_day"
RPS_COLUMNS = ", ".join(f"return_{n}_pct, rank_{n}, rps_{n}" for n in WINDOWS)


def day_text(df):
    return df.withColumn("trading_day", F.date_format("trading_day", "yyyy-MM-dd"))


@query("mom_01_rps_table", f"SELECT {DAY}, market, symbol, {RPS_COLUMNS}, universe_size FROM rps")
def mom_01(spark, d):
    return day_text(rps(spark, d))


@query("mom_02_rps_search", """SELECT market, symbol, stock_name, rank_50 AS rank, rps_50 AS rps, return_50_pct AS return_pct
FROM rps JOIN securities USING (market, symbol) WHERE lower(stock_name) LIKE '%supplier#0000000%' OR symbol LIKE 'supplier#0000000%'
ORDER BY rank_50, rps_50 DESC, symbol, market LIMIT 20""")
def mom_02(spark, d):
    return M.search_rankings(rps(spark, d), S.securities(spark, d), "Supplier#0000000", window=50, limit=20)


POOL_LEVELS = ["ASIA", "EUROPE", "AMERICA"]
POOL_CONCEPTS = [f"{brand} {size}" for brand in ("Brand#1 ECONOMY", "Brand#2 STANDARD") for size in range(1, 51)]


@query("mom_03_pool_filter", f"""SELECT *, count(*) OVER () AS pool_size FROM (SELECT market, symbol, stock_name, rps_20, rps_50, rps_120, rps_250, return_20_pct, return_50_pct,
return_120_pct, return_250_pct, coalesce(rps_20, rps_50, -1.0::DOUBLE) AS sort_key
FROM securities LEFT JOIN rps USING (market, symbol)
WHERE (market, symbol) IN (SELECT (market, symbol) FROM industry WHERE industry_level_1_name IN ({', '.join(f"'{x}'" for x in POOL_LEVELS)}))
AND (market, symbol) IN (SELECT (market, symbol) FROM concepts WHERE concept_name IN ({', '.join(f"'{x}'" for x in POOL_CONCEPTS)})))
ORDER BY sort_key DESC, market, symbol LIMIT 100""")
def mom_03(spark, d):
    return M.pool_filter(S.securities(spark, d), S.industry(spark, d), S.concepts(spark, d), rps(spark, d), level1=POOL_LEVELS, concept_names=POOL_CONCEPTS)


@query("mom_04_industry_rps", """SELECT industry_level_1_name, industry_level_2_name, count(*) AS member_count,
""" + ", ".join(f"sum({'CAST(rps_%d * 100.0::DOUBLE AS BIGINT)' % n})::DOUBLE / 100.0::DOUBLE / count(rps_{n}) AS rps_{n}" for n in WINDOWS) + """
FROM industry LEFT JOIN rps USING (market, symbol) GROUP BY 1, 2""")
def mom_04(spark, d):
    return I.industry_rps(S.industry(spark, d), rps(spark, d))


SELF_RET = ", ".join(f"(close - lag(close, {n}) OVER s) / nullif(lag(close, {n}) OVER s, 0) * 100.0 AS raw_{n}" for n in WINDOWS)
add_view("self_returns", f"SELECT *, row_number() OVER s AS i, {SELF_RET} FROM bars {SYMBOL_FRAME}")


def _self_rps(n):
    pct = sql_round(
        f"len(list_filter(list(raw_{n}) OVER f, lambda x: x < raw_{n})) / len(list_filter(list(raw_{n}) OVER f, lambda x: x IS NOT NULL))::DOUBLE * 100.0", 2)
    return f"CASE WHEN i >= 120 AND raw_{n} IS NOT NULL THEN {pct} END AS rps_{n}"


@query("mom_05_self_rps_history", f"""SELECT market, symbol, {DAY}, {', '.join(_self_rps(n) for n in WINDOWS)},
{', '.join(sql_round(f'raw_{n}', 4) + f' AS return_{n}_pct' for n in WINDOWS)}
FROM self_returns WINDOW f AS (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""")
def mom_05(spark, d):
    return day_text(M.self_rps_history(S.bars(spark, d)))


def _index_rps(n):
    pct = sql_round(f"len(list_filter(list(raw_{n}) OVER f, lambda x: x < raw_{n})) / len(list_filter(list(raw_{n}) OVER f, lambda x: x IS NOT NULL))::DOUBLE * 100.0", 2)
    return f"CASE WHEN raw_{n} IS NOT NULL THEN {pct} END AS rps_{n}"


# The rounded index: each day's close feeds the next, day by day.
INDEX_KEY = "industry_level_2_code, industry_level_2_name"
INDEX_FOLD = f"""WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY {INDEX_KEY} ORDER BY trading_day) AS i FROM heat_cells),
fold AS (SELECT {INDEX_KEY}, 1::BIGINT AS i, 100.0::DOUBLE AS before FROM numbered WHERE i = 1
  UNION ALL SELECT f.industry_level_2_code, f.industry_level_2_name, f.i + 1, {sql_round_wide('f.before * (1.0 + coalesce(n.pct_change, 0) / 100.0::DOUBLE)', 4)}
  FROM fold f JOIN numbered n ON n.industry_level_2_code = f.industry_level_2_code AND n.industry_level_2_name = f.industry_level_2_name AND n.i = f.i),
steps AS (SELECT {INDEX_KEY}, trading_day, i, f.before AS open, f.before * (1.0 + coalesce(n.pct_change, 0) / 100.0::DOUBLE) AS close, coalesce(pct_change, 0) AS pct, stock_count AS n, daily_volume AS volume
  FROM numbered n JOIN fold f USING ({INDEX_KEY}, i)),
padded AS (SELECT *, greatest(greatest(open, close) * 0.002::DOUBLE, abs(close - open) * 0.25::DOUBLE) AS pad FROM steps),
index_bars AS (SELECT {INDEX_KEY}, trading_day, i, {sql_round_wide('open', 4)} AS open, {sql_round_wide('greatest(open, close) + pad', 4)} AS high, {sql_round_wide('greatest(0.0001::DOUBLE, least(open, close) - pad)', 4)} AS low,
  {sql_round_wide('close', 4)} AS close, coalesce(nullif(volume, 0), round(abs(pct) * greatest(n, 1) * 1000)) AS volume FROM padded)"""


@query("mom_06_industry_self_rps", f"""{INDEX_FOLD}, raw AS (SELECT *, {', '.join(
    f"CASE WHEN i > 1 THEN (close - first_value(close) OVER w{n}) / nullif(first_value(close) OVER w{n}, 0) * 100.0 END AS raw_{n}" for n in WINDOWS)} FROM index_bars
WINDOW {', '.join(f'w{n} AS (PARTITION BY {INDEX_KEY} ORDER BY trading_day ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)' for n in WINDOWS)})
SELECT {INDEX_KEY}, {DAY}, {', '.join(_index_rps(n) for n in WINDOWS)} FROM raw WINDOW f AS (PARTITION BY {INDEX_KEY} ORDER BY trading_day ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""")
def mom_06(spark, d):
    cells = I.heat_cells(S.industry(spark, d), S.bars(spark, d))
    return day_text(I.industry_index_rps(I.synthetic_index(cells)))


# ---- signals ------------------------------------------------------------------------------------
REFS = ((20, 1), (20, 2), (20, 3), (50, 3), (50, 5))
MA = {"ma_20": ("close", 20, 0), "ma_50": ("close", 50, 0), "ma_120": ("close", 120, 0), "ma_50_ago5": ("close", 50, 5),
      "ma_50_ago3": ("close", 50, 3), "volume_ma_5": ("volume", 5, 0)}


def sql_ma(column, n, at, out):
    frame = f"OVER (PARTITION BY market, symbol ORDER BY trading_day ROWS BETWEEN {n - 1 + at} PRECEDING AND {at} PRECEDING)"
    return (f"CASE WHEN count({column}) {frame} = {n} THEN sum(CAST({column} * 1000000.0::DOUBLE AS BIGINT)) {frame}::DOUBLE "
            f"/ 1000000.0::DOUBLE / {n} END AS {out}")


def _ref_ret(n, k):
    now, base = f"lag(close, {k}) OVER s", f"lag(close, {n + k}) OVER s"
    return f"CASE WHEN row_number() OVER s >= 121 THEN ({now} - {base}) / nullif({base}, 0) * 100.0 END AS ref{k}_return_{n}_pct"


def _ref_rps(n, k):
    v = f"ref{k}_return_{n}_pct"
    rank = f"row_number() OVER (PARTITION BY trading_day ORDER BY {v} DESC NULLS LAST, symbol, market)"
    size = f"count({v}) OVER (PARTITION BY trading_day)::DOUBLE"
    return f"CASE WHEN {v} IS NOT NULL THEN {sql_round(f'({size} - {rank} + 1) / {size} * 100.0', 2)} END AS ref{k}_rps_{n}"


add_view("signal_frames", f"SELECT *, {RETURNS}, {', '.join(_ref_ret(n, k) for n, k in REFS)}, {', '.join(sql_ma(*v, k) for k, v in MA.items())} FROM universe_bars {SYMBOL_FRAME}")
add_view("signal_base", f"SELECT *, count(*) OVER (PARTITION BY trading_day) AS universe_size FROM signal_frames WHERE {ANY}")
add_view("signal_inputs", f"SELECT *, {RANKS}, {', '.join(_ref_rps(n, k) for n, k in REFS)} FROM signal_base")

LAUNCH = {
    "rps_base": "rps_250 >= 80 AND rps_120 >= 85 AND rps_50 >= 88 AND rps_20 >= 92",
    "rps_structure": "rps_20 > rps_50 AND rps_50 >= rps_120 - 3 AND rps_120 >= rps_250 - 5",
    "rps_turning_point": "rps_20 > ref3_rps_20 AND rps_50 > ref5_rps_50",
    "trend_confirmed": "close > ma_20 AND ma_20 > ma_50 AND ma_50 >= ma_50_ago5 AND ma_120 IS NOT NULL",
    "volume_start": "volume > 1.3::DOUBLE * volume_ma_5",
}
ATTACK = {
    "rps_base": "rps_250 >= 75 AND rps_120 >= 80 AND rps_50 >= 82 AND rps_20 >= 88",
    "rps_acceleration": "rps_20 > ref1_rps_20 AND ref1_rps_20 > ref2_rps_20 AND rps_50 > ref3_rps_50",
    "rps_structure": "rps_20 > rps_50 AND rps_120 >= rps_250 - 8",
    "trend_confirmed": "close > ma_20 AND close > ma_50 AND ma_50 > ma_50_ago3",
    "volume_mild_expand": "volume > 1.2::DOUBLE * volume_ma_5",
}


def sql_signal(strategy, label, conditions):
    flags = ", ".join(f"coalesce({c}, false) AS {n}" for n, c in conditions.items())
    passed = " AND ".join(f"coalesce({c}, false)" for c in conditions.values())
    return (f"SELECT {DAY}, market, symbol, '{strategy}' AS strategy, '{label}' AS strategy_label, {flags}, ({passed}) AS passed "
            "FROM signal_inputs")


def inputs(spark, d):
    return M.signal_inputs(S.bars(spark, d), bound=S.universe_bound(spark, d), rows=S.line_bound(spark, d))


@query("sig_01_standard_launch", sql_signal("rps_standard_launch", "RPS标准", LAUNCH))
def sig_01(spark, d):
    return day_text(M.signal_rows(inputs(spark, d), spec.STANDARD_LAUNCH.strategy, candidates_only=False))


@query("sig_02_attack", sql_signal("rps_attack", "RPS进攻", ATTACK))
def sig_02(spark, d):
    return day_text(M.signal_rows(inputs(spark, d), spec.ATTACK.strategy, candidates_only=False))


CANDIDATES = "SELECT trading_day, market, symbol, strategy, strategy_label, passed FROM ({}) WHERE rps_base AND rps_structure"
BOTH = (CANDIDATES.format(sql_signal("rps_standard_launch", "RPS标准", LAUNCH)) + " UNION ALL "
        + CANDIDATES.format(sql_signal("rps_attack", "RPS进攻", ATTACK)))
SHORT = ("trading_day", "market", "symbol", "strategy", "strategy_label", "passed")


def strategy_table(spark, d, strategy):
    return day_text(M.signal_rows(inputs(spark, d), strategy)).select(*SHORT)


@query("sig_03_strategy_tables", BOTH)
def sig_03(spark, d):
    both = inputs(spark, d)
    parts = [day_text(M.signal_rows(both, s)).select(*SHORT) for s in M.CONDITIONS]
    return parts[0].unionByName(parts[1])


@query("sig_04_merge_strategy", BOTH)
def sig_04(spark, d):
    """The stored table holds both strategies, one of them outdated; the merge replaces it."""
    both = inputs(spark, d)
    launch, attack = (day_text(M.signal_rows(both, s)).select(*SHORT) for s in M.CONDITIONS)
    stored = launch.unionByName(attack.withColumn("passed", F.lit(False)))
    return M.merge_strategy(stored, spec.ATTACK.strategy, attack)


SIG_05_WANTED = ["click", "view", "purchase", "refund", "never_built"]


@query("sig_05_staleness", f"""SELECT w.strategy, b.built_at, (SELECT max(ts) FROM events) AS source_at, b.built_at IS NULL OR b.built_at < (SELECT max(ts) FROM events) AS is_stale
FROM (SELECT unnest([{', '.join(f"'{x}'" for x in SIG_05_WANTED)}]) AS strategy UNION SELECT event_type FROM events) w LEFT JOIN (SELECT event_type AS strategy, max(ts) AS built_at FROM events GROUP BY 1) b USING (strategy)""")
def sig_05(spark, d):
    """Every event type stands for a strategy table, the whole stream for its source table; some of the wanted tables are absent."""
    ev = S.table(spark, d, "events").select(F.col("event_type").alias("strategy"), F.col("ts").alias("generated_at"))
    built = M.strategy_is_stale(ev, ev)
    wanted = M.strategy_is_stale(ev, ev, SIG_05_WANTED)
    return built.unionByName(wanted).distinct().select("strategy", "built_at", "source_at", "is_stale")
