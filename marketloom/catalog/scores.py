"""FIN queries with the frames and aggregates they are made of."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog import valuation as cv
from marketloom.catalog.views import add_view, sql_round, sql_scaled
from marketloom.functions import numeric as N
from marketloom.operators import ranking as R
from marketloom.plans import scoring as C
from marketloom.plans import statements as X
from marketloom.session import settle
from marketloom.sources import tables as S

col = F.col
SECTORS = ("ASIA",)  # stands for the finance sectors in the given tables
NO_INDUSTRY = "NATION_3"  # members of this nation stand for securities without an industry

RAW = {
    "roe_ex": "ex_net_profit / nullif(equity, 0) * 100.0::DOUBLE", "ocf_to_profit": "op_cf / nullif(net_profit, 0)", "free_cf": "op_cf - capex",
    "ar_to_asset": "nullif(ar, 0) / nullif(total_assets, 0) * 100.0::DOUBLE", "inv_to_asset": "nullif(inventory, 0) / nullif(total_assets, 0) * 100.0::DOUBLE",
    "goodwill_ratio": "nullif(goodwill, 0) / nullif(total_assets, 0) * 100.0::DOUBLE", "impair_to_rev": "nullif(impair_loss, 0) / nullif(revenue, 0) * 100.0::DOUBLE",
}
RAW = {k: RAW.get(k, k) for k in spec.SUB_KEYS}
META = {k: (dim, hb, zp) for k, dim, hb, zp in spec.SUB_INDICATORS}


def case_of(index, quote=True):
    val = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "CASE sub_key " + " ".join(f"WHEN '{k}' THEN {val(m[index])}" for k, m in META.items()) + " END"


add_view("score_industry", f"SELECT * FROM industry WHERE industry_level_2_name <> '{NO_INDUSTRY}'")
add_view("newest_statement", "SELECT * FROM statements QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY period_ord DESC) = 1")
add_view("raw_wide", "SELECT market, symbol, period, industry_level_1_name, industry_level_2_name, " + ", ".join(
    (f"CASE WHEN coalesce(industry_level_1_name IN ('ASIA'), false) THEN NULL ELSE {v} END AS {k}" if k in spec.FINANCIAL_SUPPRESSED else f"{v} AS {k}") for k, v in RAW.items())
    + " FROM newest_statement LEFT JOIN (SELECT market, symbol, industry_level_1_name, industry_level_2_name FROM score_industry) USING (market, symbol)")
add_view("raw_long", f"SELECT *, {case_of(0)} AS dim, {case_of(1)} AS hb, {case_of(2)} AS zp FROM raw_wide UNPIVOT INCLUDE NULLS (raw FOR sub_key IN ({', '.join(spec.SUB_KEYS)}))")
add_view("raw_usable", "SELECT *, CASE WHEN zp AND hb AND raw <= 0 THEN NULL ELSE raw END AS v FROM raw_long")


def sql_score(group, missing=50.0, source="raw_usable", where="true"):
    over = f"OVER (PARTITION BY {group})"
    rank = f"row_number() OVER (PARTITION BY {group} ORDER BY CASE WHEN hb THEN -v ELSE v END NULLS LAST, market, symbol)"
    score = sql_round(f"(n - rk + 1) / n::DOUBLE * 100.0", 4)
    return (f"SELECT * EXCLUDE (n, rk, raw_n), CASE WHEN v IS NOT NULL THEN {score} WHEN raw_n = 0 THEN {missing}::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE {missing}::DOUBLE END AS score "
            f"FROM (SELECT *, count(raw) {over} AS raw_n, count(v) {over} AS n, {rank} AS rk FROM {source} WHERE {where})")


add_view("market_scored", sql_score("sub_key"))
add_view("industry_scored", sql_score("sub_key, industry_level_2_name", where="industry_level_2_name IS NOT NULL"))
BLEND = f"CASE WHEN dim IN ('operating', 'solvency', 'asset_quality') AND industry_score IS NOT NULL THEN {sql_round('industry_score * 0.7::DOUBLE + market_score * 0.3::DOUBLE', 4)} ELSE market_score END"
add_view("scored", f"""SELECT *, {BLEND} AS blended_score FROM (SELECT m.* EXCLUDE (score), m.score AS market_score, i.score AS industry_score
  FROM market_scored m LEFT JOIN (SELECT market, symbol, sub_key, score FROM industry_scored) i USING (market, symbol, sub_key))""")


def sql_dim(dim, score):
    return f"sum(CASE WHEN dim = '{dim}' THEN {sql_scaled(f'coalesce({score}, 0.0::DOUBLE)', 4)} ELSE 0 END)::DOUBLE / 10000.0::DOUBLE / {C.DIM_SIZES[dim]} * {spec.DIM_WEIGHTS[dim]}::DOUBLE"


DIMS = list(spec.DIM_WEIGHTS)


def sql_total(prefix, digits):
    return sql_round(" + ".join(prefix + dim for dim in DIMS), digits)


add_view("score_dims", "SELECT market, symbol, period, industry_level_1_name, industry_level_2_name, " + ", ".join(
    [f"{sql_round(sql_dim(x, 'market_score'), 2)} AS {x}" for x in DIMS] + [f"{sql_round(sql_dim(x, 'industry_score'), 2)} AS ind_{x}" for x in DIMS]
    + [f"{sql_dim(x, 'blended_score')} AS blend_{x}" for x in DIMS]) + " FROM scored GROUP BY 1, 2, 3, 4, 5")
add_view("score_snapshot", f"SELECT * EXCLUDE ({', '.join('blend_' + x for x in DIMS)}), {sql_total('', 2)} AS total_score, {sql_total('ind_', 2)} AS ind_total_score, {sql_total('blend_', 4)} AS market_total_score FROM score_dims")
add_view("score_ranked", """SELECT *, row_number() OVER (ORDER BY market_total_score DESC NULLS LAST, market, symbol) AS market_total_rank, count(market_total_score) OVER () AS market_total_universe_size,
  CASE WHEN industry_level_2_name IS NOT NULL THEN row_number() OVER (PARTITION BY industry_level_2_name ORDER BY ind_total_score DESC NULLS LAST, market, symbol) END AS industry_total_rank,
  CASE WHEN industry_level_2_name IS NOT NULL THEN count(ind_total_score) OVER (PARTITION BY industry_level_2_name) END AS industry_total_universe_size FROM score_snapshot""")


def score_industry(spark, d):
    return S.industry(spark, d).where(col("industry_level_2_name") != NO_INDUSTRY)


def long_rows(spark, d, statements=None):
    return C.latest_long(statements or S.statements(spark, d), score_industry(spark, d), SECTORS)


def scored(spark, d, statements=None):
    """One row per security and indicator, read by several branches."""
    long = long_rows(spark, d, statements)
    return C.score_table(long if statements else settle(long), bound=S.universe_bound(spark, d))


def ranked(spark, d):
    return C.with_ranks(C.snapshot(scored(spark, d)), bound=S.universe_bound(spark, d))


@query("fin_01_raw_indicators", "SELECT market, symbol, period, " + ", ".join(f"{v} AS {k}" for k, v in RAW.items()) + " FROM statements")
def fin_01(spark, d):
    return C.with_raw(S.statements(spark, d), ["market", "symbol", "period"])


@query("flt_07_zero_penalty", "SELECT market, symbol, sub_key, v AS usable FROM raw_usable")
def flt_07(spark, d):
    usable = F.when(col("zero_penalty") & col("higher_better") & (col("raw") <= 0), None).otherwise(col("raw"))
    return long_rows(spark, d).select("market", "symbol", "sub_key", usable.alias("usable"))


@query("flt_08_financial_suppression", "SELECT market, symbol, industry_level_1_name, current_ratio, ar_days, asset_turn, debt_ratio FROM raw_wide")
def flt_08(spark, d):
    newest = X.latest(S.statements(spark, d)).join(score_industry(spark, d), ["market", "symbol"], "left")
    wide = C.suppress_financials(C.with_raw(newest, ["market", "symbol", "industry_level_1_name"]), SECTORS)
    return wide.select("market", "symbol", "industry_level_1_name", "current_ratio", "ar_days", "asset_turn", "debt_ratio")


@query("win_03_market_percentile", "SELECT market, symbol, sub_key, raw, score FROM market_scored")
def win_03(spark, d):
    return C.market_scores(long_rows(spark, d), bound=S.universe_bound(spark, d)).select("market", "symbol", "sub_key", "raw", "score")


@query("win_04_industry_percentile", "SELECT market, symbol, sub_key, industry_level_2_name, score FROM industry_scored")
def win_04(spark, d):
    return C.industry_scores(long_rows(spark, d), bound=S.universe_bound(spark, d)).select("market", "symbol", "sub_key", "industry_level_2_name", "score")


def pivoted(score):
    return ", ".join(f"max(CASE WHEN sub_key = '{k}' THEN {score} END) AS {k}" for k in spec.SUB_KEYS)


def wide_scores(rows, score):
    return rows.groupBy("market", "symbol").agg(*[F.max(F.when(col("sub_key") == k, col(score))).alias(k) for k in spec.SUB_KEYS])


@query("fin_02_market_scores", f"SELECT market, symbol, {pivoted('score')} FROM market_scored GROUP BY 1, 2")
def fin_02(spark, d):
    return wide_scores(C.market_scores(long_rows(spark, d), bound=S.universe_bound(spark, d)), "score")


@query("fin_03_industry_scores", f"SELECT market, symbol, {pivoted('score')} FROM industry_scored GROUP BY 1, 2")
def fin_03(spark, d):
    return wide_scores(C.industry_scores(long_rows(spark, d), bound=S.universe_bound(spark, d)), "score")


SNAP = ["market", "symbol", "period", "industry_level_2_name", *DIMS, "total_score", *["ind_" + x for x in DIMS], "ind_total_score"]


@query("fin_04_score_snapshot", f"SELECT {', '.join(SNAP)} FROM score_snapshot")
def fin_04(spark, d):
    return C.snapshot(scored(spark, d)).select(*SNAP)


add_view("single_scored", sql_score("sub_key, group_name", 0.0, "(SELECT *, coalesce(industry_level_2_name, '') AS group_name FROM raw_usable)"))


@query("fin_05_single_date_snapshot", f"SELECT market, symbol, {', '.join(sql_round(x, 2) + f' AS {x}' for x in DIMS)}, {sql_total('', 2)} AS total_score FROM (SELECT market, symbol, "
       + ", ".join(f"{sql_dim(x, 'score')} AS {x}" for x in DIMS) + " FROM single_scored GROUP BY 1, 2)")
def fin_05(spark, d):
    """One report date, industry percentiles only, missing scores 0; securities without industry form one group."""
    rows = long_rows(spark, d).withColumn("group_name", F.coalesce("industry_level_2_name", F.lit("")))
    out = R.percentile_scores(rows, ["sub_key", "group_name"], max_group_rows=S.universe_bound(spark, d), missing_default=0.0)
    wide = C.weighted_dims(out, "score", digits=None)
    return wide.select("market", "symbol", *[N.rounded(col(x), 2).alias(x) for x in DIMS], "total_score")


@query("fin_06_blended_scores", "SELECT market, symbol, sub_key, market_score, industry_score, blended_score FROM scored")
def fin_06(spark, d):
    return scored(spark, d).select("market", "symbol", "sub_key", "market_score", "industry_score", "blended_score")


@query("fin_07_batch_scores", f"SELECT *, {sql_total('', 2)} AS total_score FROM (SELECT market, symbol, {', '.join(sql_round(sql_dim(x, 'blended_score'), 2) + f' AS {x}' for x in DIMS)} FROM scored GROUP BY 1, 2)")
def fin_07(spark, d):
    return C.weighted_dims(scored(spark, d), "blended_score")


@query("agg_11_dimension_scores", f"SELECT *, {sql_total('', 2)} AS total_score FROM (SELECT market, symbol, {', '.join(sql_round(sql_dim(x, 'score'), 2) + f' AS {x}' for x in DIMS)} FROM market_scored GROUP BY 1, 2)")
def agg_11(spark, d):
    return C.weighted_dims(C.market_scores(long_rows(spark, d), bound=S.universe_bound(spark, d)), "score")


@query("win_05_score_ranks", "SELECT market, symbol, market_total_score, market_total_rank, market_total_universe_size, ind_total_score, industry_total_rank, industry_total_universe_size FROM score_ranked")
def win_05(spark, d):
    return ranked(spark, d).select(
        "market", "symbol", "market_total_score", "market_total_rank", "market_total_universe_size", "ind_total_score", "industry_total_rank", "industry_total_universe_size")


@query("agg_10_industry_raw_means", f"SELECT industry_level_2_name, sub_key, sum({sql_scaled('raw', 4)})::DOUBLE / 10000.0::DOUBLE / count(raw) AS industry_mean FROM raw_long WHERE industry_level_2_name IS NOT NULL AND raw IS NOT NULL GROUP BY 1, 2")
def agg_10(spark, d):
    return C.industry_raw_means(long_rows(spark, d))


@query("agg_12_period_distribution", "SELECT period, count(*) AS n FROM newest_statement GROUP BY 1")
def agg_12(spark, d):
    return X.latest(S.statements(spark, d)).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("agg_14_universe_sizes", "SELECT industry_level_1_name, industry_level_2_name, market, count(*) AS members, (SELECT count(*) FROM industry) AS universe_size FROM industry GROUP BY 1, 2, 3")
def agg_14(spark, d):
    rows = S.industry(spark, d)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.groupBy("industry_level_1_name", "industry_level_2_name", "market").agg(F.count(F.lit(1)).alias("members")).withColumn("universe_size", total)


COMPONENTS = sorted({r[1] for r in spec.DRIVERS} | {c for r in spec.DIAGNOSTICS for c in r[3].split(",")})
YEAR_AGO = "WINDOW ya AS (PARTITION BY market, symbol ORDER BY period_idx RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)"
add_view("with_raw", "SELECT *, " + ", ".join(f"{v} AS raw_{k}" for k, v in RAW.items()) + " FROM statements")
add_view("year_ago", "SELECT *, " + ", ".join(f"max({c}) OVER ya AS {c}_year_ago" for c in ["raw_" + k for k in spec.SUB_KEYS] + COMPONENTS) + f" FROM with_raw {YEAR_AGO}")
add_view("newest_pair", "SELECT * FROM year_ago QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY period_ord DESC) = 1")
add_view("raw_means", f"SELECT industry_level_2_name, sub_key, sum({sql_scaled('raw', 4)})::DOUBLE / 10000.0::DOUBLE / count(raw) AS industry_mean FROM raw_long WHERE industry_level_2_name IS NOT NULL AND raw IS NOT NULL GROUP BY 1, 2")


def newest_pair(spark, d):
    return C.newest_with_year_ago(S.statements(spark, d))


add_view("newest_long", " UNION ALL ".join(f"SELECT market, symbol, '{k}' AS sub_key, raw_{k} AS current_value, raw_{k}_year_ago AS previous_value FROM newest_pair" for k in spec.SUB_KEYS))
CARD = ("market", "symbol", "industry_level_2_name", "market_total_score", "market_total_rank", "ind_total_score", "industry_total_rank")


@query("fin_08_score_card", f"""SELECT {', '.join('r.' + c for c in CARD)}, n.sub_key, n.current_value, n.previous_value, m.industry_mean
FROM score_ranked r JOIN newest_long n USING (market, symbol) LEFT JOIN raw_means m ON m.industry_level_2_name = r.industry_level_2_name AND m.sub_key = n.sub_key""")
def fin_08(spark, d):
    """The whole card: every indicator now, a year ago and in the industry's mean, one row each."""
    long = settle(long_rows(spark, d))
    bound = S.universe_bound(spark, d)
    rows = C.with_ranks(C.snapshot(C.score_table(long, bound=bound)), bound=bound).select(*CARD)
    out = rows.join(C.indicator_rows(newest_pair(spark, d)), ["market", "symbol"])
    return out.join(C.industry_raw_means(long).select("industry_level_2_name", "sub_key", "industry_mean"), ["industry_level_2_name", "sub_key"], "left").select(
        *CARD, "sub_key", "current_value", "previous_value", "industry_mean")


PEER_SQL = """SELECT market, symbol, industry_level_2_name, report_date, report_date - 10000 AS previous_report_date, raw_inv_days AS metric_value, inventory, op_cost, inventory_year_ago, op_cost_year_ago,
row_number() OVER (PARTITION BY industry_level_2_name ORDER BY raw_inv_days NULLS LAST, market, symbol) AS position FROM newest_pair JOIN industry USING (market, symbol)"""


def _peer_table(key, higher, components):
    own, past = components[:C.INPUTS], [f"{c}_year_ago" for c in components[:C.INPUTS]]
    columns = [f"CAST({x[i] if i < len(x) else 'NULL'} AS DOUBLE) AS input_{i + 1}{end}" for x, end in ((own, ""), (past, "_year_ago")) for i in range(C.INPUTS)]
    return (f"SELECT market, symbol, industry_level_2_name, report_date, report_date - 10000 AS previous_report_date, '{key}' AS sub_key, raw_{key} AS metric_value, {', '.join(columns)}, "
            f"row_number() OVER (PARTITION BY industry_level_2_name ORDER BY raw_{key} {'DESC' if higher else 'ASC'} NULLS LAST, market, symbol) AS position FROM newest_pair JOIN industry USING (market, symbol)")


PEER_TABLES = " UNION ALL ".join(_peer_table(k, higher, dict((r[0], r[3].split(",")) for r in spec.DIAGNOSTICS)[k]) for k, _, higher, _ in spec.SUB_INDICATORS if k in {r[0] for r in spec.DIAGNOSTICS})


@query("fin_09_peer_benchmark", f"""SELECT p.*, coalesce(s.stock_name, symbol) AS stock_name, c.current_price FROM ({PEER_TABLES}) p LEFT JOIN securities s USING (market, symbol)
LEFT JOIN (SELECT market, symbol, arg_max(close, trading_day) AS current_price FROM bars GROUP BY 1, 2) c USING (market, symbol)""")
def fin_09(spark, d):
    closes = S.bars(spark, d).groupBy("market", "symbol").agg(F.max_by("close", "trading_day").alias("current_price"))
    return C.peer_tables(newest_pair(spark, d), S.industry(spark, d), S.securities(spark, d), closes, bound=S.universe_bound(spark, d))


@query("jon_12_peer_set", "SELECT market, symbol, industry_level_2_name, position, metric_value FROM (" + PEER_SQL.replace("raw_inv_days NULLS LAST", "raw_roe_ex DESC NULLS LAST").replace("raw_inv_days AS metric_value", "raw_roe_ex AS metric_value") + ")")
def jon_12(spark, d):
    rows = C.peer_benchmark(newest_pair(spark, d), S.industry(spark, d), "roe_ex", bound=S.universe_bound(spark, d))
    return rows.select("market", "symbol", "industry_level_2_name", "position", "metric_value")


@query("fin_10_total_benchmark", "SELECT market, symbol, industry_level_2_name, ind_total_score AS total_score, " + ", ".join(f"{sql_round(f'ind_{x} / {w}::DOUBLE', 4)} AS score_{x}" for x, w in spec.DIM_WEIGHTS.items())
       + ", v.current_price, v.total_market_cap, v.free_float_market_cap, v.pe_ttm, v.ps_ttm, row_number() OVER (PARTITION BY industry_level_2_name ORDER BY ind_total_score DESC NULLS LAST, market, symbol) AS position "
       "FROM score_snapshot LEFT JOIN (SELECT market, symbol, current_price, total_market_cap, free_float_market_cap, pe_ttm, ps_ttm FROM val_inputs) v USING (market, symbol) WHERE industry_level_2_name IS NOT NULL")
def fin_10(spark, d):
    tables = cv.Tables(spark, d)
    return C.total_benchmark(C.snapshot(scored(spark, d, tables.statements)), cv.inputs(spark, d, tables), bound=S.universe_bound(spark, d))


def _s(k):
    return f"coalesce(max(CASE WHEN sub_key = '{k}' THEN blended_score END), 0.0::DOUBLE) AS s_{k}"


def _yoy(k):
    return f"(raw_{k} - raw_{k}_year_ago) / nullif(abs(raw_{k}_year_ago), 0) * 100.0"


TRIO = ("roe_ex", "profit_growth", "ocf_to_profit")
STRENGTHS = ", ".join(["CASE WHEN s_roe_ex >= 75 THEN 'roe_ex_strong' END", "CASE WHEN s_profit_growth >= 75 THEN 'profit_growth_strong' END", "CASE WHEN s_ocf_to_profit >= 70 THEN 'cash_conversion_strong' END",
                       "CASE WHEN s_free_cf >= 80 THEN 'free_cash_strong' END", *[f"CASE WHEN {_yoy(k)} >= 20 THEN '{k}_improved' END" for k in TRIO]])
RISKS = ", ".join(["CASE WHEN raw_debt_ratio >= 60 THEN 'debt_ratio_high' WHEN s_debt_ratio <= 30 THEN 'debt_ratio_weak' END", "CASE WHEN s_goodwill_ratio <= 30 THEN 'goodwill_weak' END",
                   "CASE WHEN s_current_ratio <= 35 THEN 'current_ratio_weak' END", "CASE WHEN s_asset_turn <= 40 THEN 'asset_turn_weak' END", *[f"CASE WHEN {_yoy(k)} <= -20 THEN '{k}_declined' END" for k in TRIO]])
add_view("point_lists", f"""SELECT market, symbol, period, list_filter([{STRENGTHS}], lambda x: x IS NOT NULL)[1:4] AS strengths, list_filter([{RISKS}], lambda x: x IS NOT NULL)[1:4] AS risks
  FROM newest_pair JOIN (SELECT market, symbol, {', '.join(_s(k) for k in ('roe_ex', 'profit_growth', 'ocf_to_profit', 'free_cf', 'debt_ratio', 'goodwill_ratio', 'current_ratio', 'asset_turn'))} FROM scored GROUP BY 1, 2) USING (market, symbol)""")
_LIST = "SELECT market, symbol, period, '{0}' AS kind, unnest(range(1, len(l) + 1)) AS position, unnest(l) AS code FROM (SELECT *, CASE WHEN len({1}) = 0 THEN ['none'] ELSE {1} END AS l FROM point_lists)"


@query("fin_11_report_points", _LIST.format("strength", "strengths") + " UNION ALL " + _LIST.format("risk", "risks"))
def fin_11(spark, d):
    return C.report_points(newest_pair(spark, d), scored(spark, d))


def sql_diagnostics():
    parts = []
    for k, label, template, c, suffix, lower in spec.DIAGNOSTICS:
        strength, validate = spec.EVIDENCE[template]
        now, ago = (", ".join(f"{x}{end}::DOUBLE" for x in c.split(",")) for end in ("", "_year_ago"))
        worse = f"raw_{k} > raw_{k}_year_ago" if lower else f"raw_{k} < raw_{k}_year_ago"
        parts.append(f"""SELECT market, symbol, period, '{k}' AS sub_key, '{label}' AS indicator_name, '{template}' AS template_type, '{suffix}' AS suffix, {str(lower).lower()} AS lower_is_better,
'{strength}' AS evidence_strength, {str(validate).lower()} AS needs_text_validation, raw_{k} AS current_value, raw_{k}_year_ago AS previous_value, raw_{k} - raw_{k}_year_ago AS delta_value, '{c}' AS components, [{now}] AS component_values, [{ago}] AS previous_component_values,
CASE WHEN raw_{k} IS NULL OR raw_{k}_year_ago IS NULL THEN 'unknown' WHEN {worse} THEN 'cautious' ELSE 'positive' END AS trend FROM newest_pair""")
    return ("SELECT d.*, s.blended_score AS market_score, s.industry_score FROM (" + " UNION ALL ".join(parts) + ") d LEFT JOIN scored s USING (market, symbol, sub_key)").replace("d.*,", "market, symbol, d.period, sub_key, indicator_name, template_type, suffix, lower_is_better, evidence_strength, needs_text_validation, current_value, previous_value, delta_value, components, component_values, previous_component_values, trend,")


@query("fin_12_diagnostics", sql_diagnostics())
def fin_12(spark, d):
    return C.diagnostics(newest_pair(spark, d), scored(spark, d))


def sql_drivers():
    parts = []
    for no, (k, c, sens, label, up, down) in enumerate(spec.DRIVERS):
        delta = f"({c} - {c}_year_ago)"
        parts.append(f"""SELECT market, symbol, period, '{k}' AS sub_key, {no} AS no, sign(raw_{k} - raw_{k}_year_ago) AS direction, sign({delta}) * {sens} AS effect, coalesce(abs({delta}) / nullif(abs({c}_year_ago), 0), abs({delta})) AS weight,
'{label}' || CASE WHEN {delta} > 0 THEN '{up}' WHEN {delta} < 0 THEN '{down}' ELSE '基本持平' END AS fragment FROM newest_pair WHERE raw_{k} <> raw_{k}_year_ago""")
    pick = lambda test, n: f"max(CASE WHEN side = '{test}' AND rn = {n} THEN fragment END)"
    return f"""SELECT market, symbol, period, sub_key, coalesce({pick('aligned', 1)}, '暂无更强主因信号') AS main_driver, coalesce({pick('aligned', 2)}, {pick('neutral', 1)}, '暂无更强同向次因') AS secondary_driver,
coalesce({pick('opposing', 1)}, '暂无明显对冲项') AS hedge_driver FROM (SELECT *, row_number() OVER (PARTITION BY market, symbol, sub_key, side ORDER BY weight DESC, no) AS rn
FROM (SELECT *, CASE WHEN effect = direction THEN 'aligned' WHEN effect = -direction THEN 'opposing' WHEN effect = 0 THEN 'neutral' END AS side FROM ({' UNION ALL '.join(parts)}))) GROUP BY 1, 2, 3, 4"""


@query("fin_13_driver_triplets", sql_drivers())
def fin_13(spark, d):
    return C.driver_triplets(newest_pair(spark, d))


@query("fin_14_report_timeline", "SELECT market, symbol, period, report_date, announce_date, " + ", ".join(f"{RAW.get(m, m)} AS {m}" for m in C.REPORT_METRICS)
       + " FROM (SELECT *, max(report_date) OVER (PARTITION BY market, symbol) AS newest FROM statements) WHERE report_date // 10000 >= newest // 10000 - 2")
def fin_14(spark, d):
    return C.report_timeline(S.statements(spark, d))
