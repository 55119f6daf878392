"""FLT queries that belong to no larger plan."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.momentum import ATTACK, DAY, LAUNCH, UNIVERSE, day_text, inputs
from marketloom.catalog.screeners import screener_table
from marketloom.operators import filters as X
from marketloom.plans import concepts as C
from marketloom.plans import momentum as M
from marketloom.sources import tables as S

col = F.col


@query("flt_01_keyword", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def flt_01(spark, d):
    rows = X.keyword(S.table(spark, d, "customer"), "c_mktsegment", " BUILDING ")
    return X.keyword(rows, "c_name", "").select("c_custkey")


@query("flt_02_bounds", "SELECT market, symbol, period FROM statements WHERE roe_pct >= -20 AND roe_pct <= 40")
def flt_02(spark, d):
    return X.bounded(S.statements(spark, d), "roe_pct", low=-20.0, high=40.0).select("market", "symbol", "period")


@query("flt_03_fixed_bounds", "SELECT market, symbol FROM screener WHERE market_total_score >= 30 AND industry_total_score >= 20 AND market_total_rank <= 80 AND industry_total_rank <= 4 AND primary_percentile >= 5 AND primary_percentile <= 100 AND current_price >= 1 AND current_price <= 100000")
def flt_03(spark, d):
    params = {"min_total_score": "30", "min_ind_total_score": "20", "max_market_rank": "80", "max_industry_rank": "4", "min_primary_percentile": "5",
              "max_primary_percentile": "100", "min_current_price": "1", "max_current_price": "100000", "classification": ""}
    return X.screen(screener_table(spark, d), params).select("market", "symbol")


@query("flt_04_dynamic_bounds", "SELECT market, symbol FROM screener WHERE growth >= 5 AND solvency <= 9 AND sub_roe_ex >= 10 AND sub_free_cf <= 99 AND rps_20 >= 5 AND industry_rps_50 <= 95")
def flt_04(spark, d):
    params = {"min_dim_growth": "5", "max_dim_solvency": "9", "min_sub_roe_ex": "10", "max_sub_free_cf": "99", "min_rps_20": "5", "max_industry_rps_50": "95", "min_rps_33": "99", "page": "2"}
    return X.screen(screener_table(spark, d), params).select("market", "symbol")


@query("flt_05_rps_universe", f"SELECT market, symbol FROM securities WHERE {UNIVERSE}")
def flt_05(spark, d):
    return M.in_universe(S.securities(spark, d)).select("market", "symbol")


@query("flt_11_active_concepts", "SELECT sha1('tdx_local:' || concept_name) AS concept_id, concept_name FROM (SELECT DISTINCT concept_name FROM concepts) WHERE contains(lower(concept_name), 'economy') AND NOT concept_name LIKE '%7' ORDER BY concept_name LIMIT 100")
def flt_11(spark, d):
    from marketloom.functions import text as T

    names = S.concepts(spark, d).select("concept_name").distinct()
    dictionary = names.select(
        T.concept_id(col("concept_name")).alias("concept_id"), "concept_name", (~col("concept_name").endswith("7")).alias("is_active"))
    return C.active_concepts(dictionary, " ECONOMY ", 100)


@query("flt_13_strategy_candidates", f"SELECT {DAY}, market, symbol, coalesce(({LAUNCH['rps_base']}) AND ({LAUNCH['rps_structure']}), false) AS launch_candidate, coalesce(({ATTACK['rps_base']}) AND ({ATTACK['rps_structure']}), false) AS attack_candidate FROM signal_inputs")
def flt_13(spark, d):
    rows = inputs(spark, d)
    launch, attack = M.launch_conditions(), M.attack_conditions()
    return day_text(rows.select(
        "trading_day", "market", "symbol", (launch["rps_base"] & launch["rps_structure"]).alias("launch_candidate"),
        (attack["rps_base"] & attack["rps_structure"]).alias("attack_candidate")))
