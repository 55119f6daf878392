"""JON and SET queries that belong to no larger plan."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.aggregates import INDEX_SQL
from marketloom.catalog.momentum import DAY, RPS_COLUMNS, day_text, last_day, rps
from marketloom.catalog.screeners import screener_table
from marketloom.catalog.sources import STATEMENT_COLUMNS, STATEMENT_SQL, coded
from marketloom.functions import text as T
from marketloom.operators import tablesets as J
from marketloom.plans import concepts as C
from marketloom.plans import industry as I
from marketloom.plans import statements as X
from marketloom.sources import tables as S

col = F.col


@query("jon_01_industry_security", "SELECT i.market, i.symbol, stock_name, industry_level_1_name || ' / ' || industry_level_2_name AS industry_display FROM industry i LEFT JOIN securities USING (market, symbol)")
def jon_01(spark, d):
    ind = S.industry(spark, d)
    return J.with_names(ind.select("market", "symbol"), S.securities(spark, d), ind).drop("name_initials")


@query("jon_02_concept_security_industry", INDEX_SQL)
def jon_02(spark, d):
    return C.concept_index(
        S.concepts(spark, d), S.securities(spark, d), S.industry(spark, d), bound=S.universe_bound(spark, d), members=S.line_bound(spark, d))


@query("jon_03_rps_security_industry", f"SELECT market, symbol, {RPS_COLUMNS}, universe_size, stock_name, name_initials, industry_level_1_name || ' / ' || industry_level_2_name AS industry_display FROM rps LEFT JOIN securities USING (market, symbol) LEFT JOIN industry USING (market, symbol)")
def jon_03(spark, d):
    return J.with_names(rps(spark, d).drop("trading_day"), S.securities(spark, d), S.industry(spark, d))


@query("jon_05_precedence_coalesce", "SELECT market, symbol, industry_level_1, industry_level_2 FROM screener")
def jon_05(spark, d):
    return screener_table(spark, d).select("market", "symbol", "industry_level_1", "industry_level_2")


POOL = "(market, symbol) IN (SELECT (market, symbol) FROM industry WHERE industry_level_1_name IN ('ASIA', 'EUROPE')) AND (market, symbol) IN (SELECT (market, symbol) FROM concepts WHERE concept_name IN ('Brand#1 ECONOMY 1', 'Brand#17 ECONOMY 28', 'Brand#2 ECONOMY 11'))"


@query("jon_06_pool_semi_join", f"SELECT market, symbol, stock_name FROM securities WHERE {POOL}")
def jon_06(spark, d):
    pool = S.securities(spark, d).select("market", "symbol", "stock_name")
    pool = J.any_match(pool, S.industry(spark, d), "industry_level_1_name", ["ASIA", " EUROPE "])
    pool = J.any_match(pool, S.industry(spark, d), "industry_level_2_name", [])
    return J.any_match(pool, S.concepts(spark, d), "concept_name", ["Brand#1 ECONOMY 1", "Brand#17 ECONOMY 28", "Brand#2 ECONOMY 11"])


@query("jon_07_known_symbols", "SELECT market, symbol, count(*) AS concept_count FROM concepts WHERE (market, symbol) IN (SELECT (market, symbol) FROM industry WHERE industry_level_1_name = 'ASIA') GROUP BY 1, 2")
def jon_07(spark, d):
    known = S.industry(spark, d).where(col("industry_level_1_name") == "ASIA")
    return S.concepts(spark, d).join(known, ["market", "symbol"], "left_semi").groupBy("market", "symbol").agg(F.count(F.lit(1)).alias("concept_count"))


UPSERT_SQL = "SELECT market, symbol, period, CASE WHEN symbol IN (SELECT symbol FROM industry WHERE industry_level_1_name = 'ASIA') THEN revenue * 2 ELSE revenue END AS revenue FROM statements"


def upsert_sides(spark, d):
    rows = S.statements(spark, d).select("market", "symbol", "period", "revenue")
    asia = S.industry(spark, d).where(col("industry_level_1_name") == "ASIA")
    return rows, rows.join(asia, ["market", "symbol"], "left_semi").withColumn("revenue", col("revenue") * 2)


@query("jon_08_anti_join_union", UPSERT_SQL)
def jon_08(spark, d):
    existing, incoming = upsert_sides(spark, d)
    return J.replace_keys(existing, incoming, ["market", "symbol", "period"])


@query("jon_13_member_keys", "SELECT industry_level_2_code, market, symbol FROM industry WHERE industry_level_2_code IN (SELECT industry_level_2_code FROM industry GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)")
def jon_13(spark, d):
    ind = S.industry(spark, d)
    return I.member_keys(ind, I.industry_sizes(ind, 10))


@query("jon_14_industry_day_grid", f"""SELECT k.industry_level_2_code, strftime(t.trading_day, '%Y-%m-%d') AS trading_day, c.pct_change IS NULL AS is_empty
FROM (SELECT industry_level_2_code FROM industry GROUP BY 1) k CROSS JOIN (SELECT DISTINCT trading_day FROM bars WHERE year(trading_day) = (SELECT year(max(l_shipdate)) FROM lineitem)) t
LEFT JOIN heat_cells c ON c.industry_level_2_code = k.industry_level_2_code AND c.trading_day = t.trading_day""")
def jon_14(spark, d):
    grid = I.heatmap(S.industry(spark, d), S.bars(spark, d), anchor=last_day(spark, d))
    return day_text(grid).select("industry_level_2_code", "trading_day", col("pct_change").isNull().alias("is_empty"))


@query("set_01_union_all", "SELECT market, symbol, 'q' AS part, revenue, NULL::DOUBLE AS equity FROM statements WHERE period NOT LIKE '%A' UNION ALL SELECT market, symbol, 'a', NULL, equity FROM statements WHERE period LIKE '%A'")
def set_01(spark, d):
    rows = S.statements(spark, d)
    quarters = rows.where(~col("period").endswith("A")).select("market", "symbol", F.lit("q").alias("part"), "revenue")
    return quarters.unionByName(rows.where(col("period").endswith("A")).select("market", "symbol", F.lit("a").alias("part"), "equity"), allowMissingColumns=True)


@query("set_02_union_distinct", "SELECT DISTINCT strftime(day, '%Y-%m-%d') AS trading_day FROM (SELECT l_shipdate AS day FROM lineitem UNION SELECT o_orderdate FROM orders UNION SELECT ts FROM events)")
def set_02(spark, d):
    day = lambda t, c: S.table(spark, d, t).select(F.date_format(c, "yyyy-MM-dd").alias("trading_day"))
    return J.trading_days(day("lineitem", "l_shipdate"), day("orders", "o_orderdate"), day("events", "ts"))


@query("set_03_intersection", "SELECT part.p_partkey, len(list_intersect(string_split(part.p_name, ' '), string_split(q.p_name, ' '))) > 0 AS overlaps FROM part JOIN part q ON q.p_partkey = part.p_partkey + 1")
def set_03(spark, d):
    a = S.table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"))
    b = S.table(spark, d, "part").select((col("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", F.arrays_overlap("a", "b").alias("overlaps"))


@query("set_04_difference", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def set_04(spark, d):
    required = S.table(spark, d, "part").select("p_partkey")
    present = S.table(spark, d, "lineitem").where((col("l_returnflag") == "R") & (col("l_quantity") > 40)).select(col("l_partkey").alias("p_partkey"))
    return J.missing(required, present, "p_partkey")


@query("set_05_upsert", UPSERT_SQL)
def set_05(spark, d):
    """The stored period partitions after an upsert."""
    from marketloom.plans import warehouse as H
    from marketloom.session import fresh_path

    existing, incoming = (x.withColumn("code", col("symbol")) for x in upsert_sides(spark, d))
    store = H.VersionedPeriods(spark, fresh_path(spark, "upsert"))
    store.replace(existing)
    store.upsert(incoming, ["market", "symbol", "period"])
    return store.read().select("market", "symbol", "period", "revenue")
