"""STR, DT, MTH and ARR queries: each function over whole columns of the given tables."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.momentum import DAY, INDEX_FOLD, day_text
from marketloom.catalog.views import add_view, sql_round, sql_scaled
from marketloom.functions import numeric as N
from marketloom.functions import periods as P
from marketloom.functions import text as T
from marketloom.plans import concepts as C
from marketloom.sources import tables as S

col = F.col


def customers(spark, d):
    """Customers with a six-digit code whose prefixes vary."""
    return S.table(spark, d, "customer").select(
        "*", F.lpad((col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0").alias("code"))


add_view("coded", "SELECT *, lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code FROM customer")


@query("str_01_market_from_flag", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' WHEN 2 THEN 'bj' ELSE '3' END AS market
FROM customer""")
def str_01(spark, d):
    return customers(spark, d).select("c_custkey", T.market_from_flag((col("c_custkey") % 4).cast("string")).alias("market"))


def _starts(prefixes):
    return "(" + " OR ".join(f"starts_with(code, '{p}')" for p in prefixes) + ")"


def _prefix_case(entries):
    whens = " ".join(f"WHEN {_starts(p)} THEN '{m}'" for m, p in entries if p)
    default = [m for m, p in entries if p is None]
    return f"CASE {whens} " + (f"ELSE '{default[0]}' END" if default else "END")


@query("str_02_market_from_prefix", "SELECT c_custkey, code, " + ", ".join(
    f"{_prefix_case(v)} AS market_{k}" for k, v in spec.MARKET_PREFIXES.items()) + " FROM coded")
def str_02(spark, d):
    return customers(spark, d).select(
        "c_custkey", "code", *[T.market_from_prefix(col("code"), k).alias(f"market_{k}") for k in spec.MARKET_PREFIXES])


@query("str_03_a_share_eligible", """SELECT c_custkey, (starts_with(code, '6') OR starts_with(code, '00') OR starts_with(code, '30') OR starts_with(code, '92'))
AND c_custkey % 5 NOT IN (0, 1) AS eligible FROM coded""")
def str_03(spark, d):
    name = F.when(col("c_custkey") % 5 == 0, F.concat(F.lit("*ST"), "c_name")).when(
        col("c_custkey") % 5 == 1, F.concat(F.lit("S "), "c_name")).otherwise(col("c_name"))
    return customers(spark, d).select("c_custkey", T.is_a_share_eligible(col("code"), name).alias("eligible"))


@query("str_04_canonical_code", "SELECT c_custkey, CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer")
def str_04(spark, d):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("sh:", " SZ:", "bj:", "")]), (col("c_custkey") % 4 + 1).cast("int"))
    raw = F.concat(prefix, col("c_custkey").cast("string"))
    return S.table(spark, d, "customer").select("c_custkey", T.canonical_code(raw).alias("code"))


@query("str_05_split_key", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE 'bj' END AS market, code AS symbol FROM coded")
def str_05(spark, d):
    key = T.key_of(F.upper(S.market_of(col("c_custkey"))), F.concat(F.lit(" "), col("code")))
    return customers(spark, d).select("c_custkey", T.key_market(key).alias("market"), T.key_symbol(key).alias("symbol"))


@query("str_06_normalize_text", """SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS segment, lower(c_name) AS query FROM customer""")
def str_06(spark, d):
    padded = F.concat(F.lit("  "), F.nullif(col("c_mktsegment"), F.lit("BUILDING")), F.lit(" "))
    return S.table(spark, d, "customer").select(
        "c_custkey", T.normalize_text(padded).alias("segment"), T.normalize_query(F.concat("c_name", F.lit(" "))).alias("query"))


WS = T.WHITE_SPACE


@query("str_07_collapse_whitespace", f"SELECT doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) AS name FROM documents")
def str_07(spark, d):
    return S.table(spark, d, "documents").select("doc_id", T.normalize_concept(col("text")).alias("name"))


add_view("doc_parts", f"""SELECT doc_id, name, min(i) AS first_at FROM (SELECT doc_id, trim(regexp_replace(part, '{WS}', ' ', 'g')) AS name, i FROM
(SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[,，]') AS parts FROM documents)))
WHERE name <> '' GROUP BY 1, 2""")
RANKED_PARTS = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_at) AS concept_rank, {} AS {} FROM doc_parts"


@query("str_08_split_concepts", RANKED_PARTS.format("name", "concept_name"))
def str_08(spark, d):
    names = S.table(spark, d, "documents").select("doc_id", F.posexplode(T.split_concepts(col("text"))).alias("pos", "concept_name"))
    return names.select("doc_id", (col("pos") + 1).cast("bigint").alias("concept_rank"), "concept_name")


@query("str_09_concept_id", "SELECT DISTINCT concept_name, sha1('tdx_local:' || concept_name) AS concept_id FROM concepts")
def str_09(spark, d):
    return S.concepts(spark, d).select("concept_name").distinct().select("concept_name", T.concept_id(col("concept_name")).alias("concept_id"))


add_view("industry_codes", """SELECT c_custkey, substr('X' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '01',
  1, CAST(2 + c_custkey % 6 AS INTEGER)) AS code FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
add_view("code_names", """SELECT DISTINCT industry_level_1_code AS code, industry_level_1_name AS name FROM industry
  UNION SELECT DISTINCT industry_level_2_code, industry_level_2_name FROM industry""")


@query("str_10_industry_hierarchy", """SELECT c_custkey, c.code AS raw_code, level_1_code, level_2_code, level_3_code,
coalesce(a.name, '') AS level_1_name, coalesce(b.name, '') AS level_2_name, coalesce(e.name, '') AS level_3_name
FROM (SELECT *, CASE WHEN length(code) >= 3 THEN substr(code, 1, 3) ELSE '' END AS level_1_code,
  CASE WHEN length(code) >= 5 THEN substr(code, 1, 5) ELSE '' END AS level_2_code,
  CASE WHEN length(code) >= 7 THEN code ELSE '' END AS level_3_code FROM industry_codes) c
LEFT JOIN code_names a ON a.code = level_1_code LEFT JOIN code_names b ON b.code = level_2_code LEFT JOIN code_names e ON e.code = level_3_code""")
def str_10(spark, d):
    c, n = S.table(spark, d, "customer"), S.table(spark, d, "nation")
    two = lambda x: F.lpad(col(x).cast("string"), 2, "0")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey",
        F.substring(F.concat(F.lit("X"), two("n_regionkey"), two("n_nationkey"), F.lit("01")), 1, (2 + col("c_custkey") % 6).cast("int")).alias("raw_code"))
    ind = S.industry(spark, d)
    names = ind.select(col("industry_level_1_code").alias("code"), col("industry_level_1_name").alias("name")).union(
        ind.select("industry_level_2_code", "industry_level_2_name")).distinct()
    return C.industry_hierarchy(rows, names)


@query("str_11_industry_code_map", """SELECT 'X' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, arg_max(p_name, p_partkey) AS name FROM part
WHERE p_partkey % 7 <> 0 GROUP BY 1""")
def str_11(spark, d):
    short = F.concat_ws("|", col("p_name"), F.lit("x"))
    full = F.concat_ws("|", col("p_name"), col("p_brand"), F.lit("0"), F.lit("1"), F.lit("2"), F.concat(F.lit(" X"), F.lpad(col("p_size").cast("string"), 2, "0")))
    lines = S.table(spark, d, "part").select(
        col("p_partkey").alias("line_no"), F.when(col("p_partkey") % 7 == 0, short).otherwise(full).alias("line"))
    return C.industry_code_map(lines)


@query("str_12_industry_display", """SELECT market, symbol, CASE WHEN industry_level_1_name = 'ASIA' THEN industry_level_2_name
ELSE industry_level_1_name || ' / ' || industry_level_2_name END AS industry_display FROM industry""")
def str_12(spark, d):
    l1 = F.when(col("industry_level_1_name") == "ASIA", " ").otherwise(col("industry_level_1_name"))
    return S.industry(spark, d).select(
        "market", "symbol", T.industry_display(l1, col("industry_level_2_name"), F.lit(None).cast("string")).alias("industry_display"))


@query("str_13_rule_match", r"""SELECT doc_id, lang IN ('en', 'fr') AS exact_hit, contains(text, 'th') OR contains(text, 'eau') AS contains_hit,
regexp_matches(text, '[;；]') OR regexp_matches(text, '\d{4}') AS regex_hit FROM documents""")
def str_13(spark, d):
    text = col("text")
    return S.table(spark, d, "documents").select(
        "doc_id", T.rule_matches(col("lang"), "exact", ("en", "fr")).alias("exact_hit"),
        T.rule_matches(text, "contains", ("th", "eau")).alias("contains_hit"),
        T.rule_matches(text, "regex_any", ("[;；]", r"\d{4}")).alias("regex_hit"))


# Concept-like names: every part name carries one of these endings, chosen by its key.
ENDINGS = ("KDJ超卖", "不可减持(新规)", "", "融资融券", "<-旧名", "年报点评", "；研发", "占总股本 3.5%", "MACD金叉", "")
SQL_ENDING = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS)) + " END"
add_view("named_parts", f"SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 THEN '' WHEN p_partkey % 100 = 2 THEN '20260326 ' || p_name WHEN p_partkey % 100 = 9 THEN '个人' ELSE p_name END || {SQL_ENDING} AS name FROM part")


def named_parts(spark, d):
    k = col("p_partkey")
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (k % 10 + 1).cast("int"))
    head = F.when(k % 10 == 7, "").when(k % 100 == 2, F.concat(F.lit("20260326 "), "p_name")).when(k % 100 == 9, "个人").otherwise(col("p_name"))
    return S.table(spark, d, "part").select("p_partkey", F.concat(head, ending).alias("name"))


def sql_concept_rule(name, field):
    """The rule table in SQL; rules with lookahead are left out, no given name can hit them."""
    out = []
    for rule_id, _p, bucket, kind, patterns in sorted(spec.CONCEPT_RULES, key=lambda r: r[1]):
        patterns = [p for p in patterns if "(?=" not in p]
        if not patterns:
            continue
        value = rule_id if field == "rule_id" else bucket
        if kind == "exact":
            hit = f"{name} IN (" + ", ".join(f"'{p}'" for p in patterns) + ")"
        elif kind == "contains":
            hit = " OR ".join(f"contains({name}, '{p}')" for p in patterns)
        else:
            hit = " OR ".join(f"regexp_matches({name}, '{p}')" for p in patterns)
        out.append(f"WHEN {hit} THEN '{value}'")
    default = "default_keep_core" if field == "rule_id" else "core"
    return f"CASE {' '.join(out)} ELSE '{default}' END"


@query("str_14_rule_classification", f"""SELECT p_partkey, name, rule_id, bucket, CASE rule_id WHEN 'default_keep_core' THEN 'keep_core' ELSE 'hide_from_default_ui' END AS decision
FROM (SELECT *, {sql_concept_rule('name', 'rule_id')} AS rule_id, {sql_concept_rule('name', 'bucket')} AS bucket FROM named_parts)""")
def str_14(spark, d):
    return named_parts(spark, d).select("p_partkey", "name", T.concept_rule(col("name")).alias("rule")).select("p_partkey", "name", "rule.*")


INDUSTRY_WORDS = ("工业金属", "半导体", "银行", "证券", "食品饮料/消费", "汽车", "综合", "NATION", "环保", "种植业")


@query("str_15_industry_tags", "SELECT c_custkey, tag FROM (SELECT c_custkey, unnest(["
       + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{tag}' END" for tag, words in spec.INDUSTRY_TAGS)
       + "]) AS tag FROM (SELECT c_custkey, c_mktsegment || '/' || CASE c_custkey % 10 "
       + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(INDUSTRY_WORDS)) + " END AS t FROM customer)) WHERE tag IS NOT NULL")
def str_15(spark, d):
    word = F.element_at(F.array(*[F.lit(w) for w in INDUSTRY_WORDS]), (col("c_custkey") % 10 + 1).cast("int"))
    tags = T.keyword_tags(F.concat_ws("/", "c_mktsegment", word))
    return S.table(spark, d, "customer").select("c_custkey", F.explode(tags).alias("tag"))


def sql_tier(q):
    return (f"CASE WHEN symbol = '{q}' THEN 0 WHEN starts_with(symbol, '{q}') THEN 1 WHEN name_initials = '{q}' THEN 2 "
            f"WHEN starts_with(name_initials, '{q}') THEN 3 WHEN lower(stock_name) = '{q}' THEN 4 WHEN contains(lower(stock_name), '{q}') THEN 5 END")


@query("str_16_match_tier", f"SELECT market, symbol, {sql_tier('00001')} AS by_prefix, {sql_tier('s0007')} AS by_initials, {sql_tier('supplier#000000003')} AS by_name FROM securities")
def str_16(spark, d):
    tier = lambda q: T.match_tier(col("symbol"), col("stock_name"), col("name_initials"), F.lit(q))
    return S.securities(spark, d).select(
        "market", "symbol", tier("00001").alias("by_prefix"), tier(" S0007").alias("by_initials"), tier("Supplier#000000003").alias("by_name"))


@query("str_17_class_label", """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'A类 正常盈利' WHEN 1 THEN 'B类 微盈利畸高' WHEN 2 THEN 'C类 亏损经营'
WHEN 3 THEN 'D类 高风险例外' WHEN 4 THEN 'D类 高风险例外' ELSE 'OTHER' END AS label FROM customer""")
def str_17(spark, d):
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (col("c_custkey") % 6 + 1).cast("int"))
    c = pick("A_NORMAL_EARNING", "B_THIN_PROFIT_DISTORTED", "C_LOSS", "C_LOSS", "C_LOSS", "OTHER")
    s = pick(None, None, "C1_REVENUE_LOSS", "c4", "C3_NO_REVENUE_CONCEPT", None)
    return S.table(spark, d, "customer").select("c_custkey", T.class_label(c, s).alias("label"))


# ---- dates and periods ----------------------------------------------------------------------------
def order_days(spark, d):
    return S.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


ORDER_INT = "CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER)"
add_view("order_periods", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, year(o_orderdate) || CASE quarter(o_orderdate) WHEN 4 THEN 'A' ELSE 'Q' || quarter(o_orderdate) END AS period FROM orders")


def order_periods(spark, d):
    return order_days(spark, d).select("o_orderkey", P.period_label(F.year("day"), F.quarter("day")).alias("period"))


@query("dt_01_period_of_date", """SELECT o_orderkey, y || CASE WHEN m IN (3, 6, 9) THEN 'Q' || (m // 3) WHEN m = 12 OR (m - 1) // 3 = 0 THEN 'A' ELSE 'Q' || ((m - 1) // 3) END AS period,
CASE strftime(o_orderdate, '%m%d') WHEN '0331' THEN y || 'Q1' WHEN '0630' THEN y || 'Q2' WHEN '0930' THEN y || 'Q3' WHEN '1231' THEN y || 'A' ELSE strftime(o_orderdate, '%Y%m%d') END AS strict_period
FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y, month(o_orderdate) AS m FROM orders)""")
def dt_01(spark, d):
    text = F.date_format("day", "yyyyMMdd")
    return order_days(spark, d).select(
        "o_orderkey", P.period_from_yyyymmdd(text.cast("int")).alias("period"), P.strict_period_label(text).alias("strict_period"))


@query("dt_02_period_end", """SELECT o_orderkey, period, CAST(y * 10000 + CASE q WHEN 1 THEN 331 WHEN 2 THEN 630 WHEN 3 THEN 930 ELSE 1231 END AS INTEGER) AS report_date,
strftime(last_day(make_date(y, q * 3, 1)), '%Y-%m-%d') AS trading_day FROM order_periods""")
def dt_02(spark, d):
    p = col("period")
    return order_periods(spark, d).select(
        "o_orderkey", "period", P.period_end_yyyymmdd(p).alias("report_date"), P.day_text(P.period_end_day(p)).alias("trading_day"))


@query("dt_03_period_order", "SELECT period, y * 10 + q AS period_ord, y * 4 + q - 1 AS period_idx, count(*) AS n FROM order_periods GROUP BY ALL")
def dt_03(spark, d):
    p = col("period")
    return order_periods(spark, d).groupBy("period", P.period_ord(p).alias("period_ord"), P.period_idx(p).alias("period_idx")).agg(F.count(F.lit(1)).alias("n"))


def _idx_label(i):
    return f"(({i}) // 4) || CASE ({i}) % 4 WHEN 3 THEN 'A' ELSE 'Q' || (({i}) % 4 + 1) END"


@query("dt_04_three_previous", "SELECT o_orderkey, period, " + ", ".join(f"{_idx_label(f'y * 4 + q - 1 - {k}')} AS previous_{k}" for k in (1, 2, 3)) + " FROM order_periods")
def dt_04(spark, d):
    return order_periods(spark, d).select(
        "o_orderkey", "period", *[P.period_from_idx(P.period_idx(col("period")) - k).alias(f"previous_{k}") for k in (1, 2, 3)])


@query("dt_05_same_period_last_year", f"SELECT o_orderkey, {_idx_label('y * 4 + q - 5')} AS period, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) - 10000 AS report_date FROM order_periods JOIN orders USING (o_orderkey)")
def dt_05(spark, d):
    days = order_days(spark, d)
    return days.select(
        "o_orderkey", P.period_from_idx(P.period_idx(P.period_label(F.year("day"), F.quarter("day"))) - 4).alias("period"),
        P.previous_year_date(F.date_format("day", "yyyyMMdd").cast("int")).alias("report_date"))


@query("dt_06_announce_date", f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 1) THEN 0 ELSE {ORDER_INT} END AS announce_date FROM orders")
def dt_06(spark, d):
    short = F.date_format("day", "yyMMdd").cast("double").cast("string")
    raw = F.when(col("o_orderkey") % 9 == 0, "0").when(col("o_orderkey") % 9 == 1, "NaN").otherwise(short)
    return order_days(spark, d).select("o_orderkey", P.announce_date(raw).alias("announce_date"))


@query("dt_07_year_to_date_days", """SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS trading_day FROM orders
WHERE year(o_orderdate) = (SELECT year(max(o_orderdate)) FROM orders) ORDER BY 1 DESC""")
def dt_07(spark, d):
    days = order_days(spark, d).select("day").distinct()
    anchor = S.table(spark, d, "orders").agg(F.to_date(F.max("o_orderdate"))).scalar()
    return days.where(P.year_to_date(col("day"), anchor)).select(P.day_text(col("day")).alias("trading_day")).orderBy(col("trading_day").desc())


@query("dt_08_normalize_day", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS trading_day FROM orders""")
def dt_08(spark, d):
    k = col("o_orderkey") % 3
    day_field = F.when(k == 0, F.date_format("day", " yyyy-MM-dd")).when(k == 1, F.date_format("day", "yyyyMMdd"))
    stamp = F.when(k == 2, F.date_format("day", "yyyy-MM-dd HH:mm:ss"))
    return order_days(spark, d).select("o_orderkey", F.coalesce(P.strict_day(day_field), P.strict_day(F.substring(stamp, 1, 10))).alias("trading_day"))


@query("dt_09_data_cutoff", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS trading_day, strftime(o_orderdate, '%Y-%m-%d') || ' 15:00:00' AS data_cutoff_time FROM orders")
def dt_09(spark, d):
    days = order_days(spark, d).select("day").distinct()
    return days.select(P.day_text(col("day")).alias("trading_day"), P.cutoff_text(col("day")).alias("data_cutoff_time"))


# ---- numbers --------------------------------------------------------------------------------------
@query("mth_01_tolerant_cast", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 2 THEN CAST(user_id AS DOUBLE) END AS as_float,
CASE event_id % 4 WHEN 2 THEN user_id END AS as_int FROM events""")
def mth_01(spark, d):
    k = col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit(" "), col("value").cast("string"))).when(k == 1, col("event_type")).when(k == 2, col("user_id").cast("string")).otherwise("nan")
    return S.table(spark, d, "events").select("event_id", N.to_float(raw).alias("as_float"), N.to_int(raw).alias("as_int"))


@query("mth_02_to_bool", "SELECT event_id, event_id % 6 IN (0, 1, 3, 4) AS flag FROM events")
def mth_02(spark, d):
    words = F.array(*[F.lit(x) for x in ("TRUE", " yes ", "no", "命中", "2.5", "0")])
    return S.table(spark, d, "events").select("event_id", N.to_bool(F.element_at(words, (col("event_id") % 6 + 1).cast("int"))).alias("flag"))


@query("mth_03_first_non_null", "SELECT event_id, CASE WHEN value > 50 THEN value WHEN user_id % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE -1.0::DOUBLE END AS first_value FROM events")
def mth_03(spark, d):
    a, b = F.when(col("value") > 50, col("value")), F.when(col("user_id") % 2 == 0, col("user_id").cast("double"))
    return S.table(spark, d, "events").select("event_id", F.coalesce(a, b, F.lit(-1.0)).alias("first_value"))


@query("mth_04_first_present", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS metric FROM customer")
def mth_04(spark, d):
    a = F.when(col("c_custkey") % 2 == 0, col("c_name")).otherwise(F.when(col("c_custkey") % 3 == 0, ""))
    return S.table(spark, d, "customer").select("c_custkey", N.first_present(a, col("c_mktsegment")).alias("metric"))


@query("mth_05_percent_to_ratio", "SELECT event_id, CASE WHEN abs(value) > 1 THEN value / 100.0::DOUBLE ELSE value END AS ratio FROM events")
def mth_05(spark, d):
    return S.table(spark, d, "events").select("event_id", N.percent_to_ratio(col("value")).alias("ratio"))


@query("mth_06_market_cap", "SELECT market, symbol, period, revenue / 1e8 AS revenue_yi, bvps * total_shares / 1e8 AS cap_yi FROM statements")
def mth_06(spark, d):
    return S.statements(spark, d).select(
        "market", "symbol", "period", N.to_yi(col("revenue")).alias("revenue_yi"), N.market_cap_yi(col("bvps"), col("total_shares")).alias("cap_yi"))


@query("mth_07_ratio", "SELECT event_id, value / nullif(user_id % 5, 0) AS ps_ttm FROM events")
def mth_07(spark, d):
    return S.table(spark, d, "events").select("event_id", N.ratio(col("value"), (col("user_id") % 5).cast("double")).alias("ps_ttm"))


@query("mth_08_return_pct", f"""SELECT market, symbol, strftime(trading_day, '%Y-%m-%d') AS trading_day, {sql_round('(close / nullif(lag(close, 5) OVER s, 0) - 1.0) * 100.0', 4)} AS return_5_pct,
(close - lag(close, 5) OVER s) / nullif(lag(close, 5) OVER s, 0) * 100.0 AS raw_5_pct FROM bars WINDOW s AS (PARTITION BY market, symbol ORDER BY trading_day)""")
def mth_08(spark, d):
    from marketloom.operators import rolling as L

    return day_text(S.bars(spark, d).select(
        "market", "symbol", "trading_day", L.session_return(5).alias("return_5_pct"),
        N.rolling_return_pct(col("close"), L.lagged("close", 5)).alias("raw_5_pct")))


@query("mth_09_yoy", "SELECT market, symbol, period, revenue_growth, profit_growth, ex_profit_growth FROM statements")
def mth_09(spark, d):
    return S.statements(spark, d).select("market", "symbol", "period", "revenue_growth", "profit_growth", "ex_profit_growth")


@query("mth_10_gross_margin", """SELECT market, symbol, period, coalesce(CASE WHEN abs(g) > 1 THEN g / 100.0::DOUBLE ELSE g END, (revenue - op_cost) / nullif(revenue, 0)) AS gross_margin
FROM (SELECT *, CASE WHEN period_idx % 2 = 0 THEN gross_margin_pct END AS g FROM statements)""")
def mth_10(spark, d):
    field = F.when(col("period_idx") % 2 == 0, col("gross_margin_pct"))
    return S.statements(spark, d).select("market", "symbol", "period", N.gross_margin(field, col("revenue"), col("op_cost")).alias("gross_margin"))


@query("mth_11_ttm_eps", """SELECT market, symbol, period, CASE q WHEN 4 THEN eps WHEN 1 THEN eps * 4.0::DOUBLE WHEN 2 THEN eps * 2.0::DOUBLE ELSE eps * 4.0::DOUBLE / 3.0::DOUBLE END AS annualized_eps,
CASE WHEN q = 4 THEN eps WHEN annual IS NOT NULL AND same IS NOT NULL THEN eps + annual - same
WHEN q = 1 THEN eps * 4.0::DOUBLE WHEN q = 2 THEN eps * 2.0::DOUBLE ELSE eps * 4.0::DOUBLE / 3.0::DOUBLE END AS ttm_eps
FROM (SELECT c.*, c.period_ord % 10 AS q, a.eps AS annual, s.eps AS same FROM statements c
LEFT JOIN statements a ON a.market = c.market AND a.symbol = c.symbol AND a.period_ord = (c.period_ord // 10 - 1) * 10 + 4
LEFT JOIN statements s ON s.market = c.market AND s.symbol = c.symbol AND s.period_idx = c.period_idx - 4)""")
def mth_11(spark, d):
    from marketloom.plans import statements as X

    rows = X.with_neighbours(S.statements(spark, d), ["eps"])
    q = P.period_quarter(col("period"))
    return rows.select(
        "market", "symbol", "period", N.annualized_eps(q, col("eps")).alias("annualized_eps"),
        N.ttm_eps(q, col("eps"), col("eps_prev_annual"), col("eps_prev_same")).alias("ttm_eps"))


@query("mth_12_clamp_heat", "SELECT event_id, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, coalesce(CASE WHEN user_id % 7 <> 0 THEN value - 20 END, 0.0::DOUBLE))) AS heat FROM events")
def mth_12(spark, d):
    return S.table(spark, d, "events").select("event_id", N.clamp_heat(F.when(col("user_id") % 7 != 0, col("value") - 20)).alias("heat"))


@query("mth_13_rounding", f"SELECT event_id, {sql_round('value / 7.0::DOUBLE', 2)} AS two, {sql_round('value / 7.0::DOUBLE', 4)} AS four FROM events")
def mth_13(spark, d):
    v = col("value") / 7.0
    return S.table(spark, d, "events").select("event_id", N.rounded(v, 2).alias("two"), N.rounded(v, 4).alias("four"))


def sql_band(v, bands):
    whens = " ".join(f"WHEN {v} < {u} THEN '{label}'" for u, label in bands if u is not None)
    return f"CASE WHEN {v} IS NULL THEN NULL {whens} ELSE '{bands[-1][1]}' END"


@query("mth_14_band_labels", f"SELECT event_id, {sql_band('v', spec.PERCENTILE_BANDS)} AS band, {sql_band('v', spec.TEMPERATURE_BANDS)} AS temperature FROM (SELECT event_id, CASE WHEN user_id % 9 <> 0 THEN value END AS v FROM events)")
def mth_14(spark, d):
    v = F.when(col("user_id") % 9 != 0, col("value"))
    return S.table(spark, d, "events").select("event_id", N.percentile_band(v).alias("band"), N.temperature_label(v).alias("temperature"))


@query("mth_15_trend", """SELECT market, symbol, period,
CASE WHEN debt_ratio IS NULL OR p IS NULL THEN 'unknown' WHEN debt_ratio > p THEN 'cautious' ELSE 'positive' END AS debt_trend,
CASE WHEN revenue_growth IS NULL THEN 'unknown' WHEN revenue_growth = 0 THEN 'flat' WHEN revenue_growth > 0 THEN 'positive' ELSE 'cautious' END AS revenue_direction
FROM (SELECT *, lag(debt_ratio) OVER (PARTITION BY market, symbol ORDER BY period_idx) AS p FROM statements)""")
def mth_15(spark, d):
    from pyspark.sql import Window as W

    p = F.lag("debt_ratio").over(W.partitionBy("market", "symbol").orderBy("period_idx"))
    rows = S.statements(spark, d).withColumn("p", p)
    return rows.select(
        "market", "symbol", "period", N.trend(col("debt_ratio"), col("p"), F.lit(True)).alias("debt_trend"),
        N.yoy_direction(col("revenue_growth"), F.lit(False)).alias("revenue_direction"))


# ---- arrays, maps, JSON ---------------------------------------------------------------------------
@query("arr_01_explode_members", "SELECT p_partkey, p_retailprice, unnest(['brand', 'type']) AS field, unnest([p_brand, p_type]) AS value FROM part")
def arr_01(spark, d):
    member = lambda k, c: F.struct(F.lit(k).alias("field"), col(c).alias("value"))
    rows = S.table(spark, d, "part").select("p_partkey", "p_retailprice", F.array(member("brand", "p_brand"), member("type", "p_type")).alias("members"))
    return C.explode_members(rows, "members", ["p_partkey", "p_retailprice"])


@query("arr_02_map_lookup", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS value FROM part")
def arr_02(spark, d):
    scores = F.create_map(F.lit("k0"), col("p_brand"), F.lit("k1"), col("p_type"))
    wanted = F.concat(F.lit("k"), (col("p_partkey") % 3).cast("string"))
    return S.table(spark, d, "part").select("p_partkey", F.try_element_at(scores, wanted).alias("value"))


@query("arr_03_set_overlap", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'small', 'ring'])) > 0 AS hit FROM part")
def arr_03(spark, d):
    wanted = F.array(*[F.lit(x) for x in ("red", "small", "ring")])
    return S.table(spark, d, "part").select("p_partkey", F.arrays_overlap(F.split("p_name", " "), wanted).alias("hit"))


@query("arr_04_drop_null_entries", "SELECT market, symbol, period, key, value FROM (UNPIVOT (SELECT market, symbol, period, net_margin, roe_pct, revenue_growth FROM statements) ON net_margin, roe_pct, revenue_growth INTO NAME key VALUE value) WHERE value IS NOT NULL")
def arr_04(spark, d):
    raw = F.create_map(*[x for k in ("net_margin", "roe_pct", "revenue_growth") for x in (F.lit(k), col(k))])
    kept = F.map_filter(raw, lambda k, v: v.isNotNull())
    return S.statements(spark, d).select("market", "symbol", "period", F.explode(kept).alias("key", "value"))


@query("arr_05_position", RANKED_PARTS.format("length(name)", "n_chars"))
def arr_05(spark, d):
    names = S.table(spark, d, "documents").select("doc_id", F.posexplode(T.split_concepts(col("text"))).alias("pos", "name"))
    return names.select("doc_id", (col("pos") + 1).cast("bigint").alias("concept_rank"), F.length("name").cast("bigint").alias("n_chars"))


@query("arr_06_first_ten_members", """SELECT market, symbol, concept_name, row_number() OVER (PARTITION BY market, symbol ORDER BY concept_name) AS position
FROM concepts QUALIFY position <= 10""")
def arr_06(spark, d):
    return C.first_members(S.concepts(spark, d), 10)


@query("arr_07_json_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS packed FROM events")
def arr_07(spark, d):
    parsed = F.from_json("props", "k bigint")
    return S.table(spark, d, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("packed"))


@query("arr_08_rounded_fold", f"{INDEX_FOLD} SELECT industry_level_2_code, industry_level_2_name, {DAY}, open, high, low, close, volume FROM index_bars")
def arr_08(spark, d):
    from marketloom.plans import industry as I

    return day_text(I.synthetic_index(I.heat_cells(S.industry(spark, d), S.bars(spark, d))))
