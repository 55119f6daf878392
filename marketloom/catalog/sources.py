"""SRC queries. Files a reader needs are first written from the given tables into a fresh work folder."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog.functions import sql_concept_rule
from marketloom.catalog.momentum import DAY, RPS_COLUMNS, day_text, rps
from marketloom.catalog.views import add_view
from marketloom.functions import periods as P
from marketloom.functions import text as X
from marketloom.operators import rolling as L
from marketloom.plans import intraday as D
from marketloom.plans import statements as Q
from marketloom.plans import warehouse as H
from marketloom.session import fresh_path
from marketloom.sources import files as R
from marketloom.sources import tables as S

col = F.col
CHUNK = 1000  # securities per derived file


@query("src_01_json_rows", "SELECT market, symbol, stock_name, name_initials FROM securities")
def src_01(spark, d):
    """Securities as envelope files of at most 1,000 records each, read back."""
    path = fresh_path(spark, "json")
    s = S.table(spark, d, "supplier").select("s_suppkey", S.market_of(col("s_suppkey")).alias("market"), S.symbol_of(col("s_suppkey")).alias("symbol"))
    rows = s.join(S.securities(spark, d), ["market", "symbol"]).withColumn("chunk", F.floor(col("s_suppkey") / CHUNK))
    record = F.struct("market", "symbol", "stock_name", "name_initials")
    envelope = F.when(col("chunk") % 2 == 0, F.to_json(F.struct(F.collect_list(record).alias("rows")))).otherwise(F.to_json(F.collect_list(record)))
    rows.groupBy("chunk").agg(envelope.alias("value")).write.partitionBy("chunk").text(path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("market", "symbol", "stock_name", "name_initials")])
    return R.read_json_rows(spark, f"{path}/*/*", schema)


STATEMENT_COLUMNS = ("market", "symbol", "period", "report_date", "announce_date", "revenue", "net_profit", "equity")
STATEMENT_SQL = "SELECT " + ", ".join(STATEMENT_COLUMNS) + " FROM statements"


def coded(spark, d):
    return S.statements(spark, d).select(*STATEMENT_COLUMNS).withColumn("code", col("symbol"))


def stored_warehouse(spark, d):
    path = fresh_path(spark, "warehouse")
    H.write_periods(coded(spark, d), path)
    return path


@query("src_02_read_period", STATEMENT_SQL + " WHERE period = '2000Q3'")
def src_02(spark, d):
    return R.read_periods(spark, stored_warehouse(spark, d), "2000Q3").select(*STATEMENT_COLUMNS)


@query("src_03_point_lookup", "SELECT s_suppkey, period, revenue FROM supplier JOIN statements ON symbol = CASE WHEN s_suppkey < 100000 THEN lpad(CAST(s_suppkey AS VARCHAR), 6, '0') ELSE CAST(s_suppkey AS VARCHAR) END WHERE period = '2000A'")
def src_03(spark, d):
    """Codes that lost their leading zeros still meet their statement rows."""
    asked = S.table(spark, d, "supplier").select("s_suppkey", X.canonical_code(col("s_suppkey").cast("string")).alias("symbol"))
    return asked.join(S.statements(spark, d).where(col("period") == "2000A"), "symbol").select("s_suppkey", "period", "revenue")


@query("src_04_write_periods", STATEMENT_SQL)
def src_04(spark, d):
    return spark.read.parquet(stored_warehouse(spark, d)).select(*STATEMENT_COLUMNS)


@F.pandas_udf(T.BinaryType())
def _encode(text, use_gbk):
    import pandas as pd

    def one(t, gbk):
        try:
            return t.encode("gbk") if gbk else t.encode("utf-8")
        except UnicodeEncodeError:
            return t.encode("utf-8")

    return pd.Series([one(t, g) for t, g in zip(text, use_gbk)])


@query("src_05_decode_text", "SELECT doc_id, text FROM documents")
def src_05(spark, d):
    raw = S.table(spark, d, "documents").select("doc_id", _encode(col("text"), col("doc_id") % 2 == 1).alias("content"))
    return raw.select("doc_id", R.decode_text(col("content")).alias("text"))


@query("src_06_fixed_width_master", "SELECT market, symbol, stock_name, name_initials FROM securities WHERE length(symbol) = 6")
def src_06(spark, d):
    pad = lambda c, n: F.rpad(c, n, "\0")
    gap = lambda n: F.lit("\0" * n)
    s = S.table(spark, d, "supplier").select("s_suppkey", S.market_of(col("s_suppkey")).alias("market"), S.symbol_of(col("s_suppkey")).alias("symbol"))
    rows = s.join(S.securities(spark, d), ["market", "symbol"]).where(F.length("symbol") == 6)  # the format has no room for longer codes
    record = F.concat("symbol", gap(25), pad(col("stock_name"), 18), gap(280), pad(col("name_initials"), 12), gap(19))
    files = rows.groupBy("market", F.floor(col("s_suppkey") / CHUNK)).agg(
        F.encode(F.concat(gap(50), F.array_join(F.collect_list(record), "")), "US-ASCII").alias("content"))
    return R.decode_master(files)


@query("src_07_daily_tail", f"SELECT market, symbol, {DAY}, open, high, low, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY market, symbol ORDER BY trading_day DESC) <= 250")
def src_07(spark, d):
    return day_text(L.tail(S.bars(spark, d), 250).select("market", "symbol", "trading_day", "open", "high", "low", "close", "volume"))


@query("src_08_minute_day", "SELECT event_id, symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, price, volume FROM ticks WHERE trading_day = DATE '2024-01-15'")
def src_08(spark, d):
    rows = S.ticks(spark, d).where(col("trading_day") == F.lit("2024-01-15").cast("date"))
    return rows.select("event_id", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "price", "volume")


@query("src_09_list_packages", "SELECT CAST(report_date AS VARCHAR) AS package_date, count(*) AS row_count FROM statements GROUP BY 1")
def src_09(spark, d):
    path = fresh_path(spark, "packages")
    rows = coded(spark, d).withColumn("package", F.concat(F.lit("gpcw"), col("report_date").cast("string")))
    rows.write.partitionBy("package").parquet(path)
    found = R.with_package_date(spark.read.parquet(path))
    return found.groupBy("package_date").agg(F.count(F.lit(1)).alias("row_count")).orderBy(col("package_date").desc())


@query("src_10_clean_package", "SELECT symbol AS code, report_date, revenue FROM newest_statement")
def src_10(spark, d):
    raw = coded(spark, d).select(
        F.concat(F.lit("sh:"), F.regexp_replace("code", "^0+", "")).alias("code"), "report_date", "revenue", (col("revenue") * 2).alias("revenue.1"))
    raw = raw.where(col("code") != "sh:").unionByName(coded(spark, d).where(~col("code").rlike("[1-9]")).select("code", "report_date", "revenue", (col("revenue") * 2).alias("revenue.1")))
    return H.clean_package(raw)


TITLES = {"lrb": ("revenue", "net_profit"), "zcfz": ("equity",), "llb": ("op_cf",)}


def payloads(spark, d):
    """One JSON payload per code and report; every fifth report lacks its income statement."""
    s = S.statements(spark, d)
    items = lambda names: F.array(*[F.struct(F.lit(n).alias("item_title"), col(n).alias("item_value")) for n in names])
    tables = F.struct(F.when(col("period_idx") % 5 != 0, items(TITLES["lrb"])).alias("lrb"), items(TITLES["zcfz"]).alias("zcfz"), items(TITLES["llb"]).alias("llb"))
    report = F.struct(col("announce_date").cast("string").alias("publish_date"), tables.alias("tables"))
    return s.select(col("symbol").alias("code"), F.to_json(F.create_map(col("report_date").cast("string"), report)).alias("payload"))


@query("src_11_flatten_reports", "SELECT symbol AS code, period, CASE WHEN period_idx % 5 <> 0 THEN revenue END AS lrb_revenue, CASE WHEN period_idx % 5 <> 0 THEN net_profit END AS lrb_net_profit, equity AS zcfz_equity, op_cf AS llb_op_cf FROM statements")
def src_11(spark, d):
    return R.pivot_reports(R.flatten_reports(payloads(spark, d)), [f"{t}_{n}" for t, names in TITLES.items() for n in names])


@query("src_12_newest_with_income", "SELECT symbol AS code, arg_max(period, period_ord) AS period, 2 AS lrb_items, 1 AS zcfz_items, 1 AS llb_items FROM statements WHERE period_idx % 5 <> 0 GROUP BY 1")
def src_12(spark, d):
    return R.newest_with_income(payloads(spark, d))


@query("src_14_intraday_points", "SELECT event_id, symbol, price, volume, amount_cents / 100.0::DOUBLE AS amount FROM ticks WHERE price IS NOT NULL AND volume <> 0")
def src_14(spark, d):
    return D.usable_points(S.ticks(spark, d)).select("event_id", "symbol", "price", "volume", (col("amount_cents") / 100.0).alias("amount"))


@query("src_15_newest_snapshot", "SELECT market, symbol, revenue, period_ord AS snapshot_period FROM statements WHERE period_ord = (SELECT max(period_ord) FROM statements)")
def src_15(spark, d):
    path = fresh_path(spark, "snapshots")
    rows = S.statements(spark, d).select("market", "symbol", "revenue", col("period_ord").alias("snapshot_period"))
    rows.write.partitionBy("snapshot_period").parquet(path)
    return R.newest_value(spark.read.parquet(path), "snapshot_period")


add_view("industry_dataset", "SELECT market, symbol, industry_level_2_code FROM industry")


@query("src_16_dataset_entry", """SELECT 'dataset_stock_industry_current' AS dataset_name, 'dataset' AS dataset_category, 'stock' AS dataset_scope, 'final' AS data_status, 'trading_day=2001-11-02' AS partition,
count(*) AS row_count, count(DISTINCT (market, symbol)) AS symbol_count, '2001-11-02 15:00:00' AS data_cutoff_time, 'passed' AS validation_status FROM industry_dataset""")
def src_16(spark, d):
    entry = R.write_dataset(
        S.industry(spark, d), fresh_path(spark, "dataset"), dataset="dataset_stock_industry_current", category="dataset", scope="stock",
        trading_day="2001-11-02", cutoff="2001-11-02 15:00:00")
    return entry.drop("path")


@query("src_17_current_and_archive", f"SELECT 'current' AS place, market, symbol, {RPS_COLUMNS} FROM rps UNION ALL SELECT 'archive', market, symbol, {RPS_COLUMNS} FROM rps")
def src_17(spark, d):
    current, archive = fresh_path(spark, "current"), fresh_path(spark, "archive")
    R.write_current_and_archive(rps(spark, d).drop("trading_day"), current, archive, "2001-11-02")
    a = spark.read.parquet(current).withColumn("place", F.lit("current"))
    b = spark.read.parquet(archive).where(col("trading_day") == F.lit("2001-11-02").cast("date")).drop("trading_day").withColumn("place", F.lit("archive"))
    return a.unionByName(b).drop("universe_size")


@query("src_18_result_cache", "SELECT market, symbol, rps_20 FROM rps")
def src_18(spark, d):
    root = fresh_path(spark, "cache")
    key = {"day": "2001-11-02", "limit": "all", "lookback": 40}
    build = lambda: rps(spark, d).select("market", "symbol", "rps_20")
    tables = [f"{d}/lineitem.parquet", f"{d}/supplier.parquet"]
    R.cached_result(spark, root, key, build, tables)
    return R.cached_result(spark, root, key, build, tables)


@query("src_19_rule_config", f"""SELECT r.id, r.priority::INTEGER AS priority, r.bucket, coalesce(h.concepts, 0) AS concepts
FROM (VALUES {', '.join(f"('{i}', {p}, '{b}')" for i, p, b, _, _ in spec.CONCEPT_RULES)}) r(id, priority, bucket)
LEFT JOIN (SELECT {sql_concept_rule('concept_name', 'rule_id')} AS id, count(*) AS concepts FROM (SELECT DISTINCT concept_name FROM labelled_concepts) GROUP BY 1) h USING (id)""")
def src_19(spark, d):
    """Rules read back from a configuration file, with the number of concepts each rule covers."""
    from marketloom.catalog.screeners import labelled

    path = fresh_path(spark, "rules")
    spark.range(1).select(R.rule_config_json().alias("value")).coalesce(1).write.text(path)
    rules = R.read_rules(spark, f"{path}/*.txt").select("id", "priority", "bucket")
    hits = labelled(spark, d).select("concept_name").distinct().select(X.concept_rule(col("concept_name"))["rule_id"].alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("concepts"))
    return rules.join(hits, "id", "left").select("id", "priority", "bucket", F.coalesce("concepts", F.lit(0)).alias("concepts"))


@query("src_20_available_periods", "SELECT DISTINCT period, period_ord, period = '2000A' AS resolved FROM statements ORDER BY period_ord DESC")
def src_20(spark, d):
    """Periods newest first; the request '2000' resolves to the newest period of that year."""
    rows = S.statements(spark, d)
    hit = Q.resolve_period(rows, "2000").select("period").scalar()
    listed = rows.select("period", "period_ord").distinct()
    return listed.select("period", "period_ord", (col("period") == hit).alias("resolved")).orderBy(col("period_ord").desc())
