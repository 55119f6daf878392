"""WHS, ARC and DQ queries."""

from pyspark.sql import functions as F

from marketloom import spec
from marketloom.catalog import query
from marketloom.catalog import valuation as cv
from marketloom.catalog.momentum import ATTACK, DAY, SYMBOL_FRAME, day_text, inputs, last_day, rps, sql_ma
from marketloom.catalog.streams import tick_days
from marketloom.catalog.views import add_view
from marketloom.functions import text as T
from marketloom.plans import archive as A
from marketloom.plans import concepts as C
from marketloom.plans import intraday as D
from marketloom.plans import momentum as M
from marketloom.plans import quality as Q
from marketloom.plans import valuation as V
from marketloom.plans import warehouse as H
from marketloom.session import fresh_path, settle
from marketloom.sources import tables as S

col = F.col

# Each period is delivered in its own package; every third code is re-delivered one package later with doubled revenue.
add_view("packages", """SELECT symbol AS code, period, period_ord, report_date, announce_date, revenue, 'gpcw' || report_date AS package FROM statements
  UNION ALL SELECT symbol, period, period_ord, report_date, announce_date + 1, revenue * 2, 'gpcw' || next_date FROM (SELECT *, lead(report_date) OVER (PARTITION BY market, symbol ORDER BY period_ord) AS next_date FROM statements)
  WHERE next_date IS NOT NULL AND CAST(symbol AS BIGINT) % 3 = 0""")
PACKAGE = ("code", "period", "report_date", "announce_date", "revenue")
add_view("delivered", "SELECT *, CAST(right(package, 8) AS BIGINT) AS package_date FROM packages QUALIFY row_number() OVER (PARTITION BY package, code ORDER BY report_date DESC, announce_date DESC) = 1")
add_view("warehouse", "SELECT * FROM delivered QUALIFY row_number() OVER (PARTITION BY code, period ORDER BY announce_date DESC, report_date DESC, package DESC) = 1")
add_view("old_meta", "SELECT code, max(period_ord) AS latest_ord FROM warehouse WHERE period_ord <= 20004 AND NOT (CAST(code AS BIGINT) % 5 = 0 AND period_ord > 20002) GROUP BY 1")
add_view("updates", """SELECT p.* FROM delivered p JOIN old_meta m USING (code) WHERE p.period_ord > m.latest_ord AND m.latest_ord < (package_date // 10000) * 10 + ((package_date // 100) % 100) // 3
  QUALIFY row_number() OVER (PARTITION BY code, period ORDER BY announce_date DESC, report_date DESC, package DESC) = 1""")
add_view("old_warehouse", "SELECT * FROM warehouse WHERE period_ord <= 20004 AND NOT (CAST(code AS BIGINT) % 5 = 0 AND period_ord > 20002)")


def packages(spark, d):
    from pyspark.sql import Window as W

    s = S.statements(spark, d).select("market", col("symbol").alias("code"), "period_ord", "report_date", "announce_date", "revenue")
    nxt = F.lead("report_date").over(W.partitionBy("market", "code").orderBy("period_ord"))
    again = s.withColumn("next_date", nxt).where(col("next_date").isNotNull() & (col("code").cast("bigint") % 3 == 0))
    name = lambda c: F.concat(F.lit("gpcw"), col(c).cast("string")).alias("package")
    first = s.select("code", "report_date", "announce_date", "revenue", name("report_date"))
    # Packages are stored files in practice: settled once, then read by each step.
    return settle(first.unionByName(again.select("code", "report_date", (col("announce_date") + 1).alias("announce_date"), (col("revenue") * 2).alias("revenue"), name("next_date"))))


def old_warehouse(delivered):
    """What was stored at the end of 2000; every fifth code lags two periods behind."""
    from marketloom.functions import periods as P

    w = H.build(delivered)
    o = P.period_ord(col("period"))
    return w.where((o <= 20004) & ~((col("code").cast("bigint") % 5 == 0) & (o > 20002)))


COLS = ", ".join(PACKAGE)


@query("whs_01_full_build", f"SELECT {COLS} FROM warehouse")
def whs_01(spark, d):
    return H.build(packages(spark, d)).select(*PACKAGE)


@query("whs_02_detect_updates", f"SELECT {COLS} FROM updates")
def whs_02(spark, d):
    delivered = packages(spark, d)
    return H.detect_updates(delivered, H.meta(old_warehouse(delivered))).select(*PACKAGE)


@query("whs_03_upsert_periods", f"SELECT {COLS} FROM old_warehouse WHERE (code, period) NOT IN (SELECT (code, period) FROM updates) UNION ALL SELECT {COLS} FROM updates")
def whs_03(spark, d):
    store = H.VersionedPeriods(spark, fresh_path(spark, "statements"))
    delivered = packages(spark, d)
    store.replace(old_warehouse(delivered))
    new = H.detect_updates(delivered, H.meta(store.read()))
    store.upsert(settle(new), ["code", "period"])
    return store.read().select(*PACKAGE)


@query("whs_04_stale_codes", "SELECT code, '2000Q2' AS latest_period FROM old_meta WHERE latest_ord = 20002")
def whs_04(spark, d):
    return H.stale_codes(H.meta(old_warehouse(packages(spark, d))), "2000Q2")


@query("whs_05_inherit_announce", "SELECT code, period, announce_date FROM warehouse")
def whs_05(spark, d):
    """Incoming rows of one market lack their announcement date and inherit the stored one."""
    stored = H.build(packages(spark, d))
    incoming = stored.where(col("code").cast("bigint") % 3 == 1).withColumn("announce_date", F.lit(0))
    return H.upsert(stored, incoming, ["code", "period"], keep_announce=True).select("code", "period", "announce_date")


# ---- archive ------------------------------------------------------------------------------------------
TRADING_DAY = "2001-11-02"


def datasets(spark, d):
    """Datasets of one day; the two placeholder datasets of the required list are not built.

    What several datasets or a rerun read is settled, so that it is worked out once however often it is written."""
    ticks = settle(S.ticks(spark, d))
    ind, con = S.industry(spark, d), settle(S.concepts(spark, d))
    ranks = settle(rps(spark, d))
    keyed = lambda df: df.withColumn("concept_id", T.concept_id(col("concept_name")))
    dictionary = con.groupBy("concept_name").agg(F.min("market").alias("market"), F.min("symbol").alias("symbol"))
    return [
        ("bars_15m", "bars", "stock", D.resample(ticks, 15)),
        ("features_intraday_volume_windows", "features", "stock", D.window_sums(ticks)),
        ("dataset_stock_industry_current", "dataset", "stock", ind),
        ("dataset_stock_rps_current", "dataset", "stock", ranks),
        ("dataset_concept_dictionary", "dataset", "market", keyed(dictionary)),
        ("dataset_stock_concept_current", "dataset", "stock", keyed(con)),
        ("snapshot_stock_industry_membership", "snapshot", "stock", ind),
        ("snapshot_stock_rps_current", "snapshot", "stock", ranks),
        ("snapshot_stock_concept_membership", "snapshot", "stock", con),
    ]


def archived(spark, d):
    """A day archived from the tables; returns its catalog and whether its audit rows were written."""
    root = fresh_path(spark, "archive")
    A.run(spark, A.ArchiveContext(TRADING_DAY, root), datasets(spark, d))
    day = f"{root}/trading_day={TRADING_DAY}"
    return spark.read.parquet(f"{day}/catalog"), A.artifact_exists(spark, f"{day}/audit")


# What a day's archive holds, counted from the tables: a dataset is there if its source has rows or not, a check looks at all of them.
DATASET_SQL = {
    "bars_15m": ("bars", "stock", "SELECT count(*) FROM events"), "features_intraday_volume_windows": ("features", "stock", "SELECT count(*) FROM events"),
    "dataset_stock_industry_current": ("dataset", "stock", "SELECT count(*) FROM industry"), "dataset_stock_rps_current": ("dataset", "stock", "SELECT count(*) FROM rps"),
    "dataset_concept_dictionary": ("dataset", "market", "SELECT count(DISTINCT concept_name) FROM concepts"), "dataset_stock_concept_current": ("dataset", "stock", "SELECT count(*) FROM concepts"),
    "snapshot_stock_industry_membership": ("snapshot", "stock", "SELECT count(*) FROM industry"), "snapshot_stock_rps_current": ("snapshot", "stock", "SELECT count(*) FROM rps"),
    "snapshot_stock_concept_membership": ("snapshot", "stock", "SELECT count(*) FROM concepts")}
add_view("day_datasets", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset_name, '{c}' AS dataset_category, '{s}' AS dataset_scope, ({q}) AS row_count" for n, (c, s, q) in DATASET_SQL.items()))
add_view("wanted_datasets", "SELECT unnest([" + ", ".join(f"'{n}'" for n in sorted(spec.REQUIRED_DATASETS)) + "]) AS dataset_name")
add_view("missing_datasets", "SELECT string_agg(dataset_name, ', ' ORDER BY dataset_name) AS missing, count(*) AS n FROM (SELECT dataset_name FROM wanted_datasets EXCEPT SELECT dataset_name FROM day_datasets)")
add_view("day_checks", """SELECT name AS check_name, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS status, CASE WHEN NOT ok AND name = 'dataset_presence_check' THEN 'missing datasets: ' || missing END AS details FROM (
  SELECT unnest([{'name': 'final_data_status_check', 'ok': true}, {'name': 'dataset_presence_check', 'ok': m.n = 0}, {'name': 'version_presence_check', 'ok': true},
    {'name': 'archive_partition_check', 'ok': d.datasets > 0}, {'name': 'row_count_sanity_check', 'ok': d.least >= 0}, {'name': 'timestamp_consistency_check', 'ok': d.datasets > 0},
    {'name': 'artifact_existence_check', 'ok': d.datasets > 0}, {'name': 'snapshot_presence_check', 'ok': d.snapshots > 0}, {'name': 'audit_log_presence_check', 'ok': d.datasets > 0}], recursive := true), missing
  FROM missing_datasets m, (SELECT count(*) AS datasets, min(row_count) AS least, count(*) FILTER (dataset_category = 'snapshot') AS snapshots FROM day_datasets) d)""")
add_view("day_facts", """SELECT (SELECT count(*) FROM day_datasets) AS dataset_count, (SELECT bool_and(status = 'passed') FROM day_checks) AS ok,
  (SELECT bool_or(dataset_category = 'snapshot' AND dataset_scope = 'market') FROM day_datasets) AS market, (SELECT bool_or(dataset_category = 'snapshot' AND dataset_scope = 'stock') FROM day_datasets) AS stock""")
RUN_ID = f"'archive_{TRADING_DAY.replace('-', '')}_' || lpad(CAST(r AS VARCHAR), 2, '0')"
RUN_SQL = f"""SELECT '{TRADING_DAY}' AS trading_day, r AS archive_revision, {RUN_ID} AS run_id, 'success' AS archive_status, dataset_count, ok AS validation_passed,
NULL::VARCHAR AS failed_stage, NULL::VARCHAR AS error FROM day_facts, (SELECT unnest(range(1, {{0}})) AS r)"""


@query("arc_01_daily_archive", RUN_SQL.format(2))
def arc_01(spark, d):
    ctx = A.ArchiveContext(TRADING_DAY, fresh_path(spark, "archive"))
    return A.run(spark, ctx, datasets(spark, d))


@query("arc_02_dataset_checks", "SELECT * FROM day_checks")
def arc_02(spark, d):
    catalog, audited = archived(spark, d)
    return A.validations(catalog, trading_day=TRADING_DAY, cutoff=f"{TRADING_DAY} 15:00:00", audit_present=audited)


@query("arc_03_manifest", f"""SELECT '{TRADING_DAY}' AS trading_day, r AS archive_revision, dataset_count, CASE WHEN market THEN 'available' ELSE 'not_enabled' END AS market_snapshot,
CASE WHEN stock THEN 'available' ELSE 'not_enabled' END AS stock_snapshot, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS validation_status, {RUN_ID} AS run_id, r > 1 AS is_rerun,
CASE WHEN r > 1 THEN r - 1 END AS rerun_of, CASE WHEN r > 1 THEN 'late statements' END AS rerun_reason FROM day_facts, (SELECT unnest(range(1, 3)) AS r)""")
def arc_03(spark, d):
    """Second revision of a day that has one."""
    catalog, audited = archived(spark, d)
    checks = A.validations(catalog, trading_day=TRADING_DAY, cutoff=f"{TRADING_DAY} 15:00:00", audit_present=audited)
    none = catalog.limit(0).select(F.lit(TRADING_DAY).alias("trading_day"), F.lit(0).cast("bigint").alias("archive_revision"))
    first = settle(A.next_manifest(none, catalog, checks, TRADING_DAY))
    return first.unionByName(A.next_manifest(first, catalog, checks, TRADING_DAY, "late statements"))


@query("arc_04_run_record", RUN_SQL.format(3))
def arc_04(spark, d):
    """A first run and a forced rerun of the same day."""
    root = fresh_path(spark, "archive")
    some = datasets(spark, d)
    A.run(spark, A.ArchiveContext(TRADING_DAY, root), some)
    return A.run(spark, A.ArchiveContext(TRADING_DAY, root, force_rerun=True, rerun_reason="check"), some)


@query("arc_05_update_status", """SELECT count(*) AS industry_count, sum(member_valuation_row_count)::BIGINT AS member_valuation_row_count, count(*) FILTER (is_complete) AS complete_industry_count, (SELECT arg_max(period, period_ord) FROM statements) AS latest_period,
(SELECT CAST(max(announce_date) AS BIGINT) FROM statements) AS financial_updated, (SELECT strftime(max(trading_day), '%Y-%m-%d') FROM bars) AS valuation_updated, (SELECT strftime(max(trading_day), '%Y-%m-%d') FROM rps) AS rps_updated, (SELECT max(ts) FROM events) AS quotes_updated FROM val_complete""")
def arc_05(spark, d):
    rows = cv.classified(spark, d)
    newest = {"valuation_updated": S.table(spark, d, "lineitem").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd")).scalar(),
              "rps_updated": rps(spark, d).agg(F.date_format(F.max("trading_day"), "yyyy-MM-dd")).scalar(), "quotes_updated": S.table(spark, d, "events").agg(F.max("ts")).scalar()}
    return A.update_status(S.statements(spark, d), V.completeness(rows, V.percentile_samples(rows)), newest)


# ---- data quality -------------------------------------------------------------------------------------------
add_view("bar_sessions", "SELECT *, dense_rank() OVER (ORDER BY trading_day) AS session FROM bars")
add_view("bar_gaps", f"""SELECT market, symbol, trading_day, volume, coalesce(session - lag(session) OVER s - 1, 0) AS suspension_days, lag(trading_day) OVER s AS last_trading_date, false AS absent FROM bar_sessions {SYMBOL_FRAME}
  UNION ALL SELECT market, symbol, (SELECT max(trading_day) FROM bars), NULL, (SELECT max(session) FROM bar_sessions) - max(session), max(trading_day), true FROM bar_sessions GROUP BY 1, 2 HAVING max(trading_day) < (SELECT max(trading_day) FROM bars)""")
QUALITY = "CASE WHEN volume IS NULL OR volume % 13 = 0 THEN 'invalid' WHEN volume % 7 = 0 THEN 'low' WHEN symbol LIKE '%3' THEN 'medium' ELSE 'high' END"
COMPARE = "CASE WHEN volume % 3 = 0 THEN 'converted' WHEN volume % 3 = 1 THEN 'comparable' ELSE 'not_comparable' END"


@query("dq_01_quality_grades", f"""SELECT market, symbol, {DAY}, strftime(last_trading_date, '%Y-%m-%d') AS last_trading_date, suspension_days, CASE WHEN absent THEN 'suspended' WHEN suspension_days > 0 THEN 'resumed' ELSE 'trading' END AS trading_status,
NOT absent AND suspension_days <= 20 AS eligible_for_intraday, quality AS data_quality, compare AS comparability_status,
CASE WHEN quality = 'invalid' OR (quality = 'low' AND compare = 'not_comparable') THEN 'invalid' WHEN compare = 'not_comparable' THEN 'restricted' WHEN quality = 'low' OR suspension_days > 0 THEN 'observable' ELSE 'executable' END AS permission
FROM (SELECT *, {QUALITY} AS quality, {COMPARE} AS compare FROM bar_gaps)""")
def dq_01(spark, d):
    """Holes stand where the volume falls on certain remainders; they make every grade occur."""
    v = col("volume")
    rows = Q.with_status(S.bars(spark, d).select("market", "symbol", "trading_day", "close", "volume"))
    rows = rows.withColumn("p", F.when(v % 13 != 0, col("close"))).withColumn("q", F.when(v % 7 != 0, v)).withColumn("a", F.when(~col("symbol").endswith("3"), col("symbol")))
    mode = F.when(v % 3 == 0, "raw").when(v % 3 == 1, "qfq").otherwise("mixed_forbidden")
    rows = rows.withColumn("data_quality", Q.data_quality(["p"], ["q"], ["a"])).withColumn("comparability_status", Q.comparability(mode, F.lit("qfq")))
    rows = rows.withColumn("permission", Q.signal_permission(col("data_quality"), col("trading_status"), col("comparability_status")))
    return day_text(rows).select("market", "symbol", "trading_day", F.date_format("last_trading_date", "yyyy-MM-dd").alias("last_trading_date"), "suspension_days", "trading_status", "eligible_for_intraday", "data_quality", "comparability_status", "permission")


@query("dq_02_backfill", f"""SELECT market, symbol, {DAY}, CASE WHEN volume % 5 = 0 AND volume % 4 = 0 AND volume % 3 = 0 THEN NULL ELSE close END AS close, volume, CASE WHEN volume % 3 <> 0 THEN 'local' WHEN volume % 4 <> 0 THEN 'api' ELSE 'public' END AS fill_source,
CASE WHEN volume % 3 <> 0 THEN CASE WHEN volume % 11 = 0 AND (volume % 4 <> 0 OR volume % 5 <> 0) THEN 'partial' WHEN volume % 11 = 0 THEN 'lost' ELSE 'original' END ELSE 'backfilled' END AS fill_status FROM bars WHERE NOT (volume % 3 <> 0 AND volume % 11 = 0 AND volume % 4 = 0 AND volume % 5 = 0)""")
def dq_02(spark, d):
    """The local source misses some rows and some closes, the interface misses others, the public source has closes
    missing too."""
    v = col("volume")
    bars = S.bars(spark, d).select("market", "symbol", "trading_day", "close", "volume").where(~((v % 3 != 0) & (v % 11 == 0) & (v % 4 == 0) & (v % 5 == 0)))
    local = bars.where(v % 3 != 0).withColumn("close", F.when(v % 11 != 0, col("close")))
    api = bars.where(v % 4 != 0)
    public = bars.withColumn("close", F.when(v % 5 != 0, col("close")))
    return day_text(Q.backfill([("local", local), ("api", api), ("public", public)], ["close", "volume"]))


ALIGN_MA = ", ".join(sql_ma(*m) for m in (("close", 20, 0, "ma_20"), ("close", 50, 0, "ma_50"), ("volume", 5, 0, "volume_ma_5")))
add_view("alignment", f"""SELECT *, weekly_bias = 'bullish' AND daily_structure = 'setup_ready' AND intraday_trigger = 'triggered' AS good FROM (SELECT market, symbol, trading_day,
  CASE WHEN weekly > 1 THEN 'bullish' WHEN weekly < -1 THEN 'bearish' ELSE 'neutral' END AS weekly_bias, CASE WHEN close > ma_20 AND ma_20 > ma_50 THEN 'setup_ready' WHEN close > ma_20 THEN 'setup_pending' ELSE 'setup_invalid' END AS daily_structure,
  CASE WHEN close > open AND volume > 1.2::DOUBLE * volume_ma_5 THEN 'triggered' WHEN close > open THEN 'waiting' ELSE 'failed' END AS intraday_trigger
  FROM (SELECT *, (close / nullif(lag(close, 5) OVER s, 0) - 1.0) * 100.0 AS weekly, {ALIGN_MA} FROM bars {SYMBOL_FRAME}))""")


@query("dq_03_timeframe_alignment", f"""SELECT market, symbol, {DAY}, weekly_bias, daily_structure, intraday_trigger, CASE WHEN good THEN 'aligned' WHEN (weekly_bias = 'bearish' AND intraday_trigger = 'triggered') OR (daily_structure = 'setup_invalid' AND weekly_bias = 'bullish') THEN 'conflicted' ELSE 'mixed' END AS timeframe_alignment,
CASE WHEN good THEN 'priority_execution' WHEN weekly_bias = 'bearish' THEN 'counter_trend' WHEN daily_structure <> 'setup_ready' THEN 'watching' WHEN intraday_trigger <> 'triggered' THEN 'awaiting_trigger' ELSE 'trial' END AS execution_note FROM alignment""")
def dq_03(spark, d):
    return day_text(Q.alignment(S.bars(spark, d)))


PASSED = " + ".join(f"CASE WHEN coalesce({c}, false) THEN 1 ELSE 0 END" for c in ATTACK.values())
add_view("graded", f"SELECT trading_day, market, symbol, CASE WHEN n = 5 THEN 'S' WHEN n = 4 THEN 'A' WHEN n * 2 >= 5 THEN 'B' ELSE 'C' END AS signal_grade, volume % 4 = 0 AS veto FROM (SELECT *, {PASSED} AS n FROM signal_inputs)")


@query("dq_04_execution_grade", f"""SELECT {DAY}, market, symbol, signal_grade, action_grade, CASE action_grade WHEN 'core' THEN 100.0::DOUBLE WHEN 'standard' THEN 100.0::DOUBLE WHEN 'probe' THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS position_cap_pct
FROM (SELECT *, CASE signal_grade WHEN 'S' THEN CASE WHEN veto THEN 'standard' ELSE 'core' END WHEN 'A' THEN CASE WHEN veto THEN 'probe' ELSE 'standard' END WHEN 'B' THEN CASE WHEN veto THEN 'observe' ELSE 'probe' END ELSE CASE WHEN veto THEN 'avoid' ELSE 'observe' END END AS action_grade FROM graded)""")
def dq_04(spark, d):
    rows = inputs(spark, d)
    flags = list(M.attack_conditions().values())
    passed = sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))
    out = Q.execution_grade(rows, passed, len(flags), col("volume") % 4 == 0)
    return day_text(out).select("trading_day", "market", "symbol", "signal_grade", "action_grade", "position_cap_pct")
