"""Small literal cases per operator family, against values worked out by hand or by plain Python."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.functions import periods as P
from marketloom.functions import text as T
from marketloom.operators import filters as X
from marketloom.operators import rolling as L
from marketloom.plans import concepts as C
from marketloom.plans import industry as I
from marketloom.plans import momentum as M
from marketloom.plans import screener as SC
from marketloom.plans import valuation as V
from marketloom.plans import warehouse as H
from marketloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


# ---- reference data ---------------------------------------------------------------------------------
def test_concept_lines(spark):
    lines = spark.createDataFrame([("0|000001|9| 跨境支付CIPS , 不可减持(新规),跨境支付CIPS |1",), ("1|600000|9||1",), ("short|line",)], "line string")
    rows = C.concept_rows(lines).orderBy("concept_rank_in_stock").collect()
    assert [(r["market"], r["concept_name"], r["concept_rank_in_stock"]) for r in rows] == [("sz", "跨境支付CIPS", 1), ("sz", "不可减持(新规)", 2)]
    assert rows[0]["concept_id"] == hashlib.sha1("tdx_local:跨境支付CIPS".encode()).hexdigest()
    assert (rows[0]["bucket"], rows[0]["decision"]) == ("core", "keep_core")
    assert rows[1]["bucket"] == "shareholder"


@pytest.mark.parametrize("name, rule, bucket", [
    ("KDJ超卖", "drop_technical", "technical"), ("不可减持(新规)", "drop_holding_unlock", "shareholder"), ("20260326 涨停", "drop_date_prefix", "timestamped"),
    ("无", "drop_empty", "empty"), ("A<-B", "drop_historical_alias", "alias"), ("煤炭、铝的生产、销售", "drop_business_description_fragment", "description"),
    ("同比-12.5%", "drop_financial_numeric_fragment", "financial"), ("占总股本 3.5%", "drop_shareholder_ratio_fragment", "shareholder"), ("有色金属", "default_keep_core", "core"),
])
def test_concept_rules(spark, name, rule, bucket):
    got = one(spark, T.concept_rule(F.lit(name)))
    assert (got["rule_id"], got["bucket"]) == (rule, bucket)


def test_industry_lines(spark):
    codes = spark.createDataFrame([(i, x) for i, x in enumerate(["家电|X24|0|0|0|X24", "白色家电|1|0|0|0|X2401", "旧名|1|0|0|0|X240101", "空调|1|0|0|0|X240101", "坏行|1"])], "line_no long, line string")
    names = C.industry_code_map(codes)
    rows = C.industry_rows(spark.createDataFrame([("0|000651|T10|||X240101",), ("1|600000|T1|||T999",)], "line string"), names).collect()
    assert len(rows) == 1
    assert (rows[0]["level_1_name"], rows[0]["level_2_name"], rows[0]["level_3_name"]) == ("家电", "白色家电", "空调")


def test_fixed_width_master(spark):
    def record(symbol, name, initials):
        body = bytearray(spec.MASTER_RECORD)
        body[0:len(symbol)] = symbol.encode()
        raw = name.encode("gbk")
        body[31:31 + len(raw)] = raw
        body[329:329 + len(initials)] = initials.encode()
        return bytes(body)

    payload = bytes(50) + record("600001", "测试股份", "CSGF") + record("60x001", "坏代码", "HDM") + record("600002", "", "") + b"short"
    rows = files.decode_master(spark.createDataFrame([("sh", bytearray(payload))], "market string, content binary")).collect()
    assert [tuple(r) for r in rows] == [("sh", "600001", "测试股份", "csgf")]


def test_text_decoding(spark):
    raw = [("utf-8", "行业".encode()), ("gbk", "行业分类".encode("gbk")), ("broken", b"\xff\xfe\xfa")]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in raw], "k string, b binary")
    got = {r["k"]: r["t"] for r in df.select("k", files.decode_text("b").alias("t")).collect()}
    assert got["utf-8"] == "行业" and got["gbk"] == "行业分类" and got["broken"] is not None


def test_eligibility(spark):
    check = lambda s, n: one(spark, T.is_a_share_eligible(F.lit(s), F.lit(n)))
    assert check("600001", "平安") and check("920001", "北交")
    assert not any([check("600001", "*ST平安"), check("600001", "S 平安"), check("600001", "S"), check("999999", "指数"), check("399001", "指数"), check("60001", "短")])


# ---- periods and numbers -------------------------------------------------------------------------------
@pytest.mark.parametrize("date, period", [(20250331, "2025Q1"), (20250630, "2025Q2"), (20250930, "2025Q3"), (20251231, "2025A"), (20250115, "2025A"), (20250815, "2025Q2"), (20251130, "2025Q3")])
def test_period_of_date(spark, date, period):
    assert one(spark, P.period_from_yyyymmdd(F.lit(date))) == period


@pytest.mark.parametrize("raw, expected", [("260422.0", 20260422), ("991231", 19991231), ("0", 0), ("NaN", 0), ("x", 0), (None, 0)])
def test_announce_date(spark, raw, expected):
    assert one(spark, P.announce_date(F.lit(raw).cast("string"))) == expected


def test_previous_periods(spark):
    back = lambda p, k: one(spark, P.period_from_idx(P.period_idx(F.lit(p)) - k))
    assert [back("2025Q1", k) for k in (1, 2, 3)] == ["2024A", "2024Q3", "2024Q2"]
    assert [back("2025A", k) for k in (1, 2, 3)] == ["2025Q3", "2025Q2", "2025Q1"]


@pytest.mark.parametrize("value, digits", [(2.675, 2), (0.125, 2), (1.005, 2), (-3.14159, 4), (7.0, 2), (66.66666666, 4)])
def test_rounding_is_close_to_half_even(spark, value, digits):
    assert abs(one(spark, N.rounded(F.lit(value), digits)) - round(value, digits)) <= 10**-digits * 1.0001


def test_bool_words(spark):
    words = ["1", "TRUE", " yes ", "命中", "2.5", "0", "no", "", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r["b"] for r in df.select(N.to_bool(F.col("w")).alias("b")).collect()] == [True, True, True, True, True, False, False, False, False]


# ---- bars --------------------------------------------------------------------------------------------------
def bars(spark, closes, market="sh", symbol="600001", volumes=None, start=dt.date(2024, 1, 1)):
    rows = [(market, symbol, start + dt.timedelta(days=i), float(c), float(c), float(c), float(c), int((volumes or [100] * len(closes))[i]), float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "market string, symbol string, trading_day date, open double, high double, low double, close double, volume bigint, amount double")


def test_moving_average_needs_a_full_frame_without_nulls(spark):
    df = bars(spark, [1, 2, 3, 4, 5, 6]).withColumn("close", F.when(F.col("close") != 3, F.col("close")))
    out = L.with_moving_averages(df, [("close", 2, 0, "m"), ("close", 2, 1, "m_ago")]).orderBy("trading_day").collect()
    assert [r["m"] for r in out] == [None, 1.5, None, None, 4.5, 5.5]
    assert [r["m_ago"] for r in out] == [None, None, 1.5, None, None, 4.5]


def test_self_percentile(spark):
    df = bars(spark, [5, 1, 3, 2, 4]).withColumn("v", F.col("close"))
    out = L.with_self_percentiles(df, {"v": "full"}, 3, partial={"v": "part"}).orderBy("trading_day").collect()
    assert [r["full"] for r in out] == [None, None, 33.33, 33.33, 66.67]
    assert [r["part"] for r in out] == [0.0, 0.0, 33.33, 33.33, 66.67]


def test_self_percentile_counts_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(-3, 4, 9000).astype(float)
    values[rng.random(9000) < 0.2] = np.nan
    below, here = L.below_counts(values, 120)
    frames = [values[max(0, i - 119):i + 1] for i in range(9000)]
    assert below.tolist() == [int((f < f[-1]).sum()) for f in frames]
    assert here.tolist() == [int((~np.isnan(f)).sum()) for f in frames]
    assert L.below_counts(values[:1], 120)[1].tolist() == [int(not np.isnan(values[0]))]


def test_heat_cells(spark):
    a, b, c = bars(spark, [100, 101, 104.03]), bars(spark, [100, 103, 108.15], symbol="600002"), bars(spark, [100, 98, 98], symbol="600003")
    ind = spark.createDataFrame([("sh", "600001", "I1", "一"), ("sh", "600002", "I1", "一"), ("sh", "600003", "I2", "二")], "market string, symbol string, industry_level_2_code string, industry_level_2_name string")
    rows = I.heat_cells(ind, a.union(b).union(c)).orderBy("industry_level_2_code", "trading_day").collect()
    got = [(r["industry_level_2_code"], r["pct_change"], r["stock_count"]) for r in rows]
    assert got == [("I1", None, 0), ("I1", 2.0, 2), ("I1", 4.0, 2), ("I2", None, 0), ("I2", -2.0, 1), ("I2", 0.0, 1)]


def test_synthetic_index_rounds_every_step(spark):
    changes = [0.0, 1.23456, -0.98765, 2.5]
    cells = spark.createDataFrame([("I", "n", dt.date(2024, 1, 1) + dt.timedelta(days=i), p, 2, 0.0) for i, p in enumerate(changes)],
                                  "industry_level_2_code string, industry_level_2_name string, trading_day date, pct_change double, stock_count bigint, daily_volume double")
    level, want = 100.0, []
    for p in changes:
        level = round(level * (1 + p / 100), 4)
        want.append(level)
    rows = I.synthetic_index(cells).orderBy("trading_day").collect()
    assert [r["close"] for r in rows] == want
    assert [r["open"] for r in rows] == [100.0, *want[:-1]]
    assert rows[3]["volume"] == round(2.5 * 2 * 1000)


def test_launch_and_attack_conditions(spark):
    row = dict(rps_20=96.0, rps_50=93.0, rps_120=92.0, rps_250=90.0, ref1_rps_20=94.0, ref2_rps_20=92.0, ref3_rps_20=90.0, ref3_rps_50=90.0, ref5_rps_50=88.0,
               close=20.0, ma_20=18.0, ma_50=16.0, ma_120=14.0, ma_50_ago5=15.5, ma_50_ago3=15.8, volume=200.0, volume_ma_5=120.0)
    df = spark.createDataFrame([row])
    for build in (M.launch_conditions, M.attack_conditions):
        assert all(df.select(*[c.alias(n) for n, c in build().items()]).collect()[0])
    weak = spark.createDataFrame([{**row, "volume": 130.0, "rps_250": 70.0}])
    got = weak.select(*[c.alias(n) for n, c in M.launch_conditions().items()]).collect()[0].asDict()
    assert got == {"rps_base": False, "rps_structure": True, "rps_turning_point": True, "trend_confirmed": True, "volume_start": False}


# ---- valuation ----------------------------------------------------------------------------------------------
MEMBER = "industry_level_2_name string, symbol string, total_market_cap double, free_float_market_cap double, ttm_net_profit double, ttm_revenue double, book_value_per_share double, listed_days long, is_suspended boolean"


def test_snapshot_falls_back_to_free_float(spark):
    rows = [("白酒", str(i), None, 10.0 * (i + 1), 1.0 * (i + 1), 5.0 * (i + 1), 1.0, 100, False) for i in range(10)]
    snap = V.industry_snapshot(spark.createDataFrame(rows, MEMBER), ["industry_level_2_name"]).collect()[0]
    assert (snap["weighted_pe_ttm"], snap["weighted_ps_ttm"], snap["pe_invalid_threshold"], snap["sample_status"]) == (10.0, 2.0, 50.0, "ok")


def test_snapshot_counts_the_first_reason_only(spark):
    rows = [("x", "a", 1.0, 1.0, -1.0, 1.0, -1.0, 10, True), ("x", "b", 1.0, 1.0, -1.0, 1.0, -1.0, 10, False), ("x", "c", 1.0, 1.0, -1.0, 1.0, -1.0, 100, False),
            ("x", "d", 1.0, 1.0, None, 1.0, 1.0, None, False), ("x", "e", 900.0, 1.0, 1.0, 1.0, 1.0, 100, False)]
    s = V.industry_snapshot(spark.createDataFrame(rows, MEMBER), ["industry_level_2_name"]).collect()[0]
    assert [s[k] for k in ("suspended_filtered_count", "new_listing_filtered_count", "invalid_book_value_count", "loss_count", "valid_member_count")] == [1, 1, 1, 1, 1]
    assert (s["pe_invalid_threshold"], s["sample_status"]) == (200.0, "insufficient")


def test_classes(spark):
    schema = "k string, ttm_net_profit double, pe_ttm double, ps_ttm double, ttm_revenue double, revenue_yoy double, gross_margin double, book_value_per_share double, listed_days long"
    rows = [("a", 1.0, 20.0, 2.0, 5.0, 0.1, 0.2, 1.0, 100), ("b", 1.0, 80.0, 2.0, 5.0, 0.1, 0.2, 1.0, 30), ("c1", -1.0, None, 2.0, 5.0, 0.1, 0.2, 1.0, 100),
            ("c2", -1.0, None, 2.0, 5.0, 0.2, 0.1, 1.0, 100), ("c3", -1.0, None, 2.0, 0.005, 0.9, 0.9, 1.0, 100), ("c3yuan", -1.0, None, 2.0, 999999.0, 0.9, 0.9, 1.0, 100), ("c4", None, None, 2.0, 0.005, 0.9, 0.9, 0.0, 100)]
    out = V.classify(spark.createDataFrame(rows, schema), F.lit(50.0)).collect()
    got = {r["k"]: (r["classification"][:1], (r["sub_classification"] or "--")[:2], r["primary_metric"], r["is_new_listing"]) for r in out}
    assert got == {"a": ("A", "--", "pe_ttm", False), "b": ("B", "--", "ps_ttm", True), "c1": ("C", "C1", "ps_ttm", False), "c2": ("C", "C2", "ps_ttm", False),
                   "c3": ("C", "C3", None, False), "c3yuan": ("C", "C3", None, False), "c4": ("C", "C4", None, False)}


# ---- screeners --------------------------------------------------------------------------------------------------
def test_screener_filters(spark):
    rows = spark.createDataFrame([("sh", "600001", 88.0, 1, "电子", 35.0, 95.0, 8.0), ("sz", "000002", 70.0, 2, "电子", 35.0, 60.0, 8.0), ("sz", "000003", 90.0, 3, None, None, 99.0, None)],
                                 "market string, symbol string, market_total_score double, market_total_rank long, industry_level_1 string, primary_percentile double, rps_20 double, growth double")
    params = {"min_total_score": "80", "industry_level_1": "电子", "min_primary_percentile": "20", "max_primary_percentile": "50", "min_rps_20": "90", "min_dim_growth": "1", "min_rps_99": "100", "junk": "x"}
    out = SC.stock_screener(rows, params).collect()
    assert [(r["symbol"], r["total"], r["page"], r["total_pages"]) for r in out] == [("600001", 1, 1, 1)]


def test_unset_filters_leave_the_plan_alone(spark):
    df = spark.range(3).withColumn("t", F.lit("a"))
    assert X.keyword(df, "t", " ") is df and X.bounded(df, "id") is df


def test_deep_pages_use_the_distributed_rank(spark, monkeypatch):
    monkeypatch.setattr(X, "DEEP_PAGE_ROWS", 10)
    rows = X.page(spark.range(1000), [F.col("id").desc()], number_wanted=4, size=50).collect()
    assert sorted(r["id"] for r in rows) == list(range(800, 850)) and rows[0]["total_pages"] == 20


def test_tail_session_conditions(spark):
    schema = "market string, symbol string, price double, last_close double, open double, low double, volume double, amount double, recent_limit_up boolean, avg_volume_last_5 double, total_market_cap double, free_float_market_cap double, points_pass boolean"
    rows = [("sh", "600001", 10.4, 10.0, 10.1, 10.0, 180000.0, 1.8e8, True, 100000.0, 60.0, 30.0, True), ("sz", "000001", 10.6, 10.0, 10.1, 10.0, 180000.0, 1.8e8, True, 100000.0, 60.0, 30.0, None)]
    flags = SC.tail_session_flags(spark.createDataFrame(rows, schema))
    hit = SC.tail_session_matches(flags).collect()
    assert [(r["symbol"], r["gain_pct"], r["volume_ratio"]) for r in hit] == [("600001", 4.0, 1.8)]
    assert hit[0]["matched_conditions"].startswith("涨幅|涨停基因")
    relaxed = SC.tail_session_matches(flags, {"gain_pct": False, "intraday_above_vwap": False})
    assert relaxed.count() == 2 and "涨幅" not in relaxed.collect()[0]["matched_conditions"]


# ---- warehouse ------------------------------------------------------------------------------------------------------
def test_clean_package_keeps_newest_and_first_title(spark):
    df = spark.createDataFrame([("sh:600001", 20240331, 1.0, 9.0), ("600001", 20240630, 2.0, 9.0), ("SZ:1", 20240630, 3.0, 9.0)], "code string, report_date int, revenue double, `revenue.1` double")
    got = {(r["code"], r["report_date"], r["revenue"]) for r in H.clean_package(df).collect()}
    assert got == {("600001", 20240630, 2.0), ("000001", 20240630, 3.0)}


def test_upsert_inherits_announcement(spark):
    cols = "code string, period string, announce_date int, revenue double"
    old = spark.createDataFrame([("1", "2024A", 20250101, 1.0), ("2", "2024A", 20250102, 2.0)], cols)
    new = spark.createDataFrame([("1", "2024A", 0, 5.0), ("3", "2024A", 0, 6.0)], cols)
    got = {tuple(r) for r in H.upsert(old, new, ["code", "period"], keep_announce=True).select("code", "period", "announce_date", "revenue").collect()}
    assert got == {("2", "2024A", 20250102, 2.0), ("1", "2024A", 20250101, 5.0), ("3", "2024A", 0, 6.0)}


def test_json_envelopes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"market":"sh","symbol":"1"}]')
    (tmp_path / "b.json").write_text('{"items":[{"market":"sz","symbol":"2"},{"market":"sz","symbol":"3"}]}')
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("market", StringType()), StructField("symbol", StringType())])
    got = {tuple(r) for r in files.read_json_rows(spark, f"{tmp_path}/*.json", schema).collect()}
    assert got == {("sh", "1"), ("sz", "2"), ("sz", "3")}
