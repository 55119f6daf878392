"""Rows on which every rule is true and false at least once, and plans that read only what they need."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.plans import momentum as M
from marketloom.plans import profile as R
from marketloom.plans import quality as Q
from marketloom.plans import screener as X
from marketloom.plans import valuation as V
from marketloom.sources import tables as S

STRONG = {"rps_250": 90.0, "rps_120": 92.0, "rps_50": 95.0, "rps_20": 99.0, "ref1_rps_20": 98.0, "ref2_rps_20": 97.0, "ref3_rps_20": 90.0, "ref3_rps_50": 90.0, "ref5_rps_50": 88.0,
          "close": 20.0, "ma_20": 18.0, "ma_50": 16.0, "ma_50_ago5": 15.0, "ma_50_ago3": 15.0, "ma_120": 12.0, "volume": 200.0, "volume_ma_5": 100.0}
CHANGES = [{}, {"rps_250": 10.0}, {"rps_20": 94.0}, {"ref3_rps_20": 99.5}, {"ref1_rps_20": 99.5}, {"ma_20": 21.0}, {"ma_50": 25.0}, {"volume": 90.0}, {"rps_120": 50.0}, {"ref3_rps_50": None}, {"volume_ma_5": None}]


@pytest.mark.parametrize("strategy", list(M.CONDITIONS))
def test_every_signal_condition_is_met_and_missed(spark, strategy):
    names = list(STRONG)
    rows = [("2024-01-02", "sh", f"{i:06d}", *[{**STRONG, **change}[n] for n in names]) for i, change in enumerate(CHANGES)]
    frame = spark.createDataFrame(rows, "trading_day string, market string, symbol string, " + ", ".join(f"{n} double" for n in names))
    flags = M.signal_rows(frame, strategy, candidates_only=False).collect()
    for condition in M.CONDITIONS[strategy][1]():
        assert {r[condition] for r in flags} == {True, False}, condition
    assert {r["passed"] for r in flags} == {True, False}


def test_every_tail_session_condition_is_met_and_missed(spark):
    good = {"price": 10.4, "last_close": 10.0, "open": 10.1, "low": 10.2, "volume": 7_000.0, "amount": 7_000.0 * 100 * 10.2, "avg_volume_last_5": 4_000.0, "recent_limit_up": True,
            "total_market_cap": 1.5, "free_float_market_cap": 1.0, "points_pass": None}
    changes = [{}, {"price": 10.9}, {"recent_limit_up": False}, {"avg_volume_last_5": 6_900.0}, {"total_market_cap": 900.0}, {"free_float_market_cap": 90.0}, {"points_pass": False}, {"low": 5.0},
               {"open": 10.5}, {"last_close": None}]
    names = list(good)
    kinds = {"recent_limit_up": "boolean", "points_pass": "boolean"}
    rows = [("sh", f"{i:06d}", *[{**good, **change}[n] for n in names]) for i, change in enumerate(changes)]
    frame = spark.createDataFrame(rows, "market string, symbol string, " + ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
    flags = X.tail_session_flags(frame)
    for name in X.SWITCHES:
        assert {r[0] for r in flags.select("ok_" + name).collect()} == {True, False}, name
    matches = X.tail_session_matches(flags)
    assert [r["symbol"] for r in matches.collect()] == ["000000"]
    names_ = spark.createDataFrame([("sh", "000000", "Name")], "market string, symbol string, stock_name string")
    industry = spark.createDataFrame([("sh", "000000", "L1", "L2")], "market string, symbol string, industry_level_1_name string, industry_level_2_name string")
    score = spark.createDataFrame([("sh", "000000", "", None, 71.5, 3, 40)], "market string, symbol string, industry_level_1_name string, industry_level_2_name string, ind_total_score double, industry_total_rank long, industry_total_universe_size long")
    shown = X.tail_session_view(matches, names_, industry, score).collect()
    assert [tuple(r)[2:12] for r in shown] == [("Name", 10.4, 4.0, 1.75, 1.5, 7.28, "L1", "L2", 71.5, 3)]


def test_every_valuation_class_occurs(spark):
    columns = "symbol string, ttm_net_profit double, pe_ttm double, ps_ttm double, book_value_per_share double, ttm_revenue double, gross_margin double, revenue_yoy double, listed_days long, industry_level_2_name string, is_suspended boolean"
    rows = [("a", 5.0, 20.0, 2.0, 3.0, 50.0, 0.3, 0.1, 500, "x", False), ("b", 0.1, 900.0, 4.0, 3.0, 50.0, 0.3, 0.1, 500, "x", False), ("c1", -1.0, None, 4.0, 3.0, 50.0, 0.05, 0.1, 500, "x", False),
            ("c2", -1.0, None, 4.0, 3.0, 50.0, 0.3, 0.5, 500, "x", False), ("c3", -1.0, None, 4.0, 3.0, 0.001, 0.3, 0.5, 500, "x", False), ("c4", -1.0, None, 4.0, -3.0, 50.0, 0.3, 0.5, 500, "x", False),
            ("new", 5.0, 20.0, 2.0, 3.0, 50.0, 0.3, 0.1, 10, "x", False), ("stop", 5.0, 20.0, 2.0, 3.0, 50.0, 0.3, 0.1, 500, "x", True)]
    frame = spark.createDataFrame(rows, columns)
    got = {r["symbol"]: (r["classification"], r["sub_classification"]) for r in V.classify(frame, F.lit(50.0)).collect()}
    assert {k: got[k] for k in ("a", "b", "c1", "c2", "c3", "c4")} == {
        "a": ("A_NORMAL_EARNING", None), "b": ("B_THIN_PROFIT_DISTORTED", None), "c1": ("C_LOSS", "C1_REVENUE_LOSS"), "c2": ("C_LOSS", "C2_GROWTH_LOSS"),
        "c3": ("C_LOSS", "C3_NO_REVENUE_CONCEPT"), "c4": ("C_LOSS", "C4_LIQUIDATION_RISK")}
    reasons = {r["symbol"]: r["reason"] for r in frame.select("symbol", V.rejection().alias("reason")).collect()}
    assert set(reasons.values()) == {None, "loss", "invalid_book_value", "new_listing", "suspended"}


def test_every_trading_status_occurs(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("sh", "a", day(n)) for n in range(1, 6)] + [("sh", "b", day(1)), ("sh", "b", day(4)), ("sh", "c", day(2))]
    got = {(r["symbol"], r["trading_day"].day): (r["trading_status"], r["suspension_days"], r["last_trading_date"] and r["last_trading_date"].day, r["eligible_for_intraday"])
           for r in Q.with_status(spark.createDataFrame(rows, "market string, symbol string, trading_day date"), max_suspension=1).collect()}
    assert got["a", 1] == ("trading", 0, None, True) and got["a", 5] == ("trading", 0, 4, True)
    assert got["b", 4] == ("resumed", 2, 1, False) and got["b", 5] == ("suspended", 1, 4, False)
    assert got["c", 5] == ("suspended", 3, 2, False) and len(got) == len(rows) + 2


def test_basic_info_with_and_without_a_quote(spark):
    day = lambda n: dt.date(2024, 1, n)
    bars = spark.createDataFrame([("sh", s, day(n), 9.0, 11.0, 8.0, 10.0 + n, 100, 1000.0) for s in ("q", "b") for n in (1, 2)],
                                 "market string, symbol string, trading_day date, open double, high double, low double, close double, volume long, amount double")
    statements = spark.createDataFrame([("sh", "q", "2023A", 20234, 20234 * 4, 0.5, 1e9, 6e8)], "market string, symbol string, period string, period_ord int, period_idx int, eps double, total_shares double, free_float_shares double")
    quotes = spark.createDataFrame([("sh", "q", 15.0, 12.0, 300)], "market string, symbol string, price double, last_close double, volume long")
    got = {r["symbol"]: (r["current_price"], r["change_pct"], r["volume_ratio"]) for r in R.basic_info(bars, statements, quotes).collect()}
    assert got["q"] == (15.0, 25.0, 3.0)
    assert got["b"][0] == 12.0 and got["b"][1] == pytest.approx(100.0 / 11) and got["b"][2] == 1.0


def test_newest_day_of_ticks_reaches_the_scan(spark, sf):
    from marketloom.catalog import screeners

    rows = screeners.today_points(spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan
    newest = S.ticks(spark, sf).agg(F.max("trading_day")).first()[0]
    assert {r[0] for r in rows.select("trading_day").distinct().collect()} == {newest}


def test_tail_session_switches_are_all_named():
    assert set(X.SWITCHES) == set(spec.TAIL_SESSION_NAMES)
