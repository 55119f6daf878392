"""Ranks and percentiles, including the way for groups without a size bound."""

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ranking as R


def percentile(spark, value, sample):
    probe = spark.createDataFrame([("g", value)], "g string, v double")
    rows = spark.createDataFrame([("g", float(x)) for x in sample], "g string, s double")
    got = {bound: R.sample_percentiles(probe, rows, ["g"], "v", "s", "p", max_group_rows=bound).collect()[0]["p"] for bound in (100, None)}
    assert got[100] == got[None]
    return got[100]


@pytest.mark.parametrize("value, sample, expected", [
    (8.0, (8, 12, 18, 26, 44), 20.0), (18.0, (8, 12, 18, 26, 44), 60.0), (44.0, (8, 12, 18, 26, 44), 100.0),
    (10.0, (10, 10, 20, 30), 37.5), (20.0, (10, 10, 20, 30), 75.0),
    (24.0, (12, 18, 24, 36), 75.0), (20.0, (12, 18, 24, 36), 75.0), (99.0, (12, 18, 24, 36), 100.0),
    (5.0, (7,), 100.0), (5.0, (), None), (None, (1, 2), None),
])
def test_empirical_percentile(spark, value, sample, expected):
    assert percentile(spark, value, sample) == expected


def skewed(spark):
    """One group holds nearly everything and one value most of it."""
    return spark.range(20000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("g"),
        F.when(F.col("id") % 3 != 0, 0.0).when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 7919 % 1000) / 10.0).alias("v"),
        F.lpad(F.col("id").cast("string"), 6, "0").alias("symbol"))


def test_range_rank_equals_window_rank(spark):
    df = skewed(spark)
    order = [F.col("v").desc_nulls_last(), F.col("symbol").asc()]
    by_window = R.ordinal_rank(df, ["g"], order, "rk", max_group_rows=20000)
    by_range = R.ordinal_rank(df, ["g"], order, "rk", max_group_rows=None)
    assert by_window.exceptAll(by_range).isEmpty() and by_range.exceptAll(by_window).isEmpty()


def test_range_rank_spreads_the_hot_group(spark):
    order = [F.col("v").desc_nulls_last(), F.col("symbol").asc()]
    keys = [F.col("g").asc_nulls_first(), *order]
    sizes = skewed(spark).repartitionByRange(8, *keys).groupBy(F.spark_partition_id()).count().agg(F.max("count")).collect()[0][0]
    assert sizes < 20000 * 0.3


def test_range_rank_without_group(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    out = R.ordinal_rank_by_range(df, [], [F.col("v").asc()], "rk")
    assert out.where(F.col("rk") != F.col("v") + 1).isEmpty()


def scores(spark, rows, **kw):
    df = spark.createDataFrame(
        [(k, hb, zp, "sh", s, v) for k, hb, zp, s, v in rows], "sub_key string, higher_better boolean, zero_penalty boolean, market string, symbol string, raw double")
    return {r["symbol"]: r["score"] for r in R.percentile_scores(df, ["sub_key"], max_group_rows=100, **kw).collect()}


def test_scores_with_penalty_and_default(spark):
    got = scores(spark, [("k", True, True, "a", 3.0), ("k", True, True, "b", 1.0), ("k", True, True, "c", 0.0), ("k", True, True, "d", None)])
    assert got == {"a": 100.0, "b": 50.0, "c": 50.0, "d": 50.0}
    got = scores(spark, [("k", True, True, "a", -3.0), ("k", True, True, "b", 0.0)])
    assert got == {"a": 0.0, "b": 0.0}
    got = scores(spark, [("k", True, False, "a", None), ("k", True, False, "b", None)], missing_default=0.0)
    assert got == {"a": 0.0, "b": 0.0}
    got = scores(spark, [("k", False, True, "a", 0.0), ("k", False, True, "b", 5.0), ("k", False, True, "c", 5.0)])
    assert got == {"a": 100.0, "b": 66.6667, "c": 33.3333}


def test_null_returns_rank_last_or_leave(spark):
    df = spark.createDataFrame([("d", "sh", "1", 5.0), ("d", "sh", "2", None), ("d", "sz", "1", 5.0)], "trading_day string, market string, symbol string, return_20_pct double")
    kept = {(r["market"], r["symbol"]): r["rps_20"] for r in R.momentum_ranks(df, (20,), max_group_rows=10).collect()}
    assert kept == {("sh", "1"): 100.0, ("sz", "1"): 66.67, ("sh", "2"): 33.33}
    left = {(r["market"], r["symbol"]): r["rps_20"] for r in R.momentum_ranks(df, (20,), max_group_rows=10, rank_nulls=False).collect()}
    assert left == {("sh", "1"): 100.0, ("sz", "1"): 50.0, ("sh", "2"): None}


def test_unbounded_groups_give_the_same_results(spark):
    df = skewed(spark).select(F.col("g").alias("trading_day"), F.lit("sh").alias("market"), "symbol", F.col("v").alias("return_20_pct"))
    for rank_nulls in (True, False):
        a, b = (R.momentum_ranks(df, (20,), max_group_rows=n, rank_nulls=rank_nulls) for n in (20000, None))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    long = df.select(F.col("trading_day").alias("sub_key"), F.lit(True).alias("higher_better"), F.lit(True).alias("zero_penalty"), "market", "symbol", F.col("return_20_pct").alias("raw"))
    a, b = (R.percentile_scores(long, ["sub_key"], max_group_rows=n) for n in (20000, None))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    sample = df.where("return_20_pct > 5").select("trading_day", F.col("return_20_pct").alias("s"))
    a, b = (R.sample_percentiles(df, sample, ["trading_day"], "return_20_pct", "s", "p", max_group_rows=n) for n in (20000, None))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("days", [40, 400])
def test_daily_ranks_in_tasks_of_a_fixed_size(spark, days, monkeypatch):
    """Ten times the days are ten times the partitions, and a partition's rows stay the same, however the session is set."""
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    df = spark.range(days * 50).select((F.col("id") % days).alias("trading_day"), F.lit("sh").alias("market"), F.col("id").cast("string").alias("symbol"), F.rand(1).alias("return_20_pct"))
    out = R.momentum_ranks(df, (20,), max_group_rows=50, rows=days * 50)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == days * 50 and max(sizes) <= 450
