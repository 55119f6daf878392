"""Skewed ticks, multi-batch streams and the archive's rerun rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators.prefix import running_totals
from marketloom.plans import archive as A
from marketloom.plans import intraday as D
from marketloom.plans import screener as X
from marketloom.session import fresh_path
from marketloom.sources import tables as S
from marketloom.streaming import ticks as T


def test_running_totals_on_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4800, "hot").otherwise("cold").alias("g"), "id", (F.col("id") % 17).alias("x"))
    got = running_totals(df, ["g"], ["id"], {"cum": F.col("x")}).orderBy("id").collect()
    total = {"hot": 0, "cold": 0}
    for row in got:
        total[row["g"]] += row["x"]
        assert row["cum"] == total[row["g"]]


def test_running_totals_when_all_ticks_are_in_one_minute(spark):
    """One symbol, one minute, 16 partitions: the largest range holds a small part."""
    from marketloom.operators.prefix import ranged

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ticks = spark.range(40_000).select(
            F.lit("sh").alias("market"), F.lit("A").alias("symbol"), F.lit("2024-01-02").cast("date").alias("trading_day"),
            F.timestamp_millis(F.lit(1_704_187_860_000) + F.col("id") % 60_000).alias("ts"), F.col("id").alias("event_id"), (F.col("id") % 7 + 10.0).alias("price"),
            F.lit(1).cast("bigint").alias("volume"), ((F.col("id") % 7 + 10) * 10_000).alias("amount_cents"))
        sizes = [r["count"] for r in ranged(ticks, ["symbol", "ts", "event_id"]).groupBy("_range").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 40_000 / 8
        got = [(r["event_id"], r["cum_volume"]) for r in D.cumulative_vwap(ticks).orderBy("ts", "event_id").collect()]
        assert [n for _, n in got] == list(range(1, 40_001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_vwap_state_adds_what_follows_and_drops_ended_days(spark, tmp_path):
    tick = lambda i, day, minute, price: (i, dt.datetime(2024, 1, day, 9, minute), 1, "A", price, '{"k": 2}')
    batches = [[tick(1, 1, 31, 10.0)], [tick(2, 1, 32, 9.0), tick(3, 1, 33, 12.0)], [tick(4, 9, 31, 10.0)], [tick(5, 9, 32, 11.0), tick(6, 1, 50, 99.0)], [tick(7, 9, 30, 50.0)]]
    write_ticks(tmp_path, batches)
    path = fresh_path(spark, "vwap")
    T.drain(T.vwap_state(T.tick_stream(spark, str(tmp_path), "events-*.parquet", files_per_batch=1), path, kept_days=2))
    got = {str(r["trading_day"]): (r["valid_points"], r["above_count"], r["breached"]) for r in T.vwap_result(spark, path).collect()}
    whole = D.vwap_strength(D.cumulative_vwap(T_batch(spark, tmp_path).where("event_id <> 6")))  # tick 6 comes after its day has ended
    assert got == {str(r["trading_day"]): (r["valid_points"], r["above_count"], r["breached"]) for r in whole.collect()}
    days = {r["trading_day"] for r in spark.read.parquet(f"{path}/points").select(F.col("trading_day").cast("string").alias("trading_day")).distinct().collect()}
    states = spark.read.parquet(f"{path}/state")
    assert days == {"2024-01-09"} and {str(r["trading_day"]) for r in states.select("trading_day").collect()} == {"2024-01-09"}


def test_vwap_strength_rejects_a_deep_breach(spark):
    t0 = dt.datetime(2024, 1, 2, 9, 31)
    rows = [("sh", s, t0.date(), t0 + dt.timedelta(minutes=i), i, p, 10, int(round(p * 10 * 100 * 100))) for s, prices in (("up", (10.0, 10.1, 10.2)), ("dip", (10.0, 9.0, 12.0)), ("empty", (10.0,))) for i, p in enumerate(prices)]
    ticks = spark.createDataFrame(rows, "market string, symbol string, trading_day date, ts timestamp, event_id long, price double, volume long, amount_cents long")
    ticks = ticks.withColumn("volume", F.when(F.col("symbol") == "empty", 0).otherwise(F.col("volume")).cast("bigint"))
    got = {r["symbol"]: (r["valid_points"], r["above_count"], r["breached"], r["passes"]) for r in D.vwap_strength(D.cumulative_vwap(ticks)).collect()}
    assert got == {"up": (3, 3, False, True), "dip": (3, 2, True, False)}


@pytest.fixture(scope="module")
def split_events(spark, sf, tmp_path_factory):
    """The event table as four files in time order, one micro-batch each."""
    folder = str(tmp_path_factory.mktemp("events"))
    ev = spark.read.parquet(f"{sf}/events.parquet")
    bounds = [r["ts"] for r in ev.select("ts").orderBy("ts").collect()]
    cuts = [bounds[0], *(bounds[len(bounds) * k // 4] for k in (1, 2, 3)), bounds[-1] + dt.timedelta(seconds=1)]
    import os
    import time

    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf}/events.parquet").to_pandas()
    for k in range(4):
        part = table[(table.ts >= cuts[k]) & (table.ts < cuts[k + 1])]
        path = f"{folder}/events-{k}.parquet"
        import pyarrow as pa

        pq.write_table(pa.Table.from_pandas(part, schema=pq.read_schema(f"{sf}/events.parquet"), preserve_index=False), path)
        os.utime(path, (time.time() - 100 + k, time.time() - 100 + k))
    return folder


def test_vwap_state_across_batches_equals_batch(spark, sf, split_events):
    path = fresh_path(spark, "vwap")
    q = T.vwap_state(T.tick_stream(spark, split_events, "events-*.parquet", files_per_batch=1), path)
    T.drain(q)
    assert spark.read.parquet(f"{path}/cells").select("batch").distinct().count() == 4
    columns = ["symbol", "trading_day", "valid_points", "above_count", "breached", "passes"]
    streamed = T.vwap_result(spark, path).select(*columns)
    batch = D.vwap_strength(D.cumulative_vwap(S.ticks(spark, sf))).select(*columns)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def write_ticks(folder, batches):
    import os
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    for k, rows in enumerate(batches):
        path = f"{folder}/events-{k}.parquet"
        pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema), path)
        os.utime(path, (time.time() - 100 + k, time.time() - 100 + k))


def late_batches():
    """Days 1, 10, then late and out-of-order ticks for both."""
    tick = lambda i, day, minute, price: (i, dt.datetime(2024, 1, day, 9, minute), 1, "A", price, '{"k": 2}')
    return [[tick(1, 1, 31, 10.0), tick(2, 1, 40, 9.0)], [tick(3, 10, 35, 10.0)], [tick(4, 1, 35, 20.0), tick(5, 10, 32, 5.0)], [tick(6, 10, 44, 7.0)]]


def test_late_and_unordered_ticks_equal_the_batch(spark, tmp_path):
    write_ticks(tmp_path, late_batches())
    path = fresh_path(spark, "vwap")
    T.drain(T.vwap_state(T.tick_stream(spark, str(tmp_path), "events-*.parquet", files_per_batch=1), path))
    columns = ["symbol", "trading_day", "valid_points", "above_count", "breached", "passes"]
    streamed = T.vwap_result(spark, path).select(*columns)
    batch = D.vwap_strength(D.cumulative_vwap(T_batch(spark, tmp_path))).select(*columns)
    assert sorted(streamed.collect()) == sorted(batch.collect()) and streamed.count() == 2


def T_batch(spark, folder):
    """The same ticks read as one batch."""
    from marketloom.functions import numeric as N

    raw = spark.read.parquet(f"{folder}/events-*.parquet")
    volume = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(F.lit("sh").alias("market"), F.col("event_type").alias("symbol"), "user_id", "event_id", F.to_date("ts").alias("trading_day"), F.col("ts").cast("timestamp").alias("ts"),
                      F.col("value").alias("price"), volume.alias("volume"), N.scaled(F.col("value") * volume * 100.0, 2).alias("amount_cents"))


def test_window_volume_has_every_window(spark, sf, split_events):
    path = fresh_path(spark, "windows")
    T.drain(T.window_volume(T.tick_stream(spark, split_events, "events-*.parquet", files_per_batch=1), path))
    columns = ["symbol", "trading_day", "indicator_name", "volume_sum", "amount_sum", "bar_count"]
    streamed, batch = T.window_result(spark, path).select(*columns), D.window_sums(S.ticks(spark, sf)).select(*columns)
    assert sorted(streamed.collect()) == sorted(batch.collect())


SCREEN = "market string, symbol string, price double, last_close double, open double, high double, low double, volume bigint, amount double"


def screener_inputs(spark, conditions=None):
    quotes = spark.createDataFrame([("sh", "1", 10.4, 10.0, 10.0, 10.5, 9.9, 1000, 1.02e6), ("sh", "2", 10.4, 0.0, 10.0, 10.5, 9.9, 1000, 1.02e6)], SCREEN)
    recent = spark.createDataFrame([("sh", "1", True, 500.0)], "market string, symbol string, recent_limit_up boolean, avg_volume_last_5 double")
    caps = spark.createDataFrame([("sh", "1", 150.0, 0.15)], "market string, symbol string, total_market_cap double, free_float_market_cap double")
    at = lambda i: dt.datetime(2024, 1, 2, 10, i)
    points = spark.createDataFrame(
        [("sh", "1", dt.date(2024, 1, 2), at(i), i, 10.0 + (0.001 if i % 2 else -0.001) * (i > 0), 10, int((10.0) * 10 * 100 * 100)) for i in range(10)],
        "market string, symbol string, trading_day date, ts timestamp, event_id bigint, price double, volume bigint, amount_cents bigint")
    rows = X.tail_session_inputs(quotes, recent, caps, points, conditions)
    return {r["symbol"]: r for r in X.tail_session_flags(rows, conditions).collect()}


def test_screener_parameters_take_effect(spark):
    assert not screener_inputs(spark)["1"]["ok_intraday_above_vwap"]
    assert screener_inputs(spark, {"intraday_above_vwap_min_ratio_pct": 1.0})["1"]["ok_intraday_above_vwap"]
    assert not screener_inputs(spark, {"intraday_above_vwap_min_ratio_pct": 1.0, "intraday_vwap_max_breach_pct": 0.0})["1"]["ok_intraday_above_vwap"]


def test_a_zero_close_fails_its_conditions_and_stays(spark):
    row = screener_inputs(spark)["2"]
    assert row["gain_pct"] is None and not row["ok_gain_pct"]


def test_every_package_later_than_the_code_is_looked_into(spark):
    from marketloom.plans import warehouse as H

    ends = [20200331, 20200630, 20200930, 20201231, 20210331, 20210630, 20210930]
    rows = [("000001", e, e + 10, f"gpcw{e}") for e in ends] + [("000001", 20200331, 20211001, "gpcw20210930")]
    packages = spark.createDataFrame(rows, "code string, report_date int, announce_date int, package string")
    known = spark.createDataFrame([("000001", "2020Q1")], "code string, latest_period string")
    got = sorted(r["report_date"] for r in H.detect_updates(packages, known).collect())
    assert got == ends[1:]  # six packages; the old report delivered again in the newest one is not taken


def test_final_rows_replace_provisional_rows(spark):
    cols = "market string, symbol string, trading_day date, close double"
    day = dt.date(2024, 1, 2)
    out = D.splice(spark.createDataFrame([("sh", "1", day, 1.0)], cols), spark.createDataFrame([("sh", "1", day, 2.0), ("sh", "1", day + dt.timedelta(days=1), 3.0)], cols))
    assert {(r["close"], r["data_status"]) for r in out.collect()} == {(1.0, "final"), (3.0, "provisional")}


def test_archive_refuses_and_chains_reruns(spark, sf):
    root = fresh_path(spark, "archive")
    data = [("bars_15m", "bars", "stock", D.resample(S.ticks(spark, sf), 15)), ("snapshot_x", "snapshot", "stock", S.securities(spark, sf))]
    A.run(spark, A.ArchiveContext("2024-01-02", root), data)
    with pytest.raises(RuntimeError):
        A.run(spark, A.ArchiveContext("2024-01-02", root), data)
    runs = A.run(spark, A.ArchiveContext("2024-01-02", root, force_rerun=True, rerun_reason="late"), data).orderBy("archive_revision").collect()
    assert [(r["archive_revision"], r["run_id"]) for r in runs] == [(1, "archive_20240102_01"), (2, "archive_20240102_02")]


def test_a_failed_archive_says_where_and_why(spark, sf):
    root = fresh_path(spark, "archive")
    good = ("bars_15m", "bars", "stock", D.resample(S.ticks(spark, sf), 15))
    bad = ("broken", "dataset", "stock", S.securities(spark, sf).select("market", "symbol", F.raise_error(F.lit("boom")).alias("x")))
    A.run(spark, A.ArchiveContext("2024-01-02", root), [good])
    with pytest.raises(Exception, match="boom"):
        A.run(spark, A.ArchiveContext("2024-01-02", root, force_rerun=True), [good, bad])
    row = A.runs_table(spark, root).where("archive_status = 'failed'").first()
    assert (row["archive_revision"], row["run_id"], row["failed_stage"]) == (2, "archive_20240102_02", "dataset broken") and "boom" in row["error"]


def test_archive_checks(spark):
    row = lambda **kw: {"dataset_name": "bars_15m", "dataset_category": "bars", "dataset_scope": "stock", "partition": "trading_day=2024-01-02", "row_count": 1, "data_cutoff_time": "c", "artifact_exists": True, **kw}
    catalog = spark.createDataFrame([row(), row(dataset_name="x", partition="trading_day=1", row_count=-1, data_cutoff_time="z", artifact_exists=False)])
    checks = {r["check_name"]: r["status"] for r in A.validations(catalog, trading_day="2024-01-02", cutoff="c", data_status="provisional", versions=("1", "", "1"), audit_present=False).collect()}
    assert set(checks.values()) == {"failed"} and len(checks) == 9
