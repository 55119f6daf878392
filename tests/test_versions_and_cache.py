"""Tables that change by whole versions, and results that are cached by the content of their inputs."""

import pytest

from marketloom.plans import warehouse as H
from marketloom.session import fresh_path
from marketloom.sources import files

ROWS = "code string, period string, announce_date int, revenue double"


def held(store, version=None):
    return sorted(tuple(r) for r in store.read(version=version).select("code", "period", "announce_date", "revenue").collect())


def test_a_failed_upsert_leaves_the_old_version_whole(spark, monkeypatch):
    store = H.VersionedPeriods(spark, fresh_path(spark, "versions"))
    old = [("a", "2000Q1", 5, 1.0), ("b", "2000Q1", 6, 2.0), ("a", "2000Q2", 7, 3.0), ("c", "1999A", 8, 4.0)]
    assert store.replace(spark.createDataFrame(old, ROWS)) == 1
    new = spark.createDataFrame([("a", "2000Q1", 0, 10.0), ("d", "2000Q2", 9, 11.0), ("e", "2000Q3", 9, 12.0)], ROWS)

    def fails_after_data(rows, path):
        rows.write.partitionBy("period").parquet(path)
        raise RuntimeError("lost driver")

    monkeypatch.setattr(H, "write_periods", fails_after_data)
    with pytest.raises(RuntimeError):
        store.upsert(new, ["code", "period"])
    monkeypatch.undo()
    assert store.version() == 1 and held(store) == sorted(old)
    assert store.upsert(new, ["code", "period"], keep_announce=True) == 2
    want = [("a", "2000Q1", 5, 10.0), ("b", "2000Q1", 6, 2.0), ("a", "2000Q2", 7, 3.0), ("d", "2000Q2", 9, 11.0), ("e", "2000Q3", 9, 12.0), ("c", "1999A", 8, 4.0)]
    assert held(store) == sorted(want) and held(store, version=1) == sorted(old)
    assert store.folders(1)["1999A"] == store.folders(2)["1999A"]  # an untouched period is not written again
    assert [tuple(r) for r in store.read(["2000Q3"]).select("code", "revenue").collect()] == [("e", 12.0)]
    store.drop_old(keep=1)
    assert held(store) == sorted(want)
    assert store.upsert(new.limit(0), ["code", "period"]) == 2


def test_two_writers_of_one_version(spark):
    store = H.VersionedPeriods(spark, fresh_path(spark, "versions"))
    store.replace(spark.createDataFrame([("a", "2000Q1", 5, 1.0)], ROWS))
    rows = spark.createDataFrame([("b", "2000Q2", 5, 1.0)], ROWS)
    assert store._publish(rows, store.folders(1), 1) == 2
    with pytest.raises(Exception):  # the other writer started from version 1 too
        store._publish(rows, store.folders(1), 1)
    assert store.version() == 2 and len(held(store)) == 2
    with pytest.raises(LookupError):
        store.read(["1900Q1"])


def test_cache_follows_its_inputs(spark):
    root, table = fresh_path(spark, "cache"), fresh_path(spark, "input")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(table)

    spark.range(3).write.parquet(table)
    for _ in range(2):
        assert files.cached_result(spark, root, {"limit": 3}, build, [table]).count() == 3
    assert len(built) == 1
    spark.range(2).write.mode("append").parquet(table)
    assert files.cached_result(spark, root, {"limit": 3}, build, [table]).count() == 5
    assert files.cached_result(spark, root, {"limit": 4}, build, [table]).count() == 5
    assert len(built) == 3


def test_two_builders_leave_one_result(spark):
    root = fresh_path(spark, "cache")

    def build_while_another_finishes():
        files.cached_result(spark, root, {"k": 1}, lambda: spark.range(7))
        return spark.range(7)

    assert files.cached_result(spark, root, {"k": 1}, build_while_another_finishes).count() == 7


def test_archive_works_concepts_and_ticks_out_once(spark, sf, monkeypatch):
    """Datasets that are written again, by a rerun too, read settled files and not the trades or events."""
    from marketloom.catalog import jobs

    sources = {name: " ".join(rows.inputFiles()) for name, _category, _scope, rows in jobs.datasets(spark, sf)}
    assert not any("lineitem" in s or "events" in s for s in sources.values()), sources
    assert "settled" in sources["snapshot_stock_concept_membership"] and "settled" in sources["bars_15m"]
