"""Lines meet their group in tasks of a fixed size, whatever the size of the table and of its input splits."""

import os
import shutil

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from marketloom.operators import ranking as R
from marketloom.plans import concepts as C
from marketloom.plans import profile
from marketloom.sources import tables as S

STEPS = {"statements": S.statements, "bars": S.bars, "concepts": S.concepts}


def copies(sf, path, lines):
    """The tables with other line items."""
    for name in os.listdir(sf):
        if name != "lineitem.parquet":
            shutil.copyfile(f"{sf}/{name}", f"{path}/{name}")
    duckdb.connect().execute(f"COPY ({lines.format(f'{sf}/lineitem.parquet')}) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


def repeated(n):
    return " UNION ALL ".join(f"SELECT * REPLACE (l_suppkey + {k * 1000} AS l_suppkey) FROM '{{0}}'" for k in range(n))


@pytest.mark.parametrize("step", STEPS)
def test_tasks_do_not_grow_with_the_lines(spark, sf, tmp_path, monkeypatch, step):
    monkeypatch.setattr(R, "TASK_ROWS", 1000)
    largest = []
    for n in (1, 8):
        folder = tmp_path / str(n)
        folder.mkdir()
        rows = STEPS[step](spark, copies(sf, folder, repeated(n)))
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        largest.append((sum(sizes), max(sizes)))
    (few, small), (many, large) = largest
    assert many == 8 * few and large <= 3 * small and large <= 4000


@pytest.mark.parametrize("step", STEPS)
def test_no_hash_table_over_an_input_split(spark, sf, step):
    plan = STEPS[step](spark, sf)._jdf.queryExecution().executedPlan().toString()
    stages = [x for x in plan.split("Exchange") if "FileScan" in x]
    assert stages and not any("Aggregate" in x for x in stages)


def test_members_of_concepts_in_tasks_of_a_fixed_size(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_ROWS", 500)
    rows = spark.range(20_000).select(
        F.lit("sh").alias("market"), (F.col("id") % 100).cast("string").alias("symbol"), (F.col("id") / 100).cast("int").cast("string").alias("concept_name"))
    names = rows.select("market", "symbol", F.lit("n").alias("stock_name"), F.lit("i").alias("name_initials")).distinct()
    industry = names.select("market", "symbol", F.lit("a").alias("industry_level_1_name"), F.lit("b").alias("industry_level_2_name"))
    for out in (C.concept_index(rows, names, industry, bound=100, members=20_000), profile.concept_listing(rows, members=20_000)):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 2500
    a, b = (C.concept_index(rows, names, industry, bound=n, members=m) for n, m in ((100, 20_000), (None, None)))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


HOT = ("SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey, CASE WHEN l_orderkey % 5 = 0 THEN 7 ELSE l_partkey END AS l_partkey, "
       "CASE WHEN l_orderkey % 7 = 0 THEN TIMESTAMP '2000-05-05' ELSE l_shipdate END AS l_shipdate) FROM '{0}'")


@pytest.mark.parametrize("name", [
    "agg_03_concept_members", "jon_02_concept_security_industry", "pro_04_concept_lists", "arr_06_first_ten_members", "jon_07_known_symbols",
    "agg_07_industry_snapshot", "val_05_temperature_history", "fin_02_market_scores", "agg_10_industry_raw_means", "agg_18_symbol_count"])
def test_hot_keys_match_sql(spark, sf, tmp_path, monkeypatch, name):
    """A security with a third of the lines, a part with a fifth and a day with a seventh, in many tasks."""
    monkeypatch.setattr(R, "TASK_ROWS", 300)
    folder = copies(sf, tmp_path, HOT)
    error, _rows = oracle.compare(contract.queries()[name](spark, folder), oracle.connect(folder), contract.oracle_sql()[name])
    assert error is None, error
