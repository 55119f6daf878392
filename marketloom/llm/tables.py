"""Reading the given tables and settling intermediate ones in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import fresh_path

PYTHON_ROWS = "1000"  # rows of a batch sent to Python: texts can be long
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", PYTHON_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later jobs neither recompute it nor depend
    on an executor that may be lost."""
    path = fresh_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go at its end, not whenever the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


@contextmanager
def noted() -> Iterator[list[str]]:
    """Lists the paths of the tables that are settled inside."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield paths
    finally:
        _scopes.pop()


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete settled tables whose readers have all been written."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def filled(text: str | Column) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
