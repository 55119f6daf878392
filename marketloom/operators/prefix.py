"""Running totals over groups of unbounded size, by ranges.

Rows are range partitioned by (group, order) with sampled splitters, so a group, and even one instant of it that many rows share a minute
with, is cut into as many ranges as it has rows for. Range totals are aggregated with map-side combine; the running total over
ranges touches at most one row per partition and group; the running total inside a range is a window over (group, range). No task ever holds
a whole group, so one symbol may own any share of the ticks, in whatever minute. Ranges are written once, so that retried
tasks see the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.session import settle


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the number of its range of ``keys`` as ``_range``, settled."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))


def running_totals(df: DataFrame, group: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds one column per entry of ``totals``: the running sum of its expression in ``order`` within ``group``."""
    work = df
    for name, expr in totals.items():
        work = work.withColumn(f"_x_{name}", expr)
    work = ranged(work, [*group, *order])
    per_range = work.groupBy(*group, "_range").agg(*[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in totals])
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *group, "_range", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )
    inside = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = work.join(offsets, [*group, "_range"])
    return joined.select(
        *df.columns, *[(F.col(f"_o_{n}") + F.sum(f"_x_{n}").over(inside)).alias(n) for n in totals]
    )
