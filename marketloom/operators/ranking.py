"""Ranks, momentum ranks and percentiles.

Two ways to number the rows of a group:

* ``window`` - ``row_number()`` over the group. One task sorts one group, so it is used only when the largest
  possible group is known to fit a task: a cross-section of one day, one indicator or one industry never has
  more rows than the security master, whose size is read from file footers.
* ``range`` - for groups without such a bound (one group may hold a third of all rows). The rows are range
  partitioned on (group, order keys) with sampled splitters, so a hot group spreads over many tasks; the sorted
  partitions are checkpointed, and a row's rank is its global position minus the first position of its group.
  Only the per-partition counts (one row per partition) travel to every task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import numeric as N
from marketloom.operators.prefix import running_totals
from marketloom.session import ensure_checkpoint_dir

WINDOW_ROW_LIMIT = 2_000_000
TASK_ROWS = 250_000  # rows of a task that sorts a cross-section once per ranked column


def fits_one_task(max_group_rows: int | None) -> bool:
    return max_group_rows is not None and max_group_rows <= WINDOW_ROW_LIMIT


def small_parts(df: DataFrame, keys: list[str], rows: int | None, per_task: int | None = None) -> DataFrame:
    """Whole groups in as many partitions as ``rows`` (of all groups, at most) ask for, so that a task's rows do not grow with the table; a small
    table still gets one per core, down to a fifth of a task's rows. A fixed count is not coalesced again. Without ``rows`` the partitions stay as they are."""
    if rows is None:
        return df
    task = per_task or TASK_ROWS
    cores = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // max(1, task // 5)))
    return df.repartition(max(1, -(-rows // task), cores), *keys)


def with_group_stats(df: DataFrame, group: list[str], stats: dict[str, Column], *, max_group_rows: int | None) -> DataFrame:
    """Adds aggregates of each row's group: over a window for bounded groups, else by an aggregate with map-side combine
    whose result (one row per group) is joined back."""
    if fits_one_task(max_group_rows):
        return df.select("*", *[agg.over(W.partitionBy(*group)).alias(n) for n, agg in stats.items()])
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    totals = df.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(*[agg.alias(n) for n, agg in stats.items()])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return df.join(totals, same).select(*df.columns, *stats)


def ordinal_rank(df: DataFrame, group: list[str], order: list[Column], out: str, *, max_group_rows: int | None) -> DataFrame:
    """Number rows 1..n within each group; picks the window or the range way by the group bound."""
    if fits_one_task(max_group_rows):
        return df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint"))
    return ordinal_rank_by_range(df, group, order, out)


def ordinal_rank_by_range(df: DataFrame, group: list[str], order: list[Column], out: str, partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in group] + list(order)
    # The row index inside a sorted partition is only meaningful on frozen partitions, hence the checkpoint.
    placed = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    starts = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    located = placed.join(F.broadcast(starts), "_pid").withColumn("_pos", F.col("_start") + F.col("_idx"))
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    first = located.groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.min("_pos").alias("_first"))
    if group:  # one row per group; nulls are a group of their own
        joined = located.join(first, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]))
    else:
        joined = located.withColumn("_first", first.scalar())
    return joined.select(*df.columns, (F.col("_pos") - F.col("_first") + 1).cast("bigint").alias(out))


def rps(rank: Column, universe: Column) -> Column:
    """Share of the universe at or behind a rank, in percent with two decimals."""
    return N.rounded((universe - rank + 1) / universe * 100.0, 2)


def momentum_ranks(
    returns: DataFrame, windows: tuple[int, ...], *, max_group_rows: int | None, rank_nulls: bool = True, rows: int | None = None,
) -> DataFrame:
    """rank_N / rps_N / universe_size per trading day for the columns return_N_pct.

    ``rank_nulls`` keeps rows without a return at the bottom of the universe; otherwise they leave it.
    ``rows`` bounds the rows of all days: they are ranked in tasks of a fixed size (see ``small_parts``).
    """
    day = ["trading_day"]
    sizes = {"universe_size": F.count(F.lit(1)), **{f"_n_{n}": F.count(f"return_{n}_pct") for n in windows if not rank_nulls}}
    placed = small_parts(returns, day, rows) if fits_one_task(max_group_rows) else returns
    out = with_group_stats(placed, day, sizes, max_group_rows=max_group_rows)
    for n in windows:
        value = F.col(f"return_{n}_pct")
        order = [value.desc_nulls_last(), F.col("market").asc(), F.col("symbol").asc()]
        out = ordinal_rank(out, day, order, f"rank_{n}", max_group_rows=max_group_rows)
        out = out.withColumn(f"rps_{n}", rps(F.col(f"rank_{n}"), F.col("universe_size" if rank_nulls else f"_n_{n}")))
        if not rank_nulls:
            for c in (f"rank_{n}", f"rps_{n}"):
                out = out.withColumn(c, F.when(value.isNotNull(), F.col(c)))
    return out.drop(*[f"_n_{n}" for n in windows])


def percentile_scores(
    long: DataFrame, group: list[str], *, max_group_rows: int | None, missing_default: float = 50.0,
    empty_default: float | None = None,
) -> DataFrame:
    """Score 0..100 by ordinal position within ``group`` for (raw, higher_better, zero_penalty) rows.

    A penalised group that loses every value scores 0; any other missing value scores ``missing_default``
    (``empty_default`` for a group without any raw value).
    """
    empty = missing_default if empty_default is None else empty_default
    usable = F.when(F.col("zero_penalty") & F.col("higher_better") & (F.col("raw") <= 0), None).otherwise(F.col("raw"))
    signed = F.when(F.col("higher_better"), -F.col("_v")).otherwise(F.col("_v"))
    out = long.withColumn("_v", usable).withColumn("_signed", signed)
    out = with_group_stats(out, group, {"_raw_n": F.count("raw"), "_n": F.count("_v")}, max_group_rows=max_group_rows)
    order = [F.col("_signed").asc_nulls_last(), F.col("market").asc(), F.col("symbol").asc()]
    out = ordinal_rank(out, group, order, "_rk", max_group_rows=max_group_rows)
    score = (
        F.when(F.col("_v").isNotNull(), N.rounded((F.col("_n") - F.col("_rk") + 1) / F.col("_n") * 100.0, 4))
        .when(F.col("_raw_n") == 0, empty)
        .when(F.col("_n") == 0, 0.0)
        .otherwise(missing_default)
    )
    return out.withColumn("score", score).drop("_v", "_signed", "_raw_n", "_n", "_rk")


def sample_percentiles(
    probe: DataFrame, sample: DataFrame, group: list[str], value: str, sample_value: str, out: str, *, max_group_rows: int | None,
) -> DataFrame:
    """Empirical percentile of ``probe.value`` within the ``sample`` rows of the same group.

    Both sides become weighted points: the sample is first reduced to one row per distinct (group, value), then a
    running count over the ordered points gives "how many lie below". Nothing is collected into arrays and no
    pair of (probe, sample) rows is ever formed. Groups without a size bound are cut into value ranges, and the running
    count goes over the ranges first.
    """
    weights = sample.where(F.col(sample_value).isNotNull()).groupBy(*group, F.col(sample_value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_w")
    )
    points = probe.select(*group, F.col(value).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    points = points.join(weights, [*group, "_v"], "full_outer").withColumn("_w", F.coalesce("_w", F.lit(0)))
    if fits_one_task(max_group_rows):
        so_far = W.partitionBy(*group).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
        points = points.withColumn("_cum", F.sum("_w").over(so_far))
    else:
        points = running_totals(points, group, ["_v"], {"_cum": F.col("_w")})
    points = with_group_stats(points, group, {"_size": F.sum("_w")}, max_group_rows=max_group_rows)
    percentile = N.empirical_percentile(F.col("_cum") - F.col("_w"), F.col("_w"), F.col("_size"))
    counted = points.select(*group, F.col("_v").alias(value), percentile.alias(out))
    return probe.join(counted, [*group, value], "left")
