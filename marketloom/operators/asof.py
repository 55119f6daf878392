"""As-of join by one ordered pass: bars and probes are united per symbol and the last seen bar is carried forward.

One shuffle on the symbol and no range join; a symbol's rows are bounded by calendar days plus its probes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators import ranking as R


def close_on_or_before(bars: DataFrame, probes: DataFrame, day: str, *, rows: int | None = None) -> DataFrame:
    """Adds ``asof_close`` and ``sessions`` (bars so far) to the probes; probes before the first bar get NULL.

    ``rows`` bounds the bars: symbols are passed in tasks of a fixed size (see ``small_parts``).
    """
    left = bars.select("market", "symbol", F.col("trading_day").alias("_day"), F.lit(0).alias("_probe"), "close")
    right = probes.select("market", "symbol", F.col(day).alias("_day"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"))
    both = R.small_parts(left.unionByName(right, allowMissingColumns=True), ["market", "symbol"], rows)
    so_far = W.partitionBy("market", "symbol").orderBy("_day", "_probe").rowsBetween(W.unboundedPreceding, 0)
    seen = both.select(
        "_row", F.last("close", ignorenulls=True).over(so_far).alias("asof_close"), F.count("close").over(so_far).alias("_n"))
    hits = seen.where(F.col("_row").isNotNull())
    return hits.select("_row.*", "asof_close", F.nullif("_n", F.lit(0)).alias("sessions"))
