"""Optional predicates and paging. A predicate exists in the plan only when its parameter is set, so every filter
stays a plain column comparison that can be pushed to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import text as T
from marketloom.operators import ranking as R

DEEP_PAGE_ROWS = 100_000


def number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def keyword(df: DataFrame, column: str, expected: str | None) -> DataFrame:
    """Exact text match; no filter without an expected value, and a blank cell never matches."""
    wanted = (expected or "").strip()
    return df if not wanted else df.where(T.normalize_text(F.col(column)) == wanted)


def bounded(df: DataFrame, column: str | Column, low: float | None = None, high: float | None = None) -> DataFrame:
    """Inclusive bounds; NULL fails as soon as a bound is set."""
    c = F.col(column) if isinstance(column, str) else column
    tests = ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def dynamic_column(param: str) -> tuple[str, str] | None:
    """(column, bound) of a prefixed parameter: dimension, indicator or RPS bounds."""
    side, _, rest = param.partition("_")
    if side not in ("min", "max"):
        return None
    if rest.startswith("dim_"):
        return (rest[4:], side) if rest[4:] in spec.DIM_WEIGHTS else None
    if rest.startswith("sub_"):
        return ("sub_" + rest[4:], side) if rest[4:] in spec.SUB_KEYS else None
    for prefix in ("industry_rps_", "rps_"):
        if rest.startswith(prefix):
            return (rest, side) if rest[len(prefix):] in {str(n) for n in spec.RPS_WINDOWS} else None
    return None


def screen(df: DataFrame, params: dict[str, str]) -> DataFrame:
    """Apply all screener parameters that are set."""
    out = df
    for param, column in spec.TEXT_PARAMS.items():
        out = keyword(out, column, params.get(param))
    for param, raw in params.items():
        target = spec.NUMBER_PARAMS.get(param) or dynamic_column(param)
        value = number(raw)
        if target is None or value is None:
            continue
        column, side = target
        out = bounded(out, column, low=value) if side == "min" else bounded(out, column, high=value)
    return out


def page(df: DataFrame, order: list[Column], number_wanted: int = 1, size: int = 50) -> DataFrame:
    """One page with ``total``, ``page`` and ``total_pages``; the page is clamped to the last one.

    The row count is the only value fetched. Near pages use top-k; deep pages use the distributed rank, so no task or
    driver ever sorts everything before the page.
    """
    size = min(size if size >= 1 else 50, 200)
    total = df.count()
    pages = max(1, -(-total // size))
    number_wanted = min(max(1, number_wanted), pages)
    start = (number_wanted - 1) * size
    if start + size <= DEEP_PAGE_ROWS:
        rows = df.orderBy(*order).offset(start).limit(size)
    else:
        ranked = R.ordinal_rank_by_range(df, [], order, "_rank")
        rows = ranked.where(F.col("_rank").between(start + 1, start + size)).drop("_rank")
    meta = {"total": total, "page": number_wanted, "total_pages": pages}
    return rows.select("*", *[F.lit(v).cast("bigint").alias(k) for k, v in meta.items()])
