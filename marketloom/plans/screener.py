"""Screeners: the wide stock screener and the tail-session screener, both over the whole universe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.functions import text as T
from marketloom.operators import filters as X
from marketloom.plans import intraday as D
from marketloom.session import settle

KEYS = ["market", "symbol"]


def industry_rps_means(rps: DataFrame, industry: DataFrame) -> DataFrame:
    """Mean RPS per level-2 industry, two decimals."""
    rows = rps.join(industry.select(*KEYS, "industry_level_2_name"), KEYS).where(F.col("industry_level_2_name") != "")
    mean = lambda n: N.rounded(N.unscaled(F.sum(N.scaled(F.col(f"rps_{n}"), 2)), 2) / F.nullif(F.count(f"rps_{n}"), F.lit(0)), 2)
    return rows.groupBy("industry_level_2_name").agg(*[mean(n).alias(f"industry_rps_{n}") for n in spec.RPS_WINDOWS])


def screener_rows(
    ranked: DataFrame, indicator_scores: DataFrame, securities: DataFrame, industry: DataFrame, valuation: DataFrame, rps: DataFrame,
    strategies: DataFrame | None = None, strategy: str | None = None,
) -> DataFrame:
    """Wide screener table. Left joins only, all on the security key; small sides are broadcast by size, not by hint.

    ``ranked``: score snapshot with ranks. ``indicator_scores``: columns sub_<indicator>. ``valuation``: member rows
    with temperature. Industry names come from the score row, then the industry table, then the valuation row.
    """
    c = F.col
    first = lambda *names: F.coalesce(*[T.blank_to_null(c(n)) for n in names])
    ind = industry.select(*KEYS, c("industry_level_1_name").alias("_i1"), c("industry_level_2_name").alias("_i2"))
    val = valuation.select(
        *KEYS, "current_price", "pe_ttm", "ps_ttm", "total_market_cap", "free_float_market_cap", "classification", "classification_label",
        "valuation_band_label", "primary_metric", "primary_percentile", "temperature_label", "temperature_percentile_since_2022",
        c("industry_level_1_name").alias("_v1"), c("industry_level_2_name").alias("_v2"))
    score = ranked.select(
        *KEYS, c("industry_level_1_name").alias("_s1"), c("industry_level_2_name").alias("_s2"), *spec.DIM_WEIGHTS, "market_total_score",
        c("ind_total_score").alias("industry_total_score"), "market_total_rank", "market_total_universe_size", "industry_total_rank",
        "industry_total_universe_size")
    rows = (
        score.join(indicator_scores, KEYS, "left").join(securities.select(*KEYS, "stock_name"), KEYS, "left").join(ind, KEYS, "left")
        .join(val, KEYS, "left").join(rps.select(*KEYS, *[f"rps_{n}" for n in spec.RPS_WINDOWS]), KEYS, "left")
    )
    rows = rows.withColumn("industry_level_1", first("_s1", "_i1", "_v1")).withColumn("industry_level_2", first("_s2", "_i2", "_v2"))
    rows = rows.withColumn("stock_name", F.coalesce(T.blank_to_null(c("stock_name")), c("symbol")))
    rows = rows.withColumnsRenamed({"temperature_label": "industry_temperature_label", "temperature_percentile_since_2022": "industry_temperature_percentile_since_2022"})
    means = industry_rps_means(rps, industry).withColumnRenamed("industry_level_2_name", "industry_level_2")
    rows = rows.join(means, "industry_level_2", "left")
    if strategy:
        hit = strategies.where((c("strategy") == strategy) & c("passed")).select(*KEYS, "strategy", "strategy_label")
        rows = rows.join(hit, KEYS)
    return rows.drop("_s1", "_s2", "_i1", "_i2", "_v1", "_v2")


SCREENER_ORDER = [("market_total_score", False), ("market_total_rank", True), ("market", True), ("symbol", True)]


def screener_order() -> list[Column]:
    return [F.col(n).asc_nulls_last() if up else F.col(n).desc_nulls_last() for n, up in SCREENER_ORDER]


def stock_screener(rows: DataFrame, params: dict[str, str]) -> DataFrame:
    """Filtered, ordered page of the screener table."""
    wanted = lambda key, default: int(X.number(params.get(key)) or default)
    hits = settle(X.screen(rows, params))  # counted once and paged once
    return X.page(hits, screener_order(), wanted("page", 1), wanted("page_size", 50))


# ---- tail session -----------------------------------------------------------------------------------
SWITCHES = tuple(spec.TAIL_SESSION_NAMES)


def tail_session_inputs(quotes: DataFrame, recent: DataFrame, valuation: DataFrame, points: DataFrame | None, conditions: dict | None = None) -> DataFrame:
    """Quotes with recent-bar statistics, caps and the VWAP strength of their intraday points, tested by ``conditions``.

    ``recent`` carries limit-up and average volume per symbol. Points, the costly side, are reduced to one row per
    symbol before they meet the quotes.
    """
    p = {**spec.TAIL_SESSION, **(conditions or {})}
    rows = quotes.where(F.col("price").isNotNull()).join(recent, KEYS, "left").join(
        valuation.select(*KEYS, "total_market_cap", "free_float_market_cap"), KEYS, "left")
    if points is None:
        return rows.withColumn("points_pass", F.lit(None).cast("boolean"))
    strength = D.vwap_strength(
        D.cumulative_vwap(points), min_ratio_pct=p["intraday_above_vwap_min_ratio_pct"], max_breach_pct=p["intraday_vwap_max_breach_pct"]).select(*KEYS, F.col("passes").alias("points_pass"))
    return rows.join(strength, KEYS, "left")


def tail_session_flags(rows: DataFrame, conditions: dict | None = None) -> DataFrame:
    """One boolean per condition; a condition that cannot be evaluated fails."""
    p = {**spec.TAIL_SESSION, **(conditions or {})}
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = rows.withColumn("gain_pct", N.rounded(N.return_pct(c("price"), c("last_close")), 4))
    own = c("volume_ratio") if "volume_ratio" in rows.columns else F.lit(None).cast("double")  # the quote's own comes first
    rows = rows.withColumn("volume_ratio", F.coalesce(own, F.when(c("avg_volume_last_5") > 0, c("volume") / c("avg_volume_last_5"))))
    float_cap = F.coalesce(F.nullif(c("free_float_market_cap"), F.lit(0.0)), c("total_market_cap"))
    rows = rows.withColumn("turnover_pct", F.when((float_cap > 0) & (c("price") > 0), c("volume") * spec.LOT_SIZE * c("price") / (float_cap * 1e8) * 100.0))
    vwap = F.coalesce(c("points_pass"), D.quote_vwap_passes(c("amount"), c("volume"), c("low"), p["intraday_vwap_max_breach_pct"]))
    flags = {
        "gain_pct": c("gain_pct").between(p["gain_min_pct"], p["gain_max_pct"]),
        "limit_up_lookback_days": c("recent_limit_up"),
        "min_volume_ratio": c("volume_ratio") >= p["min_volume_ratio"],
        "max_market_cap_yi": c("total_market_cap") <= p["max_market_cap_yi"],
        "turnover_pct": c("turnover_pct").between(p["turnover_min_pct"], p["turnover_max_pct"]),
        "intraday_above_vwap": vwap if p["intraday_above_vwap"] else F.lit(True),
        "current_above_open": c("price") > c("open") if p["current_above_open"] else F.lit(True),
    }
    return rows.withColumns({"ok_" + k: no(v) for k, v in flags.items()})


def tail_session_matches(flags: DataFrame, enabled: dict[str, bool] | None = None, conditions: dict | None = None) -> DataFrame:
    """Quotes passing every enabled condition, best gain first, with the names of the evaluated conditions."""
    p = {**spec.TAIL_SESSION, **(conditions or {})}
    on = [k for k in SWITCHES if (enabled or {}).get(k, True) and p.get(k, True)]
    test = reduce(lambda a, b: a & b, [F.col("ok_" + k) for k in on], F.lit(True))
    names = [n for k in on for n in spec.TAIL_SESSION_NAMES[k]]
    return flags.where(test).withColumn("matched_conditions", F.lit("|".join(names))).orderBy(F.col("gain_pct").desc(), "market", "symbol")


def tail_session_view(matches: DataFrame, securities: DataFrame, industry: DataFrame, ranked: DataFrame) -> DataFrame:
    """Matches as they are shown: name, rounded figures, industries (the score row's first), industry score, rank and universe; best gain first."""
    c = F.col
    first = lambda *names: F.coalesce(*[T.blank_to_null(c(n)) for n in names])
    score = ranked.select(
        *KEYS, c("industry_level_1_name").alias("_s1"), c("industry_level_2_name").alias("_s2"), c("ind_total_score").alias("industry_total_score"), "industry_total_rank",
        "industry_total_universe_size")
    rows = matches.join(securities.select(*KEYS, "stock_name"), KEYS, "left").join(score, KEYS, "left").join(
        industry.select(*KEYS, c("industry_level_1_name").alias("_i1"), c("industry_level_2_name").alias("_i2")), KEYS, "left")
    two = lambda name: N.rounded(c(name), 2)
    return rows.select(
        *KEYS, F.coalesce(T.blank_to_null(c("stock_name")), c("symbol")).alias("stock_name"), two("price").alias("current_price"), two("gain_pct").alias("gain_pct"),
        two("volume_ratio").alias("volume_ratio"), two("total_market_cap").alias("market_cap_yi"), two("turnover_pct").alias("turnover_pct"),
        first("_s1", "_i1").alias("industry_level_1"), first("_s2", "_i2").alias("industry_level_2"), "industry_total_score", "industry_total_rank",
        "industry_total_universe_size", "matched_conditions").orderBy(c("gain_pct").desc(), "market", "symbol")
