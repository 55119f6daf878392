"""Per-security profile and basic quote information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.functions import periods as P
from marketloom.functions import text as T
from marketloom.operators import ranking as R
from marketloom.operators import rolling as L
from marketloom.plans import screener as S
from marketloom.plans import statements as X

KEYS = ["market", "symbol"]


def basic_info(bars: DataFrame, statements: DataFrame, quotes: DataFrame) -> DataFrame:
    """Price, change, volume ratio, shares, A-share cap, EPS and dynamic PE per security.

    A quote's ``price``, ``last_close`` and ``volume`` come before the daily bar's, one by one; cap and PE stay on the daily close.
    """
    c = F.col
    live = quotes.select(*KEYS, c("price").alias("q_price"), c("last_close").alias("q_last_close"), c("volume").alias("q_volume"))
    snap = L.latest_snapshot(bars).join(live, KEYS, "left")
    price, before = F.coalesce("q_price", "latest_close"), F.coalesce("q_last_close", "previous_close")
    volume = F.coalesce("q_volume", "latest_volume")
    eps = X.with_neighbours(statements, ["eps"])
    ttm = N.ttm_eps(P.period_quarter(c("period")), c("eps"), c("eps_prev_annual"), c("eps_prev_same"))
    report = X.latest(eps.withColumn("ttm_eps", ttm)).select(*KEYS, "eps", "ttm_eps", "total_shares", "free_float_shares")
    ratio = F.when(volume != 0, N.ratio(volume, F.nullif(c("avg_volume_5"), F.lit(0.0))))
    return snap.join(report, KEYS, "left").select(
        *KEYS, price.alias("current_price"), (N.ratio(price - before, before) * 100.0).alias("change_pct"),
        ratio.alias("volume_ratio"), N.to_yi(c("total_shares")).alias("total_shares"), N.to_yi(c("free_float_shares")).alias("float_shares"),
        N.market_cap_yi(c("latest_close"), c("total_shares")).alias("a_share_market_cap"), "eps",
        F.when(c("ttm_eps") > 0, c("latest_close") / c("ttm_eps")).alias("dynamic_pe"))


def profiles(securities: DataFrame, industry: DataFrame, concepts: DataFrame, rps: DataFrame, *, bound: int | None, members: int | None = None) -> DataFrame:
    """Industry, concept counts by verdict, RPS and the security's place inside its industry."""
    c = F.col
    core = c("decision") == "keep_core"
    counts = concept_listing(concepts, members=members).groupBy(*KEYS).agg(
        F.count_if(core).alias("core_concept_count"), F.count_if(~core).alias("auxiliary_concept_count"))
    ranked = rps.join(industry.select(*KEYS, "industry_level_2_name"), KEYS, "left")
    tie = [c("market").asc(), c("symbol").asc()]
    for n in (20, 50):
        name = f"industry_rank_{n}"
        ranked = R.ordinal_rank(ranked, ["industry_level_2_name"], [c(f"rps_{n}").desc_nulls_last(), *tie], name, max_group_rows=bound)
        ranked = ranked.withColumn(name, F.when(c(f"rps_{n}").isNotNull() & c("industry_level_2_name").isNotNull(), c(name)))
    display = T.industry_display(c("industry_level_1_name"), c("industry_level_2_name"))
    own = ranked.select(*KEYS, *[f"rps_{n}" for n in spec.RPS_WINDOWS], "industry_rank_20", "industry_rank_50")
    means = S.industry_rps_means(rps, industry)
    return (
        securities.join(industry.select(*KEYS, "industry_level_2_name", display.alias("industry_display")), KEYS, "left")
        .join(counts, KEYS, "left").join(own, KEYS, "left").join(means, "industry_level_2_name", "left")
        .select(*KEYS, "stock_name", "name_initials", "industry_display", F.coalesce("core_concept_count", F.lit(0)).alias("core_concept_count"),
                F.coalesce("auxiliary_concept_count", F.lit(0)).alias("auxiliary_concept_count"), *[f"rps_{n}" for n in spec.RPS_WINDOWS],
                *[f"industry_rps_{n}" for n in spec.RPS_WINDOWS], "industry_rank_20", "industry_rank_50")
    )


def concept_listing(concepts: DataFrame, *, members: int | None = None) -> DataFrame:
    """Concepts of each security with bucket and verdict: the rows behind a profile's core and auxiliary lists.

    The regex rules run once per distinct name; the verdicts then meet the far longer membership table by join, in tasks of a
    fixed size if ``members`` bounds that table.
    """
    rows = R.small_parts(concepts.select(*KEYS, "concept_name").distinct(), ["concept_name"], members)
    names = rows.select("concept_name").distinct()
    verdicts = names.select("concept_name", T.concept_id(F.col("concept_name")).alias("concept_id"), T.concept_rule(F.col("concept_name")).alias("r"))
    verdicts = verdicts.select("concept_name", "concept_id", "r.bucket", "r.decision")
    return rows.join(verdicts, "concept_name").select(*KEYS, "concept_id", "concept_name", "bucket", "decision")
