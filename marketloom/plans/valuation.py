"""Relative valuation: inputs per stock, industry snapshots, classes, samples and percentiles, for all stocks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.functions import periods as P
from marketloom.functions import text as T
from marketloom.operators import asof
from marketloom.operators import ranking as R
from marketloom.operators import rolling as L
from marketloom.plans import statements as X

KEYS = ["market", "symbol"]
MAX_PERIODS = 1000  # quarters an industry can have in its history, with room to spare
MONEY_DIGITS = 10  # hundred millions of yuan, exact to the cent when summed


def trailing(statements: DataFrame) -> DataFrame:
    """Statement rows with trailing twelve-month profit and revenue and trailing EPS."""
    rows = X.with_neighbours(statements, ["net_profit", "revenue", "eps"])
    eps = N.ttm_eps(P.period_quarter(F.col("period")), F.col("eps"), F.col("eps_prev_annual"), F.col("eps_prev_same"))
    return rows.select(
        *statements.columns, N.to_yi(X.ttm("net_profit")).alias("ttm_net_profit"), N.to_yi(X.ttm("revenue")).alias("ttm_revenue"),
        eps.alias("ttm_eps"))


def priced(rows: DataFrame) -> DataFrame:
    """Caps and multiples from current_price, shares and trailing figures."""
    c = F.col
    fallback = F.when(c("ttm_eps") > 0, c("current_price") / c("ttm_eps"))
    direct = c("total_market_cap").isNotNull() & (c("ttm_net_profit") != 0)
    return (
        rows.withColumn("total_market_cap", N.market_cap_yi(c("current_price"), c("total_shares")))
        .withColumn("free_float_market_cap", N.market_cap_yi(c("current_price"), c("free_float_shares")))
        .withColumn("pe_ttm", F.when(direct, N.ratio(c("total_market_cap"), c("ttm_net_profit"))).otherwise(fallback))
        .withColumn("ps_ttm", N.ratio(c("total_market_cap"), c("ttm_revenue")))
        .withColumn("revenue_yoy", N.percent_to_ratio(c("revenue_growth")))
        .withColumn("gross_margin", N.gross_margin(c("gross_margin_pct"), c("revenue"), c("op_cost")))
        .withColumn("book_value_per_share", c("bvps"))
        .withColumn("is_suspended", F.lit(False))
    )


INPUT_COLUMNS = [
    "market", "symbol", "industry_level_1_name", "industry_level_2_name", "period", "listed_days", "current_price",
    "total_market_cap", "free_float_market_cap", "ttm_net_profit", "ttm_revenue", "revenue_yoy", "gross_margin",
    "book_value_per_share", "pe_ttm", "ps_ttm", "is_suspended",
]


def current_inputs(statements: DataFrame, bars: DataFrame, industry: DataFrame) -> DataFrame:
    """Valuation inputs per stock at its newest statement and last close."""
    close = bars.groupBy(*KEYS).agg(F.max_by("close", "trading_day").alias("current_price"), F.count(F.lit(1)).alias("listed_days"))
    rows = X.latest(trailing(statements)).join(close, KEYS, "left").join(industry, KEYS)
    return priced(rows).select(*INPUT_COLUMNS)


def period_inputs(
    statements: DataFrame, bars: DataFrame, industry: DataFrame, since_year: int = spec.HISTORY_SINCE_YEAR, *, bar_rows: int | None = None,
) -> DataFrame:
    """Valuation inputs at every past quarter end. ``bar_rows`` bounds the bars (see ``asof``)."""
    rows = trailing(statements).where(P.period_year(F.col("period")) >= since_year)
    rows = rows.withColumn("trading_day", P.period_end_day(F.col("period")))
    rows = asof.close_on_or_before(bars, rows, "trading_day", rows=bar_rows)
    rows = rows.withColumnRenamed("asof_close", "current_price").withColumnRenamed("sessions", "listed_days").join(industry, KEYS)
    return priced(rows).select(*INPUT_COLUMNS, "trading_day")


def rejection(c=F.col) -> Column:
    """Why a member does not count, first reason wins; NULL for a valid member."""
    return (
        F.when(c("is_suspended"), "suspended")
        .when(c("listed_days") < spec.NEW_LISTING_SESSIONS, "new_listing")
        .when(c("book_value_per_share").isNull() | (c("book_value_per_share") <= 0), "invalid_book_value")
        .when(c("ttm_net_profit").isNull() | (c("ttm_net_profit") <= 0), "loss")
    )


def weighted_ratio(numerator: str, denominator: str, valid: Column) -> Column:
    """Sum over sum of the valid rows that have both and a positive denominator."""
    ok = valid & F.col(numerator).isNotNull() & (F.col(denominator) > 0)
    part = lambda c: F.sum(F.when(ok, N.scaled(F.col(c), MONEY_DIGITS)))
    total = part(denominator)
    return F.when(total > 0, N.unscaled(part(numerator), MONEY_DIGITS) / N.unscaled(total, MONEY_DIGITS))


def industry_snapshot(inputs: DataFrame, by: list[str], minimum: int = spec.MIN_VALID_MEMBERS) -> DataFrame:
    """Member counts by rejection reason, weighted multiples and the dynamic PE limit, one aggregate for all groups."""
    rows = inputs.withColumn("_reason", rejection())
    valid = F.col("_reason").isNull()
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_member_count"),
        F.count_if(valid).alias("valid_member_count"),
        *[F.count_if(F.col("_reason") == r).alias(n) for r, n in (
            ("loss", "loss_count"), ("invalid_book_value", "invalid_book_value_count"),
            ("new_listing", "new_listing_filtered_count"), ("suspended", "suspended_filtered_count"))],
        weighted_ratio("total_market_cap", "ttm_net_profit", valid).alias("_pe"),
        weighted_ratio("total_market_cap", "ttm_revenue", valid).alias("_ps"),
        weighted_ratio("free_float_market_cap", "ttm_net_profit", valid).alias("free_float_weighted_pe_ttm"),
        weighted_ratio("free_float_market_cap", "ttm_revenue", valid).alias("free_float_weighted_ps_ttm"),
    )
    out = out.withColumn("weighted_pe_ttm", F.coalesce("_pe", "free_float_weighted_pe_ttm")).withColumn(
        "weighted_ps_ttm", F.coalesce("_ps", "free_float_weighted_ps_ttm")).drop("_pe", "_ps")
    limit = F.least(F.greatest(F.col("weighted_pe_ttm") * spec.PE_THRESHOLD_MULTIPLIER, F.lit(spec.PE_THRESHOLD_FLOOR)), F.lit(spec.PE_THRESHOLD_CAP))
    return out.withColumn("pe_invalid_threshold", F.when(F.col("weighted_pe_ttm").isNotNull(), limit)).withColumn(
        "sample_status", F.when(F.col("valid_member_count") < minimum, "insufficient").otherwise("ok"))


def temperature_history(inputs_by_period: DataFrame, minimum: int = spec.MIN_VALID_MEMBERS) -> DataFrame:
    """Weighted PE per industry and quarter end, only where the sample suffices."""
    snap = industry_snapshot(inputs_by_period, ["industry_level_2_name", "trading_day"], minimum)
    return snap.where((F.col("sample_status") == "ok") & F.col("weighted_pe_ttm").isNotNull()).select(
        "industry_level_2_name", "trading_day", "weighted_pe_ttm")


def with_temperature(snapshot: DataFrame, history: DataFrame) -> DataFrame:
    """Where today's weighted PE stands in the industry's own history."""
    probe = snapshot.withColumn("_now", F.when(F.col("sample_status") == "ok", F.col("weighted_pe_ttm")))
    out = R.sample_percentiles(probe, history.select("industry_level_2_name", F.col("weighted_pe_ttm").alias("_past")),
                               ["industry_level_2_name"], "_now", "_past", "temperature_percentile_since_2022", max_group_rows=MAX_PERIODS)
    return out.drop("_now").withColumn("temperature_label", N.temperature_label(F.col("temperature_percentile_since_2022")))


def loss_subtype() -> Column:
    c = F.col
    tiny = F.when(c("ttm_revenue") > 10000, c("ttm_revenue") < 1000000).otherwise(c("ttm_revenue") < 0.01)
    return (
        F.when(c("book_value_per_share") <= 0, "C4_LIQUIDATION_RISK")
        .when(tiny, "C3_NO_REVENUE_CONCEPT")
        .when((c("gross_margin") >= 0.10) & (c("revenue_yoy") >= 0.20), "C2_GROWTH_LOSS")
        .otherwise("C1_REVENUE_LOSS")
    )


def classify(inputs: DataFrame, threshold: Column) -> DataFrame:
    """Earning class, loss subtype, new-listing flag and the metric a stock is judged on."""
    c = F.col
    earning = F.coalesce(c("ttm_net_profit") > 0, F.lit(False))
    normal = (c("pe_ttm") > 0) & (c("pe_ttm") <= threshold)
    cls = F.when(earning & normal, "A_NORMAL_EARNING").when(earning, "B_THIN_PROFIT_DISTORTED").otherwise("C_LOSS")
    out = inputs.withColumn("classification", cls)
    out = out.withColumn("sub_classification", F.when(c("classification") == "C_LOSS", loss_subtype()))
    metric = (
        F.when(c("classification") == "A_NORMAL_EARNING", "pe_ttm")
        .when(c("classification") == "B_THIN_PROFIT_DISTORTED", "ps_ttm")
        .when(c("sub_classification").isin("C1_REVENUE_LOSS", "C2_GROWTH_LOSS"), "ps_ttm")
    )
    out = out.withColumn("primary_metric", metric)
    return out.select(
        "*",
        F.coalesce(c("listed_days") < spec.NEW_LISTING_SESSIONS, F.lit(False)).alias("is_new_listing"),
        F.concat_ws("|", "primary_metric", "classification", "sub_classification").alias("sample_key"),
        F.when(c("primary_metric") == "pe_ttm", c("pe_ttm")).when(c("primary_metric") == "ps_ttm", c("ps_ttm")).alias("primary_value"),
        T.class_label(c("classification"), c("sub_classification")).alias("classification_label"),
    )


def percentile_samples(classified: DataFrame) -> DataFrame:
    """Sample values as rows (industry, sample_key, value). A normal earner feeds both the PE and the PS sample."""
    c = F.col
    entry = lambda key, value, when: F.when(when & (value > 0), F.struct(key.alias("sample_key"), value.alias("sample_value")))
    a, b = c("classification") == "A_NORMAL_EARNING", c("classification") == "B_THIN_PROFIT_DISTORTED"
    open_loss = c("sub_classification").isin("C1_REVENUE_LOSS", "C2_GROWTH_LOSS")
    entries = F.array(
        entry(F.lit("pe_ttm|A_NORMAL_EARNING"), c("pe_ttm"), a),
        entry(F.lit("ps_ttm|B_THIN_PROFIT_DISTORTED"), c("ps_ttm"), a | b),
        entry(F.concat(F.lit("ps_ttm|C_LOSS|"), c("sub_classification")), c("ps_ttm"), F.coalesce(open_loss, F.lit(False))),
    )
    rows = classified.where(~c("is_new_listing")).select(
        "industry_level_2_name", F.inline(F.filter(entries, lambda x: x.isNotNull())))
    return rows


def member_rows(classified: DataFrame, samples: DataFrame, *, bound: int | None) -> DataFrame:
    """Each member's percentile inside its class sample, with the band shown to users."""
    out = R.sample_percentiles(classified, samples, ["industry_level_2_name", "sample_key"], "primary_value", "sample_value", "primary_percentile", max_group_rows=bound)
    band = F.when(F.col("is_new_listing"), spec.LABEL_NEW_LISTING).otherwise(N.percentile_band(F.col("primary_percentile")))
    return out.withColumn("valuation_band_label", band)


def with_threshold(inputs: DataFrame, snapshot: DataFrame) -> DataFrame:
    return inputs.join(snapshot.select("industry_level_2_name", "pe_invalid_threshold"), "industry_level_2_name", "left")


def classified_members(inputs: DataFrame, snapshot: DataFrame) -> DataFrame:
    return classify(with_threshold(inputs, snapshot), F.col("pe_invalid_threshold"))


def relative_valuation(members: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Final verdict per stock: status, percentile, band, notes and risk flags."""
    c = F.col
    snap = snapshot.select(
        "industry_level_2_name", c("sample_status").alias("_status"), "weighted_pe_ttm", "weighted_ps_ttm", "temperature_label",
        "temperature_percentile_since_2022", "valid_member_count")
    rows = members.join(snap, "industry_level_2_name", "left")
    status = F.when(c("is_new_listing"), "new_listing").otherwise(F.coalesce("_status", F.lit("insufficient")))
    rows = rows.withColumn("sample_status", status)
    rows = rows.withColumn("primary_percentile", F.when(c("sample_status") == "ok", c("primary_percentile")))
    band = (
        F.when(c("sample_status") == "new_listing", spec.LABEL_NEW_LISTING)
        .when(c("sample_status") != "ok", spec.LABEL_SMALL_SAMPLE)
        .otherwise(N.percentile_band(c("primary_percentile")))
    )
    note = F.when(c("classification") == "B_THIN_PROFIT_DISTORTED", spec.NOTE_PS_FALLBACK)
    risks = F.concat_ws(
        "|", F.when(c("is_new_listing"), spec.RISK_NEW_LISTING), F.when(c("primary_percentile") > 80.0, spec.RISK_HIGH_PERCENTILE),
        F.when(c("temperature_label").isin(*spec.HOT_TEMPERATURES), spec.RISK_HOT_INDUSTRY))
    return rows.withColumn("valuation_band_label", band).withColumn("notes", F.coalesce(note, F.lit(""))).withColumn("risk_flags", risks)


def peer_percentiles(classified: DataFrame, samples: DataFrame, *, bound: int | None) -> DataFrame:
    """Every member valued on every sample of its industry; one target's peer table is a filter on its industry and
    sample key. Rows grow with members times the handful of sample keys, never with pairs of members."""
    keys = samples.select("industry_level_2_name", "sample_key").distinct()
    rows = classified.select("market", "symbol", "industry_level_2_name", "current_price", "pe_ttm", "ps_ttm").join(keys, "industry_level_2_name")
    positive = lambda name: F.when(F.col(name) > 0, F.col(name))
    value = F.when(F.col("sample_key").startswith("pe_ttm"), positive("pe_ttm")).otherwise(positive("ps_ttm"))
    out = R.sample_percentiles(rows.withColumn("value", value), samples, ["industry_level_2_name", "sample_key"], "value", "sample_value", "valuation_percentile", max_group_rows=bound)
    return out.withColumn("valuation_band", F.coalesce(N.percentile_band(F.col("valuation_percentile")), F.lit(spec.LABEL_NOT_COMPARABLE)))


def rebuild_incomplete(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keep complete industry rows as they are and take all others from the new build."""
    complete = existing.where(F.col("is_complete"))
    kept = complete.withColumn("origin", F.lit("reused"))
    return kept.unionByName(fresh.join(complete, "industry_level_2_name", "left_anti").withColumn("origin", F.lit("rebuilt")), allowMissingColumns=True)


def completeness(members: DataFrame, samples: DataFrame) -> DataFrame:
    """Per industry: member rows and sample values; complete when members exist and carry a class."""
    m = members.groupBy("industry_level_2_name").agg(F.count(F.lit(1)).alias("member_valuation_row_count"), F.count("classification").alias("_classified"))
    s = samples.groupBy("industry_level_2_name").agg(F.count(F.lit(1)).alias("percentile_sample_count"))
    return m.join(s, "industry_level_2_name", "left").select(
        "industry_level_2_name", "member_valuation_row_count", F.coalesce("percentile_sample_count", F.lit(0)).alias("percentile_sample_count"),
        ((F.col("member_valuation_row_count") > 0) & (F.col("_classified") > 0)).alias("is_complete"))
