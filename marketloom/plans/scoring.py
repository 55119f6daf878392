"""Financial score: raw indicators, percentiles, weighted dimensions, blends, ranks, diagnostics.

Indicators are scored in long form (one row per security and indicator), so the 19 rankings run as 19 groups of one
shuffle instead of 19 sorts of everything, and the way back to one row per security is one conditional aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.operators import ranking as R
from marketloom.plans import statements as X

KEYS = ["market", "symbol"]
DIM_SIZES = {dim: sum(1 for row in spec.SUB_INDICATORS if row[1] == dim) for dim in spec.DIM_WEIGHTS}


def raw_indicators(c=F.col) -> dict[str, Column]:
    """The 19 raw indicators of a statement row. A zero asset item counts as missing, not as a ratio of 0."""
    nz = lambda name: F.nullif(c(name), F.lit(0.0))
    share = lambda name, base: N.ratio(nz(name), c(base)) * 100.0
    derived = {
        "roe_ex": N.ratio(c("ex_net_profit"), c("equity")) * 100.0,
        "ocf_to_profit": N.ratio(c("op_cf"), c("net_profit")),
        "free_cf": c("op_cf") - c("capex"),
        "ar_to_asset": share("ar", "total_assets"),
        "inv_to_asset": share("inventory", "total_assets"),
        "goodwill_ratio": share("goodwill", "total_assets"),
        "impair_to_rev": share("impair_loss", "revenue"),
    }
    return {k: derived[k] if k in derived else c(k) for k in spec.SUB_KEYS}


def with_raw(statements: DataFrame, keep: list[str]) -> DataFrame:
    return statements.select(*keep, *[v.alias(k) for k, v in raw_indicators().items()])


def suppress_financials(wide: DataFrame, sectors=spec.FINANCIAL_SECTORS) -> DataFrame:
    """Banks and other finance have no meaningful turnover and liquidity indicators."""
    sector = F.coalesce(F.col("industry_level_1_name").isin(*sectors), F.lit(False))
    return wide.withColumns({k: F.when(~sector, F.col(k)) for k in spec.FINANCIAL_SUPPRESSED})


def to_long(wide: DataFrame, keep: list[str]) -> DataFrame:
    """One row per security and indicator with the indicator's fixed attributes."""
    entries = [
        F.struct(F.lit(k).alias("sub_key"), F.lit(dim).alias("dim"), F.lit(hb).alias("higher_better"), F.lit(zp).alias("zero_penalty"), F.col(k).alias("raw"))
        for k, dim, hb, zp in spec.SUB_INDICATORS
    ]
    return wide.select(*keep, F.inline(F.array(*entries)))


def market_scores(long: DataFrame, *, bound: int | None, missing_default: float = 50.0) -> DataFrame:
    return R.percentile_scores(long, ["sub_key"], max_group_rows=bound, missing_default=missing_default)


def industry_scores(long: DataFrame, *, bound: int | None, missing_default: float = 50.0) -> DataFrame:
    """Scores inside each industry; a security without industry has none."""
    grouped = long.where(F.col("industry_level_2_name").isNotNull() & (F.col("industry_level_2_name") != ""))
    return R.percentile_scores(grouped, ["sub_key", "industry_level_2_name"], max_group_rows=bound, missing_default=missing_default)


def latest_long(statements: DataFrame, industry: DataFrame, sectors=spec.FINANCIAL_SECTORS) -> DataFrame:
    """Newest statement per security as long indicator rows with its industry, if any."""
    newest = X.latest(statements).join(industry.select(*KEYS, "industry_level_1_name", "industry_level_2_name"), KEYS, "left")
    keep = [*KEYS, "period", "industry_level_1_name", "industry_level_2_name"]
    return to_long(suppress_financials(with_raw(newest, keep), sectors), keep)


def score_table(long: DataFrame, *, bound: int | None) -> DataFrame:
    """Market and industry score next to each raw value, plus the blend of both."""
    market = market_scores(long, bound=bound).withColumnRenamed("score", "market_score")
    inside = industry_scores(long, bound=bound).select(*KEYS, "sub_key", F.col("score").alias("industry_score"))
    return market.join(inside, [*KEYS, "sub_key"], "left").withColumn("blended_score", blend(F.col("dim"), F.col("market_score"), F.col("industry_score")))


def blend(dim: Column, market: Column, industry: Column) -> Column:
    mixed = N.rounded(industry * spec.BLEND_INDUSTRY_SHARE + market * spec.BLEND_MARKET_SHARE, 4)
    return F.when(dim.isin(*spec.BLENDED_DIMS) & industry.isNotNull(), mixed).otherwise(market)


def dim_means(score: str) -> dict[str, Column]:
    """Mean score per dimension as aggregate expressions; a missing score counts as 0 and still divides."""
    out = {}
    for dim, size in DIM_SIZES.items():
        total = F.sum(F.when(F.col("dim") == dim, N.scaled(F.coalesce(F.col(score), F.lit(0.0)), 4)).otherwise(0))
        out[dim] = N.unscaled(total, 4) / size
    return out


def weighted_dims(scored: DataFrame, score: str, prefix: str = "", digits: int | None = 2, by: list[str] = KEYS) -> DataFrame:
    """Six weighted dimension scores and their total per security."""
    aggs = []
    for dim, mean in dim_means(score).items():
        value = mean * spec.DIM_WEIGHTS[dim]
        aggs.append((value if digits is None else N.rounded(value, digits)).alias(prefix + dim))
    wide = scored.groupBy(*by).agg(*aggs)
    return wide.withColumn(prefix + "total_score", total_of(prefix, 2))


def total_of(prefix: str, digits: int) -> Column:
    names = list(spec.DIM_WEIGHTS)
    total = F.col(prefix + names[0])
    for dim in names[1:]:
        total = total + F.col(prefix + dim)
    return N.rounded(total, digits)


def snapshot(scored: DataFrame) -> DataFrame:
    """Score snapshot: market and industry dimensions and totals, one row per security."""
    by = [*KEYS, "period", "industry_level_1_name", "industry_level_2_name"]
    aggs = []
    for prefix, score in (("", "market_score"), ("ind_", "industry_score")):
        aggs += [N.rounded(m * spec.DIM_WEIGHTS[dim], 2).alias(prefix + dim) for dim, m in dim_means(score).items()]
    aggs += [(m * spec.DIM_WEIGHTS[dim]).alias("_blend_" + dim) for dim, m in dim_means("blended_score").items()]
    wide = scored.groupBy(*by).agg(*aggs)
    wide = wide.withColumn("total_score", total_of("", 2)).withColumn("ind_total_score", total_of("ind_", 2))
    wide = wide.withColumn("market_total_score", total_of("_blend_", 4))
    return wide.drop(*["_blend_" + d for d in spec.DIM_WEIGHTS])


def with_ranks(snap: DataFrame, *, bound: int | None) -> DataFrame:
    """Rank and universe size over the market (blended total) and within the industry (industry total)."""
    tie = [F.col("market").asc(), F.col("symbol").asc()]
    one = snap.withColumn("_all", F.lit(1))  # one group, bounded by the security master or ranked by range
    one = R.with_group_stats(one, ["_all"], {"market_total_universe_size": F.count("market_total_score")}, max_group_rows=bound)
    ranked = R.ordinal_rank(one, ["_all"], [F.col("market_total_score").desc_nulls_last(), *tie], "market_total_rank", max_group_rows=bound).drop("_all")
    inside = ["industry_level_2_name"]
    ranked = R.with_group_stats(ranked, inside, {"industry_total_universe_size": F.count("ind_total_score")}, max_group_rows=bound)
    ranked = R.ordinal_rank(ranked, inside, [F.col("ind_total_score").desc_nulls_last(), *tie], "industry_total_rank", max_group_rows=bound)
    known = F.col("industry_level_2_name").isNotNull()
    return ranked.withColumns({c: F.when(known, F.col(c)) for c in ("industry_total_rank", "industry_total_universe_size")})


def industry_raw_means(long: DataFrame) -> DataFrame:
    """Mean raw indicator per industry."""
    known = long.where(F.col("industry_level_2_name").isNotNull() & F.col("raw").isNotNull())
    return known.groupBy("industry_level_2_name", "sub_key").agg(
        (N.unscaled(F.sum(N.scaled(F.col("raw"), 4)), 4) / F.count("raw")).alias("industry_mean"))


def year_ago_columns(statements: DataFrame, columns: list[str]) -> DataFrame:
    return statements.select("*", *[X.steps_back(c, 4).alias(f"{c}_year_ago") for c in columns])


def newest_with_year_ago(statements: DataFrame) -> DataFrame:
    """Newest statement with raw indicators and components of the same period one year earlier."""
    components = sorted({c for row in spec.DRIVERS for c in [row[1]]} | {c for row in spec.DIAGNOSTICS for c in row[3].split(",")})
    wide = statements.select("*", *[v.alias("raw_" + k) for k, v in raw_indicators().items()])
    lagged = year_ago_columns(wide, ["raw_" + k for k in spec.SUB_KEYS] + components)
    return X.latest(lagged)


def indicator_rows(newest: DataFrame) -> DataFrame:
    """Every indicator of a security now and a year ago, one row each."""
    entries = [F.struct(F.lit(k).alias("sub_key"), F.col("raw_" + k).alias("current_value"), F.col(f"raw_{k}_year_ago").alias("previous_value")) for k in spec.SUB_KEYS]
    return newest.select(*KEYS, F.inline(F.array(*entries)))


def diagnostics(newest: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per security and indicator: change against last year, template, scores, trend and evidence."""
    entries = []
    for k, label, template, components, suffix, lower in spec.DIAGNOSTICS:
        strength, validate = spec.EVIDENCE[template]
        now, ago = (F.array(*[F.col(c + end).cast("double") for c in components.split(",")]) for end in ("", "_year_ago"))
        entries.append(F.struct(
            F.lit(k).alias("sub_key"), F.lit(label).alias("indicator_name"), F.lit(template).alias("template_type"), F.lit(suffix).alias("suffix"),
            F.lit(lower).alias("lower_is_better"), F.lit(strength).alias("evidence_strength"), F.lit(validate).alias("needs_text_validation"),
            F.col("raw_" + k).alias("current_value"), F.col(f"raw_{k}_year_ago").alias("previous_value"),
            F.lit(components).alias("components"), now.alias("component_values"), ago.alias("previous_component_values")))
    long = newest.select(*KEYS, "period", F.inline(F.array(*entries)))
    c = F.col
    long = long.withColumn("delta_value", c("current_value") - c("previous_value")).withColumn(
        "trend", N.trend(c("current_value"), c("previous_value"), c("lower_is_better")))
    scores = scored.select(*KEYS, "sub_key", c("blended_score").alias("market_score"), "industry_score")
    return long.join(scores, [*KEYS, "sub_key"], "left")


def driver_triplets(newest: DataFrame) -> DataFrame:
    """Main, secondary and hedge driver per indicator.

    At most three drivers per indicator, so they are ordered inside a small array per row and nothing is shuffled.
    """
    rows = []
    for k in dict.fromkeys(r[0] for r in spec.DRIVERS):
        now, before = F.col("raw_" + k), F.col(f"raw_{k}_year_ago")
        drivers = []
        for no, (_k, component, sensitivity, label, up, down) in enumerate(r for r in spec.DRIVERS if r[0] == k):
            cur, prev = F.col(component), F.col(f"{component}_year_ago")
            delta = cur - prev
            weight = F.coalesce(N.ratio(F.abs(delta), F.abs(prev)), F.abs(delta))
            word = F.when(delta > 0, label + up).when(delta < 0, label + down).otherwise(label + spec.DRIVER_FLAT)
            drivers.append(F.when(delta.isNotNull(), F.struct(
                (-weight).alias("w"), F.lit(no).alias("no"), (F.signum(delta).cast("int") * sensitivity).alias("effect"), word.alias("fragment"))))
        rows.append(F.struct(F.lit(k).alias("sub_key"), F.signum(now - before).cast("int").alias("direction"), F.array(*drivers).alias("drivers")))
    long = newest.select(*KEYS, "period", F.inline(F.array(*rows))).where(F.col("direction") != 0)
    pick = lambda test: F.array_sort(F.filter("drivers", lambda x: x.isNotNull() & test(x)))
    long = long.select(
        *KEYS, "period", "sub_key", pick(lambda x: x["effect"] == F.col("direction")).alias("aligned"),
        pick(lambda x: x["effect"] == -F.col("direction")).alias("opposing"), pick(lambda x: x["effect"] == 0).alias("neutral"))
    nth = lambda name, i: F.get(F.col(name), F.lit(i))["fragment"]
    fall = spec.DRIVER_FALLBACKS
    return long.select(
        *KEYS, "period", "sub_key", F.coalesce(nth("aligned", 0), F.lit(fall["main"])).alias("main_driver"),
        F.coalesce(nth("aligned", 1), nth("neutral", 0), F.lit(fall["secondary"])).alias("secondary_driver"),
        F.coalesce(nth("opposing", 0), F.lit(fall["hedge"])).alias("hedge_driver"))


def report_points(newest: DataFrame, scored: DataFrame) -> DataFrame:
    """Strength and risk codes per security, at most four of each, in fixed order of importance."""
    wanted = ("roe_ex", "profit_growth", "ocf_to_profit", "free_cf", "debt_ratio", "goodwill_ratio", "current_ratio", "asset_turn")
    scores = scored.groupBy(*KEYS).agg(*[F.coalesce(F.max(F.when(F.col("sub_key") == k, F.col("blended_score"))), F.lit(0.0)).alias("s_" + k) for k in wanted])
    rows = newest.join(scores, KEYS)
    s, raw = (lambda k: F.col("s_" + k)), (lambda k: F.col("raw_" + k))
    yoy = lambda k: N.yoy_pct(raw(k), F.col(f"raw_{k}_year_ago"))
    trio = ("roe_ex", "profit_growth", "ocf_to_profit")
    strengths = [
        F.when(s("roe_ex") >= 75, "roe_ex_strong"), F.when(s("profit_growth") >= 75, "profit_growth_strong"),
        F.when(s("ocf_to_profit") >= 70, "cash_conversion_strong"), F.when(s("free_cf") >= 80, "free_cash_strong"),
        *[F.when(yoy(k) >= 20, k + "_improved") for k in trio],
    ]
    risks = [
        F.when(raw("debt_ratio") >= 60, "debt_ratio_high").when(s("debt_ratio") <= 30, "debt_ratio_weak"),
        F.when(s("goodwill_ratio") <= 30, "goodwill_weak"), F.when(s("current_ratio") <= 35, "current_ratio_weak"),
        F.when(s("asset_turn") <= 40, "asset_turn_weak"), *[F.when(yoy(k) <= -20, k + "_declined") for k in trio],
    ]

    def four(items: list[Column], kind: str) -> Column:
        hits = F.slice(F.filter(F.array(*items), lambda x: x.isNotNull()), 1, 4)
        hits = F.when(F.size(hits) == 0, F.array(F.lit("none"))).otherwise(hits)
        return F.transform(hits, lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("bigint").alias("position"), x.alias("code")))

    return rows.select(*KEYS, "period", F.inline(F.concat(four(strengths, "strength"), four(risks, "risk"))))


def peer_benchmark(newest: DataFrame, industry: DataFrame, sub_key: str, *, bound: int | None) -> DataFrame:
    """Every industry's members ordered by one indicator, best first, with the indicator's components now and a year
    ago. The peer table of one security is a filter on its industry."""
    meta = next(r for r in spec.SUB_INDICATORS if r[0] == sub_key)
    components = next(r[3] for r in spec.DIAGNOSTICS if r[0] == sub_key).split(",")
    value = F.col("raw_" + sub_key)
    rows = newest.join(industry.select(*KEYS, "industry_level_2_name"), KEYS).select(
        *KEYS, "industry_level_2_name", "report_date", (F.col("report_date") - 10000).alias("previous_report_date"), value.alias("metric_value"),
        *[F.col(c).alias(c) for c in components], *[F.col(f"{c}_year_ago") for c in components])
    best = F.col("metric_value").desc_nulls_last() if meta[2] else F.col("metric_value").asc_nulls_last()
    return R.ordinal_rank(rows, ["industry_level_2_name"], [best, F.col("market").asc(), F.col("symbol").asc()], "position", max_group_rows=bound)


INPUTS = 4  # components of an indicator, at most


def peer_tables(newest: DataFrame, industry: DataFrame, securities: DataFrame, closes: DataFrame, *, bound: int | None, sub_keys: list[str] | None = None) -> DataFrame:
    """The peer tables of all indicators, or some: every industry's members per indicator, best first, with name, latest price and the
    indicator's components now and a year ago (``input_1`` ... in the order in which the indicator names them). One table is a filter."""
    directions = {r[0]: r[2] for r in spec.SUB_INDICATORS}
    components = {r[0]: r[3].split(",") for r in spec.DIAGNOSTICS}
    none = F.lit(None).cast("double")

    def row(key: str) -> Column:
        own = [F.col(c).cast("double") for c in components[key]][:INPUTS]
        past = [F.col(f"{c}_year_ago").cast("double") for c in components[key]][:INPUTS]
        value = F.col("raw_" + key).cast("double")
        fill = lambda some: some + [none] * (INPUTS - len(some))
        return F.struct(
            F.lit(key).alias("sub_key"), value.alias("metric_value"), (-value if directions[key] else value).alias("_best"),
            *[x.alias(f"input_{i}") for i, x in enumerate(fill(own), 1)], *[x.alias(f"input_{i}_year_ago") for i, x in enumerate(fill(past), 1)])

    keys = [k for k in directions if k in components and (sub_keys is None or k in sub_keys)]
    rows = newest.join(industry.select(*KEYS, "industry_level_2_name"), KEYS).select(
        *KEYS, "industry_level_2_name", "report_date", (F.col("report_date") - 10000).alias("previous_report_date"), F.inline(F.array(*[row(k) for k in keys])))
    order = [F.col("_best").asc_nulls_last(), F.col("market").asc(), F.col("symbol").asc()]
    ranked = R.ordinal_rank(rows, ["industry_level_2_name", "sub_key"], order, "position", max_group_rows=bound).drop("_best")
    names = securities.select(*KEYS, "stock_name").join(closes.select(*KEYS, "current_price"), KEYS, "left")
    return ranked.join(names, KEYS, "left").withColumn("stock_name", F.coalesce("stock_name", "symbol"))


def total_benchmark(snap: DataFrame, valuation: DataFrame, *, bound: int | None) -> DataFrame:
    """Members of each industry by industry total, with un-weighted dimension scores and valuation columns."""
    rows = snap.where(F.col("industry_level_2_name").isNotNull()).select(
        *KEYS, "industry_level_2_name", F.col("ind_total_score").alias("total_score"),
        *[N.rounded(F.col("ind_" + d) / w, 4).alias("score_" + d) for d, w in spec.DIM_WEIGHTS.items()])
    rows = rows.join(valuation.select(*KEYS, "current_price", "total_market_cap", "free_float_market_cap", "pe_ttm", "ps_ttm"), KEYS, "left")
    order = [F.col("total_score").desc_nulls_last(), F.col("market").asc(), F.col("symbol").asc()]
    return R.ordinal_rank(rows, ["industry_level_2_name"], order, "position", max_group_rows=bound)


REPORT_METRICS = ("revenue", "net_profit", "ex_net_profit", "op_cf", "roe_ex", "debt_ratio", "current_ratio", "quick_ratio",
                  "profit_growth", "revenue_growth", "ex_profit_growth", "ocf_to_profit", "free_cf")


def report_timeline(statements: DataFrame, years: int = 3) -> DataFrame:
    raw = raw_indicators()
    rows = X.recent_reports(statements, years)
    metrics = [(raw[m] if m in raw else F.col(m)).alias(m) for m in REPORT_METRICS]
    return rows.select(*KEYS, "period", "report_date", "announce_date", *metrics)
