"""Momentum ranks and the rule signals built on them.

``daily`` frames rank every trading day among the symbols that traded; ``latest`` frames take each symbol's last
session and rank once, as of one day. Both run the same expressions: lags inside a symbol, ranks inside a day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.functions import numeric as N
from marketloom.functions import text as T
from marketloom.operators import ranking as R
from marketloom.operators import rolling as L

SESSIONS_NEEDED = max(spec.RPS_WINDOWS) + 10


def in_universe(df: DataFrame) -> DataFrame:
    return df.where(F.col("market").isin(*spec.RPS_MARKETS) & T.starts_with_any(F.col("symbol"), spec.RPS_PREFIXES))


def any_return(windows=spec.RPS_WINDOWS) -> Column:
    return F.coalesce(*[F.col(f"return_{n}_pct") for n in windows]).isNotNull()


def latest_returns(bars: DataFrame, as_of: Column, windows=spec.RPS_WINDOWS) -> DataFrame:
    """Each symbol's returns at its last session.

    Only the newest sessions reach the shuffle, and looking ahead in newest-first order keeps the one sort they need.
    """
    recent = L.tail(bars.select("market", "symbol", "trading_day", "close"), max(windows) + 1)
    newest = L.newest_first()
    rows = recent.select(
        "market", "symbol", F.row_number().over(newest).alias("_rn"),
        *[N.rounded(N.return_pct(F.col("close"), F.lead("close", n).over(newest)), 4).alias(f"return_{n}_pct") for n in windows])
    return rows.where((F.col("_rn") == 1) & any_return(windows)).select(
        as_of.alias("trading_day"), "market", "symbol", *[f"return_{n}_pct" for n in windows])


def rps_table(bars: DataFrame, as_of: Column, *, bound: int | None) -> DataFrame:
    """Momentum table of the universe: returns, ranks and RPS per window."""
    returns = latest_returns(in_universe(bars), as_of)
    return R.momentum_ranks(returns, spec.RPS_WINDOWS, max_group_rows=bound)


def daily_rps(bars: DataFrame, windows=spec.RPS_WINDOWS, *, bound: int | None, rows: int | None = None) -> DataFrame:
    """Momentum table of every trading day."""
    returns = L.with_returns(bars.select("market", "symbol", "trading_day", "close"), windows).where(any_return(windows))
    return R.momentum_ranks(returns.drop("close"), windows, max_group_rows=bound, rows=rows)


def reference_returns(bars: DataFrame) -> DataFrame:
    """Unrounded returns as of earlier sessions; short histories drop out."""
    refs = [(20, 1), (20, 2), (20, 3), (50, 3), (50, 5)]
    value = {(n, k): N.rolling_return_pct(L.lagged("close", k), L.lagged("close", n + k)) for n, k in refs}
    return bars.select(
        "market", "symbol", "trading_day",
        F.row_number().over(L.by_day()).alias("sessions"),
        *[v.alias(f"ref{k}_return_{n}_pct") for (n, k), v in value.items()],
    ).where(F.col("sessions") >= spec.SIGNAL_MIN_SESSIONS)


def reference_rps(returns: DataFrame, *, bound: int | None, rows: int | None = None) -> DataFrame:
    """RPS as of t-1, t-2, t-3 and t-5 among the symbols that have that return."""
    refs = ((20, 1), (20, 2), (20, 3), (50, 3), (50, 5))
    sizes = {f"_n{k}_{n}": F.count(f"ref{k}_return_{n}_pct") for n, k in refs}
    placed = R.small_parts(returns, ["trading_day"], rows) if R.fits_one_task(bound) else returns
    out = R.with_group_stats(placed, ["trading_day"], sizes, max_group_rows=bound)
    for n, k in refs:
        value = F.col(f"ref{k}_return_{n}_pct")
        order = [value.desc_nulls_last(), F.col("symbol").asc(), F.col("market").asc()]
        out = R.ordinal_rank(out, ["trading_day"], order, "_rk", max_group_rows=bound)
        out = out.withColumn(f"ref{k}_rps_{n}", F.when(value.isNotNull(), R.rps(F.col("_rk"), F.col(f"_n{k}_{n}")))).drop("_rk")
    return out.drop(*sizes)


def _all(*conditions: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def launch_conditions(rule: spec.SignalRule = spec.STANDARD_LAUNCH) -> dict[str, Column]:
    c = F.col
    return {
        "rps_base": _all(*[c(f"rps_{n}") >= v for n, v in rule.base.items()]),
        "rps_structure": _all(c("rps_20") > c("rps_50"), c("rps_50") >= c("rps_120") - 3, c("rps_120") >= c("rps_250") - 5),
        "rps_turning_point": _all(c("rps_20") > c("ref3_rps_20"), c("rps_50") > c("ref5_rps_50")),
        "trend_confirmed": _all(
            c("close") > c("ma_20"), c("ma_20") > c("ma_50"), c("ma_50") >= c("ma_50_ago5"), c("ma_120").isNotNull()),
        rule.volume_name: _all(c("volume") > rule.volume_factor * c("volume_ma_5")),
    }


def attack_conditions(rule: spec.SignalRule = spec.ATTACK) -> dict[str, Column]:
    c = F.col
    return {
        "rps_base": _all(*[c(f"rps_{n}") >= v for n, v in rule.base.items()]),
        "rps_acceleration": _all(
            c("rps_20") > c("ref1_rps_20"), c("ref1_rps_20") > c("ref2_rps_20"), c("rps_50") > c("ref3_rps_50")),
        "rps_structure": _all(c("rps_20") > c("rps_50"), c("rps_120") >= c("rps_250") - 8),
        "trend_confirmed": _all(c("close") > c("ma_20"), c("close") > c("ma_50"), c("ma_50") > c("ma_50_ago3")),
        rule.volume_name: _all(c("volume") > rule.volume_factor * c("volume_ma_5")),
    }


CONDITIONS = {
    spec.STANDARD_LAUNCH.strategy: (spec.STANDARD_LAUNCH, launch_conditions),
    spec.ATTACK.strategy: (spec.ATTACK, attack_conditions),
}


def signal_inputs(bars: DataFrame, *, bound: int | None, as_of: Column | None = None, rows: int | None = None) -> DataFrame:
    """One row per symbol and ranked day with everything the rules read.

    With ``as_of`` only each symbol's last session is kept and ranked as that day.
    """
    uni = in_universe(bars)
    if as_of is not None:
        uni = L.tail(uni, SESSIONS_NEEDED)
    frames = L.with_moving_averages(
        uni.select("market", "symbol", "trading_day", "close", "volume"),
        [("close", 20, 0, "ma_20"), ("close", 50, 0, "ma_50"), ("close", 120, 0, "ma_120"), ("close", 50, 5, "ma_50_ago5"),
         ("close", 50, 3, "ma_50_ago3"), ("volume", 5, 0, "volume_ma_5")],
    )
    refs = [(20, 1), (20, 2), (20, 3), (50, 3), (50, 5)]
    days = frames.select(
        "*",
        *[L.session_return(n).alias(f"return_{n}_pct") for n in spec.RPS_WINDOWS],
        *[N.rolling_return_pct(L.lagged("close", k), L.lagged("close", n + k)).alias(f"ref{k}_return_{n}_pct") for n, k in refs],
        F.row_number().over(L.by_day()).alias("sessions"),
    )
    if as_of is not None:
        days = L.latest(days).withColumn("trading_day", as_of)
    short = F.col("sessions") < spec.SIGNAL_MIN_SESSIONS
    for n, k in refs:
        name = f"ref{k}_return_{n}_pct"
        days = days.withColumn(name, F.when(~short, F.col(name)))
    ranked = R.momentum_ranks(days.where(any_return()), spec.RPS_WINDOWS, max_group_rows=bound, rows=rows)
    return reference_rps(ranked, bound=bound)


def signal_rows(inputs: DataFrame, strategy: str, *, candidates_only: bool = True) -> DataFrame:
    """Condition flags and verdict per candidate; a candidate already meets base and structure."""
    rule, build = CONDITIONS[strategy]
    conditions = build()
    flags = inputs.select(
        "trading_day", "market", "symbol", F.lit(rule.strategy).alias("strategy"), F.lit(rule.label).alias("strategy_label"),
        *[c.alias(name) for name, c in conditions.items()],
    )
    if candidates_only:
        flags = flags.where(F.col("rps_base") & F.col("rps_structure"))
    return flags.withColumn("passed", reduce(lambda a, b: a & b, [F.col(n) for n in conditions]))


def with_condition_map(rows: DataFrame, strategy: str) -> DataFrame:
    """Edge form: the flags as one map column."""
    names = list(CONDITIONS[strategy][1]())
    entries = [x for n in names for x in (F.lit(n), F.col(n))]
    return rows.select(
        "trading_day", "market", "symbol", "strategy", "strategy_label", "passed", F.create_map(*entries).alias("conditions"))


def self_rps_history(bars: DataFrame, windows=spec.RPS_WINDOWS, frame: int = spec.RPS_SELF_WINDOW) -> DataFrame:
    """Per symbol: rolling returns and the share of the last ``frame`` returns below today's."""
    rows = bars.select("market", "symbol", "trading_day", "close")
    rows = rows.select(
        "*", *[N.rolling_return_pct(F.col("close"), L.lagged("close", n)).alias(f"raw_{n}") for n in windows])
    rows = L.with_self_percentiles(rows, {f"raw_{n}": f"rps_{n}" for n in windows}, frame)
    return rows.select(
        "market", "symbol", "trading_day", *[f"rps_{n}" for n in windows],
        *[N.rounded(F.col(f"raw_{n}"), 4).alias(f"return_{n}_pct") for n in windows])


def search_rankings(rps: DataFrame, securities: DataFrame, query: str = "", window: int = 20, limit: int = 20) -> DataFrame:
    """Ranking table narrowed by a text query, best rank first."""
    if window not in spec.RPS_WINDOWS:
        raise ValueError(f"unsupported window: {window}")
    named = rps.join(securities, ["market", "symbol"], "left")
    if query.strip():
        named = named.where(T.match_tier(F.col("symbol"), F.col("stock_name"), F.col("name_initials"), F.lit(query)).isNotNull())
    rows = named.where(F.col(f"rank_{window}").isNotNull() & F.col(f"rps_{window}").isNotNull()).select(
        "market", "symbol", "stock_name", F.col(f"rank_{window}").alias("rank"), F.col(f"rps_{window}").alias("rps"),
        F.col(f"return_{window}_pct").alias("return_pct"))
    return rows.orderBy("rank", F.col("rps").desc(), "symbol", "market").limit(limit)


def pool_filter(
    securities: DataFrame, industry: DataFrame, concepts: DataFrame, rps: DataFrame, *,
    level1: list[str] = (), level2: list[str] = (), concept_names: list[str] = (), limit: int = 100,
) -> DataFrame:
    """Securities in any of the chosen industries and concepts, ordered by their RPS, with the size of the pool before ``limit``."""
    keys = ["market", "symbol"]
    pool = securities.select(*keys, "stock_name")
    if level1:
        pool = pool.join(industry.where(F.col("industry_level_1_name").isin(*level1)), keys, "left_semi")
    if level2:
        pool = pool.join(industry.where(F.col("industry_level_2_name").isin(*level2)), keys, "left_semi")
    if concept_names:
        pool = pool.join(concepts.where(F.col("concept_name").isin(*concept_names)), keys, "left_semi")
    sort_key = F.coalesce(F.col("rps_20"), F.col("rps_50"), F.lit(-1.0))
    cols = [f"rps_{n}" for n in spec.RPS_WINDOWS] + [f"return_{n}_pct" for n in spec.RPS_WINDOWS]
    size = pool.agg(F.count(F.lit(1))).scalar()
    return (
        pool.join(rps.select(*keys, *cols), keys, "left")
        .select("market", "symbol", "stock_name", *cols, sort_key.alias("sort_key"), size.alias("pool_size"))
        .orderBy(F.col("sort_key").desc(), "market", "symbol")
        .limit(limit)
    )


def merge_strategy(existing: DataFrame, strategy: str, rows: DataFrame) -> DataFrame:
    """Replace one strategy's rows and keep all others."""
    return existing.where(F.trim("strategy") != strategy).unionByName(rows)


def strategy_is_stale(strategies: DataFrame, source: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Per strategy: must its table be rebuilt? It must if it was built before the newest source row, or if it is not there at all.

    ``strategies`` has ``strategy, generated_at``, ``source`` has ``generated_at``; ``wanted`` names strategies that must exist.
    """
    built = strategies.groupBy("strategy").agg(F.max("generated_at").alias("built_at"))
    if wanted is not None:
        names = strategies.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in wanted])).alias("strategy"))
        built = names.join(built, "strategy", "left")
    newest = source.agg(F.max("generated_at")).scalar()
    return built.withColumn("source_at", newest).withColumn("is_stale", F.col("built_at").isNull() | F.coalesce(F.col("built_at") < F.col("source_at"), F.lit(False)))
