"""The equity model projected onto the star-schema tables.

Suppliers stand for securities, line items for trades and statement lines, events for ticks. Every projection reads
only the columns it needs. Lines hardly repeat a grouping key inside one input split, so they are not combined before the
shuffle: a hash table over a split grows with the split. They go to their group in tasks of a fixed number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import numeric as N
from marketloom.functions import periods as P
from marketloom.functions import text as T
from marketloom.operators import ranking as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: Column) -> Column:
    text = key.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def market_of(key: Column) -> Column:
    return F.when(key % 3 == 0, "sz").when(key % 3 == 1, "sh").otherwise("bj")


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        market_of(F.col("s_suppkey")).alias("market"),
        symbol_of(F.col("s_suppkey")).alias("symbol"),
        F.col("s_name").alias("stock_name"),
        F.lower(F.concat(F.substring("s_name", 1, 1), F.right("s_name", F.lit(4)))).alias("name_initials"),
    )


def universe_bound(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the security master: no cross-section of one day can be larger. Answered from file footers."""
    return table(spark, sf_dir, "supplier").count()


def line_bound(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the trades: there are no more daily bars or statements. Answered from file footers."""
    return table(spark, sf_dir, "lineitem").count()


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    code = F.concat(F.lit("X"), F.lpad(F.col("r_regionkey").cast("string"), 2, "0"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            market_of(F.col("s_suppkey")).alias("market"),
            symbol_of(F.col("s_suppkey")).alias("symbol"),
            code.alias("industry_level_1_code"),
            F.col("r_name").alias("industry_level_1_name"),
            F.concat(code, F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("industry_level_2_code"),
            F.col("n_name").alias("industry_level_2_name"),
        )
    )


def region_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarser grouping for valuation, whose samples need at least ten valid members."""
    return industry(spark, sf_dir).select(
        "market", "symbol",
        F.lit("ALL").alias("industry_level_1_name"),
        F.col("industry_level_1_name").alias("industry_level_2_name"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: one row per symbol and day with trades."""
    unit = F.try_divide("l_extendedprice", "l_quantity")  # a line without quantity has no price
    trades = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("trading_day"), "l_orderkey", "l_linenumber", "l_partkey",
        unit.alias("unit"),
        N.scaled(F.col("l_extendedprice"), 2).alias("cents"), N.scaled(F.col("l_quantity"), 0).alias("qty"),
    )
    trades = R.small_parts(trades, ["l_suppkey", "trading_day"], line_bound(spark, sf_dir))
    daily = trades.groupBy("l_suppkey", "trading_day").agg(
        F.min_by("unit", F.struct("l_orderkey", "l_linenumber", "l_partkey", "unit")).alias("open"),
        F.max("unit").alias("high"),
        F.min("unit").alias("low"),
        F.sum("cents").alias("cents"),
        F.sum("qty").alias("qty"),
    )
    amount = N.unscaled(F.col("cents"), 2)
    return daily.select(
        market_of(F.col("l_suppkey")).alias("market"),
        symbol_of(F.col("l_suppkey")).alias("symbol"),
        "trading_day", "open", "high", "low",
        F.try_divide(amount, F.col("qty").cast("double")).alias("close"),
        F.col("qty").alias("volume"),
        amount.alias("amount"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday points: price, lots and turnover per event."""
    price, volume = F.col("value"), F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.lit("sh").alias("market"),
        F.col("event_type").alias("symbol"),
        F.col("user_id"),
        F.to_date("ts").alias("trading_day"),
        "ts", "event_id",
        price.alias("price"),
        volume.alias("volume"),
        N.scaled(price * volume * 100.0, 2).alias("amount_cents"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements: one row per code and reporting period."""
    e, d, t, q = (N.scaled(F.col(c), n) for c, n in (
        ("l_extendedprice", 2), ("l_discount", 2), ("l_tax", 2), ("l_quantity", 0)))
    bound = line_bound(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"),
        F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        "l_extendedprice", "l_discount", "l_tax", "l_quantity",
    )
    lines = R.small_parts(lines, ["l_suppkey", "y", "q"], bound).select(
        "l_suppkey", "y", "q", "day", "flag", "status",
        e.alias("e"), (e * (100 - d)).alias("r"), (e * d).alias("ed"), (e * t).alias("et"), q.alias("qty"),
    )

    def total(column: str, where: Column | None = None) -> Column:
        """Sums in 38 digits: a symbol with a large share of all lines does not fit 64 bits."""
        value = F.col(column).cast("decimal(38,0)")
        return F.sum(value) if where is None else F.sum(F.when(where, value).otherwise(F.lit(0).cast("decimal(38,0)")))

    flag, status = F.col("flag"), F.col("status")
    s = lines.groupBy("l_suppkey", "y", "q").agg(
        total("r").alias("r"), total("r", flag == "R").alias("r_r"), total("r", flag == "A").alias("r_a"),
        total("r", flag == "N").alias("r_n"), total("et").alias("et"), total("et", flag == "R").alias("et_r"),
        total("e").alias("e"), total("e", status == "F").alias("e_f"), total("e", status == "O").alias("e_o"),
        total("e", flag == "N").alias("e_n"), total("ed").alias("ed"), total("ed", flag == "R").alias("ed_r"),
        total("qty").alias("qty"), F.max("day").alias("announced"),
    )

    def over(expr: Column, divisor: float) -> Column:
        return expr.cast("double") / divisor

    c = F.col
    s = s.select(
        market_of(c("l_suppkey")).alias("market"), symbol_of(c("l_suppkey")).alias("symbol"),
        P.period_label(c("y"), c("q")).alias("period"),
        (c("y") * 10 + c("q")).alias("period_ord"), (c("y") * 4 + c("q") - 1).alias("period_idx"),
        # Integer arithmetic on the grouping keys: a filter on it is pushed below the aggregate at no cost.
        (c("y") * 10000 + F.element_at(F.array(*[F.lit(x) for x in P.QUARTER_ENDS]), c("q"))).alias("report_date"),
        (F.year("announced") * 10000 + F.month("announced") * 100 + F.day("announced")).alias("announce_date"),
        over(c("r"), 1e4).alias("revenue"),
        over(6 * (c("r") - c("r_r")) - 10 * c("r_r"), 1e5).alias("net_profit"),
        over(9 * (6 * (c("r") - c("r_r")) - 10 * c("r_r")), 1e6).alias("ex_net_profit"),
        over(10 * c("r_a") + 3 * c("r_n") - 2 * c("r_r"), 1e5).alias("op_cf"),
        over(c("et"), 1e4).alias("capex"), over(c("e"), 1e2).alias("total_assets"),
        over(c("e_f"), 1e2).alias("total_debt"), over(10 * c("e_o") - 8 * c("e_f"), 1e3).alias("equity"),
        over(c("e_n"), 1e2).alias("ar"), (c("qty").cast("double") * 100.0).alias("inventory"),
        over(c("et_r"), 1e4).alias("goodwill"), over(c("ed_r"), 1e4).alias("impair_loss"),
        over(7 * c("e"), 1e3).alias("op_cost"), over(c("ed"), 1e4).alias("current_liab"),
        c("qty").cast("double").alias("total_shares"),
    )
    s = s.select("*", (c("ar") + c("inventory")).alias("current_assets"), (c("total_shares") * 0.6).alias("free_float_shares"))
    s = s.select(
        "*",
        N.ratio(c("equity"), c("total_shares")).alias("bvps"),
        N.ratio(c("net_profit"), c("total_shares")).alias("eps"),
        (N.ratio(c("net_profit"), c("revenue")) * 100.0).alias("net_margin"),
        (N.ratio(c("net_profit"), c("equity")) * 100.0).alias("roe_pct"),
        (N.ratio(c("ar"), c("revenue")) * 90.0).alias("ar_days"),
        (N.ratio(c("inventory"), c("op_cost")) * 90.0).alias("inv_days"),
        N.ratio(c("revenue"), c("total_assets")).alias("asset_turn"),
        N.ratio(c("op_cf"), c("revenue")).alias("ocf_to_rev"),
        (N.ratio(c("total_debt"), c("total_assets")) * 100.0).alias("debt_ratio"),
        N.ratio(c("current_assets"), c("current_liab")).alias("current_ratio"),
        N.ratio(c("current_assets") - c("inventory"), c("current_liab")).alias("quick_ratio"),
        (N.ratio(c("revenue") - c("op_cost"), c("revenue")) * 100.0).alias("gross_margin_pct"),
    )
    s = R.small_parts(s, ["market", "symbol"], bound)
    # The same period one year earlier is exactly four steps back on the dense index; gaps give NULL.
    year_ago = W.partitionBy("market", "symbol").orderBy("period_idx").rangeBetween(-4, -4)
    return s.select(
        "*",
        *[N.yoy_pct(c(k), F.max(k).over(year_ago)).alias(out) for k, out in (
            ("revenue", "revenue_growth"), ("net_profit", "profit_growth"), ("ex_net_profit", "ex_profit_growth"))],
    )


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (security, concept) memberships, in tasks of a fixed size by security.

    Distinct pairs come first: a part then has no more rows than there are securities, a security no more than there are parts.
    """
    bound = line_bound(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    li = R.small_parts(R.small_parts(li, ["l_suppkey", "l_partkey"], bound).distinct(), ["l_partkey"], bound)
    name = F.concat_ws(" ", "p_brand", "p_type", F.col("p_size").cast("string"))
    part = table(spark, sf_dir, "part").select("p_partkey", name.alias("concept_name"))
    named = li.join(part, li.l_partkey == part.p_partkey).select(
        market_of(F.col("l_suppkey")).alias("market"), symbol_of(F.col("l_suppkey")).alias("symbol"), "concept_name")
    return R.small_parts(named, ["market", "symbol"], bound).distinct()
