"""SQL text of the shared model views, prepended to each query's own text by need."""

from __future__ import annotations

import re

from marketloom import spec


def sql_round(expr: str, digits: int) -> str:
    """Half-even rounding of a double; the cast to BIGINT rounds half-even."""
    return f"(CAST(({expr}) * {10**digits}.0::DOUBLE AS BIGINT) / {10**digits}.0::DOUBLE)"


def sql_round_wide(expr: str, digits: int) -> str:
    """The same for values that may not fit a BIGINT once scaled: doubles of that size are whole numbers already."""
    scaled = f"(({expr}) * {10**digits}.0::DOUBLE)"
    return f"((CASE WHEN abs({scaled}) < 9007199254740992.0 THEN CAST(CAST({scaled} AS BIGINT) AS DOUBLE) ELSE {scaled} END) / {10**digits}.0::DOUBLE)"


def sql_scaled(expr: str, digits: int) -> str:
    return f"CAST(({expr}) * {10**digits}.0::DOUBLE AS BIGINT)"


def sql_symbol(key: str) -> str:
    t = f"CAST({key} AS VARCHAR)"
    return f"CASE WHEN length({t}) < 6 THEN lpad({t}, 6, '0') ELSE {t} END"


def sql_market(key: str) -> str:
    return f"CASE {key} % 3 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE 'bj' END"


def _growth(column: str, out: str) -> str:
    return f"({column} - {column}_y) / nullif(abs({column}_y), 0) * 100.0 AS {out}"


RATIO_COLUMNS = """
  equity / nullif(total_shares, 0) AS bvps, net_profit / nullif(total_shares, 0) AS eps,
  net_profit / nullif(revenue, 0) * 100.0 AS net_margin, net_profit / nullif(equity, 0) * 100.0 AS roe_pct,
  ar / nullif(revenue, 0) * 90.0 AS ar_days, inventory / nullif(op_cost, 0) * 90.0 AS inv_days,
  revenue / nullif(total_assets, 0) AS asset_turn, op_cf / nullif(revenue, 0) AS ocf_to_rev,
  total_debt / nullif(total_assets, 0) * 100.0 AS debt_ratio,
  current_assets / nullif(current_liab, 0) AS current_ratio,
  (current_assets - inventory) / nullif(current_liab, 0) AS quick_ratio,
  (revenue - op_cost) / nullif(revenue, 0) * 100.0 AS gross_margin_pct"""

VIEWS: dict[str, str] = {
    "securities": f"""SELECT {sql_market('s_suppkey')} AS market, {sql_symbol('s_suppkey')} AS symbol,
  s_name AS stock_name, lower(substr(s_name, 1, 1) || right(s_name, 4)) AS name_initials FROM supplier""",
    "industry": f"""SELECT {sql_market('s_suppkey')} AS market, {sql_symbol('s_suppkey')} AS symbol,
  'X' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS industry_level_1_code, r_name AS industry_level_1_name,
  'X' || lpad(CAST(r_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS industry_level_2_code,
  n_name AS industry_level_2_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "region_industry": """SELECT market, symbol, 'ALL' AS industry_level_1_name,
  industry_level_1_name AS industry_level_2_name FROM industry""",
    "daily_trades": """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS trading_day,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  sum(CAST(l_extendedprice * 100.0::DOUBLE AS BIGINT)) AS cents, sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM lineitem GROUP BY 1, 2""",
    "bars": f"""SELECT {sql_market('l_suppkey')} AS market, {sql_symbol('l_suppkey')} AS symbol, trading_day, open, high, low,
  (CAST(cents AS DOUBLE) / 100.0::DOUBLE) / CAST(qty AS DOUBLE) AS close, CAST(qty AS BIGINT) AS volume,
  CAST(cents AS DOUBLE) / 100.0::DOUBLE AS amount FROM daily_trades""",
    "ticks": """SELECT 'sh' AS market, event_type AS symbol, user_id, CAST(ts AS DATE) AS trading_day, ts, event_id,
  value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
  CAST(value * CAST(json_extract_string(props, '$.k') AS BIGINT) * 100.0::DOUBLE * 100.0::DOUBLE AS BIGINT) AS amount_cents
  FROM events""",
    "statement_lines": """SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(quarter(l_shipdate) AS INTEGER) AS q,
  CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, l_linestatus AS status,
  CAST(l_extendedprice * 100.0::DOUBLE AS BIGINT) AS e, CAST(l_discount * 100.0::DOUBLE AS BIGINT) AS d,
  CAST(l_tax * 100.0::DOUBLE AS BIGINT) AS t, CAST(l_quantity AS BIGINT) AS qty FROM lineitem""",
    "statement_sums": """SELECT l_suppkey, y, q, sum(e * (100 - d)) AS r,
  sum(CASE WHEN flag = 'R' THEN e * (100 - d) ELSE 0 END) AS r_r, sum(CASE WHEN flag = 'A' THEN e * (100 - d) ELSE 0 END) AS r_a,
  sum(CASE WHEN flag = 'N' THEN e * (100 - d) ELSE 0 END) AS r_n, sum(e * t) AS et,
  sum(CASE WHEN flag = 'R' THEN e * t ELSE 0 END) AS et_r, sum(e) AS e, sum(CASE WHEN status = 'F' THEN e ELSE 0 END) AS e_f,
  sum(CASE WHEN status = 'O' THEN e ELSE 0 END) AS e_o, sum(CASE WHEN flag = 'N' THEN e ELSE 0 END) AS e_n, sum(e * d) AS ed,
  sum(CASE WHEN flag = 'R' THEN e * d ELSE 0 END) AS ed_r, sum(qty) AS qty, max(day) AS announced
  FROM statement_lines GROUP BY 1, 2, 3""",
    "statement_base": f"""SELECT {sql_market('l_suppkey')} AS market, {sql_symbol('l_suppkey')} AS symbol,
  y || CASE WHEN q = 4 THEN 'A' ELSE 'Q' || q END AS period, y * 10 + q AS period_ord, y * 4 + q - 1 AS period_idx,
  y * 10000 + CASE q WHEN 1 THEN 331 WHEN 2 THEN 630 WHEN 3 THEN 930 ELSE 1231 END AS report_date,
  CAST(strftime(announced, '%Y%m%d') AS INTEGER) AS announce_date,
  CAST(r AS DOUBLE) / 1e4 AS revenue, CAST(6 * (r - r_r) - 10 * r_r AS DOUBLE) / 1e5 AS net_profit,
  CAST(9 * (6 * (r - r_r) - 10 * r_r) AS DOUBLE) / 1e6 AS ex_net_profit,
  CAST(10 * r_a + 3 * r_n - 2 * r_r AS DOUBLE) / 1e5 AS op_cf, CAST(et AS DOUBLE) / 1e4 AS capex,
  CAST(e AS DOUBLE) / 1e2 AS total_assets, CAST(e_f AS DOUBLE) / 1e2 AS total_debt,
  CAST(10 * e_o - 8 * e_f AS DOUBLE) / 1e3 AS equity, CAST(e_n AS DOUBLE) / 1e2 AS ar,
  CAST(qty AS DOUBLE) * 100.0::DOUBLE AS inventory, CAST(et_r AS DOUBLE) / 1e4 AS goodwill,
  CAST(ed_r AS DOUBLE) / 1e4 AS impair_loss, CAST(7 * e AS DOUBLE) / 1e3 AS op_cost, CAST(ed AS DOUBLE) / 1e4 AS current_liab,
  CAST(qty AS DOUBLE) AS total_shares FROM statement_sums""",
    "statement_wide": f"""SELECT *, {RATIO_COLUMNS} FROM (SELECT *, ar + inventory AS current_assets,
  total_shares * 0.6::DOUBLE AS free_float_shares FROM statement_base) b""",
    "statements": f"""SELECT * EXCLUDE (revenue_y, net_profit_y, ex_net_profit_y), {_growth('revenue', 'revenue_growth')},
  {_growth('net_profit', 'profit_growth')}, {_growth('ex_net_profit', 'ex_profit_growth')}
  FROM (SELECT *, max(revenue) OVER ya AS revenue_y, max(net_profit) OVER ya AS net_profit_y, max(ex_net_profit) OVER ya AS ex_net_profit_y
  FROM statement_wide WINDOW ya AS (PARTITION BY market, symbol ORDER BY period_idx RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING)) g""",
    "concepts": f"""SELECT DISTINCT {sql_market('l_suppkey')} AS market, {sql_symbol('l_suppkey')} AS symbol,
  p_brand || ' ' || p_type || ' ' || p_size AS concept_name FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def add_view(name: str, sql: str) -> None:
    """Views may build on one another, in any order of definition."""
    VIEWS[name] = sql


def _names(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [v for v in VIEWS if v in words]


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it names, dependencies first."""
    ordered: list[str] = []

    def visit(name: str, trail: tuple[str, ...] = ()) -> None:
        for dep in _names(VIEWS[name]):
            if dep != name and dep not in trail:
                visit(dep, (*trail, name))
        if name not in ordered:
            ordered.append(name)

    for name in _names(body):
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    inner = body.strip()
    if inner.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{inner[15:]}"
    if inner.upper().startswith("WITH "):
        return f"WITH {ctes},\n{inner[5:]}"
    return f"WITH {ctes}\n{inner}"
