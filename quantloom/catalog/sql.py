"""Canonical tables as DuckDB common table expressions, for the result checks."""

from __future__ import annotations

import re

# name -> (body, names it needs)
CTE: dict[str, tuple[str, tuple[str, ...]]] = {}


def define(name: str, body: str, *needs: str) -> None:
    CTE[name] = (body.strip(), needs)


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTE[name][1]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    bodies = {n: CTE[n][0] for n in ordered} | (extra or {})
    everything = "\n".join([*bodies.values(), body])

    def kept(name: str) -> str:
        """What is read more than once is computed once."""
        return "AS MATERIALIZED" if len(re.findall(rf"\b{name}\b", everything)) > 1 else "AS"

    parts = [f"{n} {kept(n)} ({b})" for n, b in bodies.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


define(
    "trades",
    """SELECT 'S' || lpad(l_suppkey::VARCHAR, 9, '0') AS symbol, l_suppkey, l_shipdate::DATE AS trade_date,
       20.0 + l_extendedprice / 10000.0 AS price, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
       l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""",
)
define(
    "raw_daily",
    """SELECT symbol, trade_date, 20.0 + s.d / 10000.0 AS open, high, low, 20.0 + t.d / 10000.0 AS close, volume, amount FROM (
       SELECT symbol, trade_date,
         min({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity, 'f': l_discount, 'g': l_tax}) AS s,
         max({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity, 'f': l_discount, 'g': l_tax}) AS t,
         max(price) AS high, min(price) AS low, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
       FROM trades GROUP BY ALL)""",
    "trades",
)
define(
    "daily",
    """SELECT *, volume / 1000.0 AS turnover, avg(amount) OVER (PARTITION BY symbol ORDER BY trade_date
       ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * 100.0 AS float_market_cap FROM raw_daily""",
    "raw_daily",
)
define(
    "events_adj",
    """SELECT symbol, trade_date, exp(sum(ln(1 + l_tax))) AS factor FROM trades
       WHERE l_returnflag = 'R' AND l_discount >= 0.09 GROUP BY ALL""",
    "trades",
)
define(
    "adjustments",
    """SELECT symbol, trade_date, exp(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY trade_date)) AS adjust_factor FROM events_adj""",
    "events_adj",
)
define(
    "bars",
    """SELECT d.*, coalesce(a.adjust_factor, 1.0) AS adjust_factor,
       open * coalesce(a.adjust_factor, 1.0) AS adj_open, high * coalesce(a.adjust_factor, 1.0) AS adj_high,
       low * coalesce(a.adjust_factor, 1.0) AS adj_low, close * coalesce(a.adjust_factor, 1.0) AS adj_close
       FROM daily d ASOF LEFT JOIN adjustments a ON d.symbol = a.symbol AND d.trade_date >= a.trade_date""",
    "daily",
    "adjustments",
)
define("cal", "SELECT DISTINCT trade_date FROM trades", "trades")
define(
    "calnext",
    "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS session, lead(trade_date) OVER (ORDER BY trade_date) AS next_session FROM cal",
    "cal",
)
define(
    "securities",
    """SELECT symbol, min(trade_date) AS list_date, CASE WHEN right(symbol, 2) = '07' THEN DATE '2001-06-30' END AS delist_date
       FROM (SELECT 'S' || lpad(s_suppkey::VARCHAR, 9, '0') AS symbol FROM supplier) LEFT JOIN trades USING (symbol) GROUP BY symbol""",
    "trades",
)
define(
    "status",
    """SELECT trade_date, symbol, avg((l_returnflag = 'R')::INT) = 1 AND sum(l_quantity) >= 45 AS is_st, false AS is_pt,
       sum(l_quantity) <= 2 AS is_suspended, max(l_discount) >= 0.1 AND min(l_tax) >= 0.05 AS limit_up,
       max(l_discount) <= 0.01 AND min(l_tax) >= 0.07 AS limit_down FROM trades GROUP BY ALL""",
    "trades",
)
define(
    "quarters",
    """SELECT symbol, last_day(date_trunc('quarter', trade_date)::DATE + INTERVAL 2 MONTH)::DATE AS stat_date,
       sum(l_extendedprice * (1 - l_discount)) AS q_revenue,
       sum(l_extendedprice * (1 - l_discount) - l_extendedprice * (l_tax + 0.6)) AS q_profit,
       sum(l_extendedprice * (1 - l_tax) * 0.3) AS q_cash, avg((l_returnflag = 'R')::INT) AS returned FROM trades GROUP BY ALL""",
    "trades",
)
define(
    "fund0",
    """SELECT symbol, stat_date, returned,
       sum(q_revenue) OVER y AS revenue, sum(q_profit) OVER y AS net_profit, sum(q_cash) OVER y AS cash,
       sum(q_profit) OVER (PARTITION BY symbol ORDER BY stat_date) / 1e4 + 100.0 AS bps
       FROM quarters WINDOW y AS (PARTITION BY symbol, year(stat_date) ORDER BY stat_date)""",
    "quarters",
)
define(
    "fund",
    """SELECT symbol, stat_date, available_date, revenue, net_profit, net_profit / 1e4 AS eps, bps, cash / 1e4 AS ocfps,
       net_profit / nullif(bps * 1e4, 0) AS roe, net_profit / nullif(revenue, 0) AS gross_margin FROM (
       SELECT symbol, stat_date, (stat_date + INTERVAL 45 DAY)::DATE AS available_date, revenue, net_profit, bps, cash FROM fund0
       UNION ALL SELECT symbol, stat_date, (stat_date + INTERVAL 120 DAY)::DATE, revenue * 0.98, net_profit * 0.98, bps, cash
       FROM fund0 WHERE returned > 0.4)""",
    "fund0",
)
define(
    "industries",
    """SELECT symbol, 'I' || k AS industry_code, 'industry I' || k AS industry_name, valid_from, valid_to, 'nation' AS source, '1' AS version FROM (
       SELECT 'S' || lpad(s_suppkey::VARCHAR, 9, '0') AS symbol, s_nationkey % 5 AS k, DATE '1990-01-01' AS valid_from, DATE '1998-12-31' AS valid_to FROM supplier
       UNION ALL SELECT 'S' || lpad(s_suppkey::VARCHAR, 9, '0'), (s_nationkey + s_suppkey) % 5, DATE '1999-01-01', NULL FROM supplier)""",
)
define("signals", "SELECT max(trade_date) AS signal_date FROM cal GROUP BY date_trunc('month', trade_date)", "cal")
define(
    "snapshots",
    """SELECT 'TOP_HALF' AS index_code, symbol, snapshot_date, amount FROM (
       SELECT date_trunc('month', trade_date) AS month, symbol, sum(l_extendedprice) AS amount,
         avg(sum(l_extendedprice)) OVER (PARTITION BY date_trunc('month', trade_date)) AS mean_amount FROM trades GROUP BY 1, 2)
       JOIN (SELECT date_trunc('month', trade_date) AS month, max(trade_date) AS snapshot_date FROM cal GROUP BY 1) USING (month)
       WHERE amount >= mean_amount""",
    "trades",
    "cal",
)
define(
    "members",
    """SELECT index_code, symbol, snapshot_date AS valid_from, valid_to, 1.0 / count(*) OVER (PARTITION BY index_code, snapshot_date) AS benchmark_weight
       FROM snapshots JOIN (SELECT snapshot_date, (lead(snapshot_date) OVER (ORDER BY snapshot_date) - INTERVAL 1 DAY)::DATE AS valid_to
       FROM (SELECT DISTINCT snapshot_date FROM snapshots)) USING (snapshot_date)""",
    "snapshots",
)
define(
    "plan",
    """SELECT signal_date, entry_date, lead(entry_date) OVER (ORDER BY signal_date) AS exit_date, row_number() OVER (ORDER BY signal_date) AS period_no
       FROM (SELECT signal_date, next_session AS entry_date FROM signals JOIN calnext ON trade_date = signal_date)""",
    "signals",
    "calnext",
)
define(
    "entries",
    "SELECT period_no, signal_date, entry_date, exit_date, symbol, adj_open FROM plan JOIN bars ON trade_date = entry_date WHERE exit_date IS NOT NULL",
    "plan",
    "bars",
)
define("exits", "SELECT period_no, symbol, adj_open FROM plan JOIN bars ON trade_date = exit_date", "plan", "bars")
define(
    "forward",
    """SELECT e.signal_date, e.symbol, e.entry_date, e.exit_date, x.adj_open / e.adj_open - 1 AS forward_return
       FROM entries e LEFT JOIN exits x ON x.period_no = e.period_no AND x.symbol = e.symbol""",
    "entries",
    "exits",
)


# --- text helpers -----------------------------------------------------------------

W = "PARTITION BY symbol ORDER BY trade_date"


def over(window: int | None = None, partition: str = W) -> str:
    start = "UNBOUNDED" if window is None else str(window - 1)
    return f"OVER ({partition} ROWS BETWEEN {start} PRECEDING AND CURRENT ROW)"


def roll(x: str, window: int, minimum: int | None = None, fn: str = "avg", partition: str = W) -> str:
    minimum = max(3, int(window * 0.8)) if minimum is None else minimum
    o = over(window, partition)
    return f"(CASE WHEN count({x}) {o} >= {minimum} THEN {fn}({x}) {o} END)"


def lagged(x: str, n: int = 1, partition: str = W) -> str:
    return f"(lag({x}, {n}) OVER ({partition}))"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b})::DOUBLE, 0))"


def ema(source: str, x: str, out: str, alpha: float, minimum: int) -> str:
    """``source`` plus the closed-form EMA of x, valid when nulls only lead the history."""
    q = 1 - alpha
    return f"""SELECT * EXCLUDE (ema_k), CASE WHEN count({x}) {over()} >= {minimum} THEN pow({q!r}, ema_k) *
      sum(CASE WHEN ema_k = 0 THEN {x} WHEN ema_k > 0 THEN {alpha!r} * ({x}) * pow({q!r}, -ema_k) END) {over()} END AS {out}
      FROM (SELECT *, i - min(CASE WHEN ({x}) IS NOT NULL THEN i END) OVER (PARTITION BY symbol) AS ema_k FROM {source})"""


define(
    "tb",
    f"""SELECT symbol, trade_date, row_number() OVER ({W}) AS i, adj_close AS c, adj_high AS h, adj_low AS l, adj_open AS o,
       nullif(volume, 0) AS v, amount, turnover, {lagged('adj_close')} AS c1, {lagged('adj_high')} AS h1, {lagged('adj_low')} AS l1,
       {lagged('adj_open')} AS o1, close, float_market_cap FROM bars""",
    "bars",
)
define("tr", "SELECT *, greatest(h - l, abs(h - c1), abs(l - c1)) AS tr FROM tb", "tb")
define("rt", "SELECT *, c / nullif(c1, 0) - 1 AS r FROM tb", "tb")

define(
    "marks",
    """SELECT g.symbol, g.trade_date, CASE WHEN g.session - q.session <= 60 THEN q.adj_open ELSE 0 END AS mark, g.session = q.session AS observed
       FROM (SELECT symbol, trade_date, session FROM (SELECT DISTINCT symbol FROM bars), calnext WHERE trade_date IN (SELECT entry_date FROM plan)) g
       ASOF LEFT JOIN (SELECT symbol, trade_date, adj_open, session FROM bars JOIN calnext USING (trade_date) WHERE adj_open > 0) q ON q.symbol = g.symbol AND g.trade_date >= q.trade_date""",
    "bars", "calnext", "plan",
)
define(
    "mforward",
    """SELECT p.signal_date, e.symbol, p.entry_date, p.exit_date, x.mark / nullif(e.mark, 0) - 1 AS forward_return, coalesce(e.observed, false) AS tradable
       FROM plan p JOIN marks e ON e.trade_date = p.entry_date JOIN marks x ON x.trade_date = p.exit_date AND x.symbol = e.symbol
       WHERE x.mark / nullif(e.mark, 0) IS NOT NULL""",
    "plan", "marks",
)
