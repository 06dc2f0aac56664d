"""Canonical tables."""

from quantloom.catalog.registry import query

PRICES = "open high low close volume amount"
query("table_daily", lambda m: m.daily, "symbol trade_date", f"{PRICES} turnover float_market_cap", ctes="daily", sql="SELECT * FROM daily", digits=5)
query("W13_adjustments", lambda m: m.adjustments, "symbol trade_date", "adjust_factor", ctes="adjustments", sql="SELECT * FROM adjustments")
query(
    "J1_adjusted_bars", lambda m: m.bars, "symbol trade_date", "adjust_factor adj_open adj_high adj_low adj_close",
    ctes="bars", sql="SELECT * FROM bars", digits=6,
)
query("table_calendar", lambda m: m.calendar, "trade_date is_open", ctes="cal", sql="SELECT trade_date, true AS is_open FROM cal")
query("table_securities", lambda m: m.securities, "symbol list_date delist_date", ctes="securities", sql="SELECT * FROM securities")
query("table_status", lambda m: m.status, "symbol trade_date is_st is_pt is_suspended limit_up limit_down", ctes="status", sql="SELECT * FROM status")
query(
    "table_fundamentals", lambda m: m.fundamentals, "symbol stat_date available_date",
    "revenue net_profit eps bps ocfps roe gross_margin", ctes="fund", sql="SELECT * FROM fund", digits=4,
)
query(
    "table_industries", lambda m: m.industries, "symbol industry_code industry_name valid_from valid_to source version",
    ctes="industries", sql="SELECT * FROM industries",
)
query(
    "W21_constituent_intervals", lambda m: m.index_members, "index_code symbol valid_from valid_to", "benchmark_weight",
    ctes="members", sql="SELECT * FROM members",
)
query("W18_month_ends", lambda m: m.month_ends, "signal_date", ctes="signals", sql="SELECT * FROM signals")
query(
    "W22_holding_plan", lambda m: m.month_end_plan, "signal_date entry_date exit_date", "period_no", ints="period_no",
    ctes="plan", sql="SELECT * FROM plan",
)
query(
    "W15_forward_open_returns", lambda m: m.forward, "signal_date symbol entry_date exit_date", "forward_return",
    ctes="forward", sql="SELECT * FROM forward",
)
