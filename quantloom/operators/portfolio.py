"""Set-based portfolios: holdings, turnover, costs, benchmarks, fills."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import groups, prefix
from quantloom.functions.scalar import fee_rates, ratio, turnover_cost
from quantloom.operators import performance, pit, selection
from quantloom.session import cut

SCENARIOS = {"gross": None, "base_5bps": 5.0, "stress_10bps": 10.0, "stress_20bps": 20.0}
MINIMUM_NAMES = 25
LOT = 100


def holding_changes(holdings: DataFrame, ids: Sequence[str], weight: str = "weight", number: str = "period_no") -> DataFrame:
    """Weight change per security and period against the previous period.

    Each holding enters with its weight and leaves one period later; adding
    both up is one aggregation instead of a full outer join. The period after
    the last one is not traded.
    """
    ids = list(ids)
    opened = holdings.select(*ids, number, "symbol", F.col(weight).alias("__d"))
    closed = holdings.select(*ids, (F.col(number) + 1).alias(number), "symbol", (-F.col(weight)).alias("__d"))
    moved = opened.unionByName(closed).groupBy(*ids, number, "symbol").agg(F.sum("__d").alias("change"))
    if not ids:
        return moved.where(F.col(number) <= holdings.agg(F.max(number)).scalar())
    last = holdings.groupBy(*ids).agg(F.max(number).alias("__last"))
    return moved.join(last, ids).where(F.col(number) <= F.col("__last")).drop("__last")


def turnover(holdings: DataFrame, ids: Sequence[str], weight: str = "weight", number: str = "period_no") -> DataFrame:
    """Buys, sells and half their sum per period."""
    moved = holding_changes(holdings, ids, weight, number)
    out = moved.groupBy(*ids, number).agg(
        F.sum(F.greatest("change", F.lit(0.0))).alias("buys"), F.sum(F.greatest(-F.col("change"), F.lit(0.0))).alias("sells")
    )
    return out.withColumn("turnover", (F.col("buys") + F.col("sells")) / 2)


def quintile_portfolios(
    panel: DataFrame, signs: DataFrame | None, benchmark: DataFrame | None, periods: Mapping, *, ids: Sequence[str] = ("index_code", "factor_name"),
    value: str = "raw_value", minimum: int = MINIMUM_NAMES, hot: bool = False,
) -> DataFrame:
    """Direction-aligned quintiles, the equal-weight top group's turnover, cost, net and excess returns."""
    ids = list(ids)
    keys = [*ids, "signal_date"]
    rows = panel.where(F.col(value).isNotNull() & F.col("forward_return").isNotNull())
    if signs is not None:
        on = [c for c in signs.columns if c != "sign"]
        rows = rows.join(signs, on).withColumn(value, F.col(value) * F.col("sign")).drop("sign")
    rows = groups.ranks(rows, keys, value, ["symbol"], first="__r", count="constituents", hot=hot)
    rows = rows.where(F.col("constituents") >= minimum).withColumn("layer", groups.quintile("__r", "constituents"))
    # read for the returns of all layers and for the moves of the top one
    rows = cut(rows.select(*keys, "symbol", "forward_return", "constituents", "layer"))
    table = rows.groupBy(*keys).agg(
        F.first("constituents").alias("constituents"),
        *[F.avg(F.when(F.col("layer") == k, F.col("forward_return"))).alias(f"group_{k}") for k in range(1, 6)],
        F.count_if(F.col("layer") == 1).alias("__top"),
    )
    w = Window.partitionBy(*ids).orderBy("signal_date")
    table = cut(table.withColumn("period_no", F.row_number().over(w)))
    top = rows.where(F.col("layer") == 1).select(*keys, "symbol").join(
        table.select(*keys, "period_no", (1.0 / F.col("__top")).alias("weight")), keys
    )
    moves = turnover(top, ids)
    out = table.drop("__top").join(moves, [*ids, "period_no"])
    cost, stress = turnover_cost("signal_date", "buys", "sells")
    out = out.withColumns({"cost": cost, "stress_cost": stress, "long_short": F.col("group_1") - F.col("group_5")})
    if benchmark is not None:
        shared = [c for c in benchmark.columns if c != "benchmark_return"]
        out = out.join(benchmark, shared, "left")
    else:
        out = out.withColumn("benchmark_return", F.lit(None).cast("double"))
    return out.withColumns(
        {
            "top_net_return": F.col("group_1") - F.col("cost"),
            "top_stress_return": F.col("group_1") - F.col("stress_cost"),
            "top_net_excess_return": F.col("group_1") - F.col("cost") - F.col("benchmark_return"),
            "period": pit.period("signal_date", dict(periods)),
        }
    )


def portfolio_metrics(detail: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Means, information ratio and layer metrics per period and over all dates."""
    keys = [*ids, "period"]
    rows = detail.withColumn("period", F.explode(F.array_compact(F.array("period", F.lit("all")))))
    excess = F.col("top_net_excess_return")
    means = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("months"),
        F.avg("turnover").alias("mean_turnover"),
        F.avg("group_1").alias("mean_gross_return"),
        F.avg("top_net_return").alias("mean_net_return"),
        F.avg("top_stress_return").alias("mean_stress_return"),
        F.avg("long_short").alias("mean_long_short"),
        F.avg(excess).alias("mean_net_excess_return"),
        ratio(F.avg(excess) * 12, F.stddev_samp(excess) * performance.YEAR).alias("net_information_ratio"),
    )
    return means.join(performance.layer_performance_metrics(rows, keys, "top_net_return"), keys, "left")


def weighted_benchmark(rows: DataFrame, weight: str, keys: Sequence[str] = ("signal_date",), strict: bool = True) -> DataFrame:
    """Sum of w r / sum of w over positive weights; a weighted security without a return is an error when strict."""
    live = rows.where(F.col(weight) > 0)
    out = live.groupBy(*keys).agg(
        ratio(F.sum(F.col(weight) * F.col("forward_return")), F.sum(weight)).alias("benchmark_return"),
        F.count_if(F.col("forward_return").isNull()).alias("missing_prices"),
    )
    if strict and not out.where("missing_prices > 0").isEmpty():
        raise ValueError("benchmark securities lack prices")
    return out


def latest_index_weights(members: DataFrame, signals: DataFrame) -> DataFrame:
    """Weights of the newest snapshot on or before each signal date, per index."""
    from quantloom.operators import asof

    starts = members.select("index_code", "valid_from").distinct()
    asked = asof.densify(signals, members.select("index_code").distinct(), "signal_date")
    found = asof.attach_latest(asked, starts.withColumn("snapshot", F.col("valid_from")), on="index_code", left_time="signal_date", right_time="valid_from", columns=["snapshot"])
    weights = members.select("index_code", F.col("valid_from").alias("snapshot"), "symbol", "benchmark_weight")
    return found.where(F.col("snapshot").isNotNull()).join(weights, ["index_code", "snapshot"])


def cash_benchmark(rows: DataFrame, cap: str = "float_market_cap", keys: Sequence[str] = ("signal_date",)) -> DataFrame:
    """Cap-weighted and equal-weighted returns where an untradable start earns 0 and weights are not redistributed."""
    earned = F.when(F.col("tradable"), F.coalesce("forward_return", F.lit(0.0))).otherwise(0.0)
    live = F.greatest(F.coalesce(F.col(cap), F.lit(0.0)), F.lit(0.0))
    held = (live > 0).cast("double")
    return rows.groupBy(*keys).agg(
        ratio(F.sum(live * earned), F.greatest(F.sum(live), F.lit(1.0))).alias("benchmark_return"),
        ratio(F.sum(held * earned), F.greatest(F.sum(held), F.lit(1.0))).alias("equal_universe_return"),
    )


def spread_nav(monthly: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Cumulative long-short value."""
    w = Window.partitionBy(*ids).orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = monthly.withColumn("long_short", F.col("group_1") - F.col("group_5")).where(F.col("long_short").isNotNull())
    return rows.withColumn("net_value", F.product(1 + F.col("long_short")).over(w))


def scenario_rows(df: DataFrame, scenarios: Mapping[str, float | None] = SCENARIOS) -> DataFrame:
    """Every row once per cost scenario (a fixed handful)."""
    options = [F.struct(F.lit(n).alias("scenario"), F.lit(b).cast("double").alias("slippage_bps")) for n, b in scenarios.items()]
    return df.select("*", F.inline(F.array(*options)))


def top_n_backtest(
    scores: DataFrame, forward: DataFrame, plan: DataFrame, n: int, *, reserve: float = 0.005,
    scenarios: Mapping[str, float | None] = SCENARIOS, hot: bool = False, ids: Sequence[str] = (),
) -> DataFrame:
    """Top-n equal weight held to the next execution, less fees and slippage on turnover.

    Untraded lots, cash drift and T+1 are outside; a security without a return earns 0.
    """
    ids = list(ids)
    dates = plan.where(F.col("exit_date").isNotNull()).select("signal_date", "entry_date", "exit_date", "period_no")
    held = selection.top_names(scores, n, [*ids, "signal_date"], reserve=reserve, hot=hot).select(*ids, "signal_date", "symbol", "target_weight")
    held = cut(held.join(dates, "signal_date"))  # n rows per date
    gross = held.join(forward.select("signal_date", "symbol", "forward_return"), ["signal_date", "symbol"], "left").groupBy(
        *ids, "signal_date", "entry_date", "exit_date", "period_no"
    ).agg(F.sum(F.col("target_weight") * F.coalesce("forward_return", F.lit(0.0))).alias("gross_return"), F.count(F.lit(1)).alias("names"))
    moves = turnover(held.withColumnRenamed("target_weight", "weight"), ids)
    rows = scenario_rows(gross.join(moves, [*ids, "period_no"]), scenarios)
    buy, sell = (fee_rates("entry_date", F.lit(side)) for side in ("buy", "sell"))
    charged = F.col("slippage_bps").isNotNull()
    fees = F.col("buys") * sum(buy.values(), F.lit(0.0)) + F.col("sells") * sum(sell.values(), F.lit(0.0))
    slip = (F.col("buys") + F.col("sells")) * F.col("slippage_bps") / 10_000
    return rows.withColumns(
        {
            "explicit_cost": F.when(charged, fees).otherwise(0.0),
            "slippage_cost": F.coalesce(slip, F.lit(0.0)),
        }
    ).withColumn("portfolio_return", F.col("gross_return") - F.col("explicit_cost") - F.col("slippage_cost"))


def period_table(returns: DataFrame, periods: Mapping, ids: Sequence[str], per_year: float = 12.0) -> DataFrame:
    """Relative performance and yearly turnover and cost per period and scenario."""
    rows = returns.withColumn("period", pit.period("signal_date", dict(periods))).where(F.col("period").isNotNull())
    keys = [*ids, "scenario", "period"]
    stats = performance.relative_performance(rows, keys, "portfolio_return", "benchmark_return", per_year)
    years = F.count(F.lit(1)) / per_year
    costs = rows.groupBy(*keys).agg(
        (F.sum(F.col("buys") + F.col("sells")) / years).alias("annual_turnover"),
        (F.sum("explicit_cost") / years).alias("annual_explicit_cost"),
        (F.sum("slippage_cost") / years).alias("annual_slippage_cost"),
    )
    return stats.join(costs, keys)


def common_window(returns: DataFrame, schedule: Sequence[str], start: str = "entry_date", end: str = "exit_date") -> DataFrame:
    """Rows inside the window all schedules share: latest start to earliest end."""
    spans = returns.groupBy(*schedule).agg(F.min(start).alias("a"), F.max(end).alias("b"))
    low, high = spans.agg(F.max("a")).scalar(), spans.agg(F.min("b")).scalar()
    return returns.where((F.col(start) >= low) & (F.col(end) <= high))


def running_positions(trades: DataFrame) -> DataFrame:
    """symbol, trade_date (and sequence): shares held after the filled trades of each place in the history.

    Fills of one place are added up first; without a ``sequence`` column a day is one place.
    """
    order = ["trade_date", *(["sequence"] if "sequence" in trades.columns else [])]
    signed = F.when(F.col("side") == "buy", F.col("shares")).otherwise(-F.col("shares"))
    net = trades.where(F.col("status") == "filled").groupBy("symbol", *order).agg(F.sum(signed).alias("net_shares"))
    return prefix.running_sum(net, ["symbol"], order, "net_shares", "position")


def short_positions(trades: DataFrame) -> DataFrame:
    """Per symbol that was ever short: since when, the lowest position, and at how many places it was short."""
    short = running_positions(trades).where("position < 0")
    return short.groupBy("symbol").agg(F.min("trade_date").alias("first_short"), F.min("position").alias("lowest"), F.count(F.lit(1)).alias("places"))


def replay(trades: DataFrame, initial_cash: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cash, positions and symbols that were ever short, from filled trades only."""
    filled = trades.where(F.col("status") == "filled")
    signed = F.when(F.col("side") == "buy", F.col("shares")).otherwise(-F.col("shares"))
    fees = F.col("commission") + F.col("stamp_tax") + F.col("transfer_fee")
    cash = filled.agg((F.lit(float(initial_cash)) - F.coalesce(F.sum(signed * F.col("price") + fees), F.lit(0.0))).alias("cash"))
    positions = filled.groupBy("symbol").agg(F.sum(signed).alias("shares"))
    return cash, positions, short_positions(trades)


def cost_attribution(trades: DataFrame, slippage_bps: float, keys: Sequence[str] = ()) -> DataFrame:
    """Notional, explicit and slippage cost, and counts of filled and rejected orders."""
    done = F.col("status") == "filled"
    fees = F.col("commission") + F.col("stamp_tax") + F.col("transfer_fee")
    return trades.groupBy(*keys).agg(
        F.sum(F.when(done, F.col("notional")).otherwise(0.0)).alias("notional"),
        F.sum(F.when(done, fees).otherwise(0.0)).alias("explicit_cost"),
        (F.sum(F.when(done, F.col("notional")).otherwise(0.0)) * slippage_bps / 10_000).alias("slippage_cost"),
        F.count_if(done).alias("filled_orders"),
        F.count_if(F.col("status") == "rejected").alias("rejected_orders"),
    )


def reject_reason(side: str = "side", price: str = "open") -> Column:
    """Why an order cannot trade; null when it can. Limit columns are hit flags."""
    p = F.col(price)
    return (
        F.when(F.coalesce("is_suspended", F.lit(False)), "suspended")
        .when(p.isNull() | (p <= 0), "no_price")
        .when((F.col(side) == "buy") & F.coalesce("limit_up", F.lit(False)), "limit_up")
        .when((F.col(side) == "sell") & F.coalesce("limit_down", F.lit(False)), "limit_down")
    )


def target_shares(equity: Column | float, weight: str = "target_weight", price: str = "open", lot: int = LOT) -> Column:
    """Whole lots a weight of the equity buys; null without a positive price."""
    equity = equity if isinstance(equity, Column) else F.lit(float(equity))
    p = F.when(F.col(price) > 0, F.col(price))
    return F.floor(equity * F.col(weight) / p / lot) * lot
