"""Return statistics, net asset values and report tables.

Return series are one row per signal date and key, so a key's series is an
array no longer than the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import ratio
from quantloom.operators.evaluate import GROUPS

YEAR = math.sqrt(12.0)
PORTFOLIOS = (*GROUPS, "benchmark", "long_short")


def series(value: str | Column, date: str = "signal_date") -> Column:
    """Non-null values in date order as an aggregate."""
    c = F.col(value) if isinstance(value, str) else value
    known = F.when(c.isNotNull(), F.struct(F.col(date), c.alias("x")))
    return F.transform(F.sort_array(F.collect_list(known)), lambda e: e["x"])


def growth(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, r: a * (1 + r))


def drawdown(values: Column, from_one: bool = False) -> Column:
    """Deepest fall below the running peak; the peak starts at the first value, or at 1."""
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0 if from_one else 0.0).alias("peak"), F.lit(0.0).alias("low"))

    def step(a: Column, r: Column) -> Column:
        w = a["w"] * (1 + r)
        peak = F.greatest(a["peak"], w)
        return F.struct(w.alias("w"), peak.alias("peak"), F.least(a["low"], F.try_divide(w, peak) - 1).alias("low"))

    return F.aggregate(values, start, step, lambda a: a["low"])


def _spread(values: Column) -> Column:
    n = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), n)
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(square, n - 1))


def annual_return(values: Column, per_year: float = 12.0) -> Column:
    total = growth(values)  # a total loss or worse has no yearly rate
    return F.when((F.size(values) > 0) & (total >= 0), F.pow(total, F.try_divide(F.lit(per_year), F.size(values))) - 1)


METRICS = ("annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "monthly_win_rate")


def performance(df: DataFrame, keys: Sequence[str], value: str, date: str = "signal_date") -> DataFrame:
    """Geometric return over volatility, downside spread of min(r, 0), drawdown, win rate (12 periods a year)."""
    out = df.groupBy(*keys).agg(series(value, date).alias("__r")).where(F.size("__r") > 0)
    return _performance(out, "__r").drop("__r")


def _performance(df: DataFrame, r: str) -> DataFrame:
    values = F.col(r)
    down = F.transform(values, lambda x: F.least(x, F.lit(0.0)))
    df = df.withColumns(
        {
            "annualized_return": annual_return(values),
            "annualized_volatility": _spread(values) * YEAR,
            "__down": _spread(down) * YEAR,
            "max_drawdown": drawdown(values),
            "monthly_win_rate": F.size(F.filter(values, lambda x: x > 0)) / F.nullif(F.size(values), F.lit(0)),
        }
    )
    return df.withColumns(
        {
            "sharpe": ratio("annualized_return", "annualized_volatility"),
            "sortino": ratio("annualized_return", "__down"),
            "calmar": ratio("annualized_return", F.abs("max_drawdown")),
        }
    ).drop("__down")


LAYER_METRICS = (
    "annual_return", "annual_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "monthly_win_rate",
    "quarterly_win_rate", "yearly_win_rate", "best_5_month_concentration",
)


def layer_performance_metrics(df: DataFrame, keys: Sequence[str], value: str, date: str = "signal_date") -> DataFrame:
    """Arithmetic ratios, spread of losing months, win rates by quarter and year, weight of the best five months."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    out = rows.groupBy(*keys).agg(series(value, date).alias("__r"))
    values = F.col("__r")
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))
    positive = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    best = F.slice(F.sort_array(values, asc=False), 1, 5)
    best_sum = F.aggregate(best, F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    out = out.withColumns(
        {
            "annual_return": annual_return(values),
            "annual_volatility": _spread(values) * YEAR,
            "__mean": mean * 12,
            "__down": _spread(F.filter(values, lambda x: x < 0)) * YEAR,
            "max_drawdown": drawdown(values),
            "monthly_win_rate": F.try_divide(F.size(F.filter(values, lambda x: x > 0)), F.size(values)),
            "best_5_month_concentration": ratio(best_sum, positive),
        }
    )
    out = out.withColumns(
        {
            "sharpe": ratio("__mean", "annual_volatility"),
            "sortino": ratio("__mean", "__down"),
            "calmar": ratio("annual_return", F.abs("max_drawdown")),
        }
    ).drop("__mean", "__down", "__r")
    for name, unit in (("quarterly_win_rate", "quarter"), ("yearly_win_rate", "year")):
        spans = rows.groupBy(*keys, F.trunc(date, unit).alias("__span")).agg(F.product(1 + F.col(value)).alias("__g"))
        rates = spans.groupBy(*keys).agg(F.avg((F.col("__g") > 1).cast("double")).alias(name))
        out = out.join(rates, keys) if keys else out.join(rates)
    return out


RELATIVE_METRICS = (
    "periods", "annualized_return", "benchmark_annualized_return", "annualized_excess_return", "information_ratio",
    "sharpe_zero_rate", "max_drawdown", "relative_max_drawdown", "active_win_rate",
)


def relative_performance(
    df: DataFrame, keys: Sequence[str], value: str, benchmark: str, per_year: float | str, date: str = "signal_date"
) -> DataFrame:
    """Against a benchmark: geometric excess, information ratio, drawdowns from 1. ``per_year`` is a number or an aggregate-side column name."""
    both = F.col(value).isNotNull() & F.col(benchmark).isNotNull()
    pair = F.struct(F.col(date), F.col(value).alias("p"), F.col(benchmark).alias("b"))
    extra = [F.first(per_year).alias("__per")] if isinstance(per_year, str) else []
    out = df.where(both).groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("__a"), *extra)
    per = F.col("__per") if extra else F.lit(float(per_year))
    out = out.withColumns(
        {
            "__p": F.transform("__a", lambda e: e["p"]),
            "__b": F.transform("__a", lambda e: e["b"]),
            "__x": F.transform("__a", lambda e: F.try_divide(1 + e["p"], 1 + e["b"]) - 1),
            "periods": F.size("__a"),
            "__py": per,
        }
    )
    n = F.col("periods")
    enough = n >= 2

    def mean(c: str) -> Column:
        return F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), n)

    values = {
        "annualized_return": annual_return(F.col("__p"), 1.0),
        "benchmark_annualized_return": annual_return(F.col("__b"), 1.0),
        "annualized_excess_return": annual_return(F.col("__x"), 1.0),
    }
    values = {k: F.pow(1 + v, F.col("__py")) - 1 for k, v in values.items()}
    values |= {
        "information_ratio": ratio(mean("__x") * F.sqrt("__py"), _spread(F.col("__x"))),
        "sharpe_zero_rate": ratio(mean("__p") * F.sqrt("__py"), _spread(F.col("__p"))),
        "max_drawdown": drawdown(F.col("__p"), True),
        "relative_max_drawdown": drawdown(F.col("__x"), True),
        "active_win_rate": F.try_divide(F.size(F.filter("__x", lambda x: x > 0)), n),
    }
    return out.withColumns({k: F.when(enough, v) for k, v in values.items()}).drop("__a", "__p", "__b", "__x", "__py", "__per")


# --- layered portfolios -----------------------------------------------------------------


def descending_groups(monthly: DataFrame) -> DataFrame:
    """Rows not marked 'descending' get their group order flipped, so group 1 is always the highest."""
    legacy = F.lit(True) if "group_order" not in monthly.columns else F.coalesce(F.col("group_order") != "descending", F.lit(True))
    return monthly.withColumns(
        {f"group_{k}": F.when(legacy, F.col(f"group_{6 - k}")).otherwise(F.col(f"group_{k}")) for k in range(1, 6)}
    ).withColumn("group_order", F.lit("descending"))


def period_samples(monthly: DataFrame, later: str = "monitoring") -> DataFrame:
    """Every row once under its period (``later`` when outside) and once under 'all'."""
    labels = F.array(F.coalesce("period", F.lit(later)), F.lit("all"))
    return monthly.withColumn("period", F.explode(labels))


def layer_returns(monthly: DataFrame) -> DataFrame:
    """Add the equal-weight benchmark of the five groups and the long-short return."""
    present = F.filter(F.array(*GROUPS), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))
    return monthly.withColumns({"benchmark": mean, "long_short": F.col("group_1") - F.col("group_5")})


def portfolio_rows(monthly: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Long returns: one row per date and portfolio."""
    wide = layer_returns(descending_groups(monthly))
    return wide.select(*ids, "signal_date", F.col("benchmark").alias("__bench"), *PORTFOLIOS).unpivot(
        [*ids, "signal_date", "__bench"], list(PORTFOLIOS), "portfolio", "monthly_return"
    )


def layered_nav(monthly: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Cumulative value per portfolio, anchored at 1 on the month end before the first date."""
    ids = list(ids)
    rows = portfolio_rows(monthly, ids).drop("__bench")
    first = monthly.groupBy(*ids).agg(F.date_sub(F.trunc(F.min("signal_date"), "MM"), 1).alias("signal_date"))
    anchors = first.withColumn("portfolio", F.explode(F.array(*[F.lit(p) for p in PORTFOLIOS]))).withColumns(
        {"monthly_return": F.lit(None).cast("double"), "net_value": F.lit(1.0)}
    )
    w = Window.partitionBy(*ids, "portfolio").orderBy("signal_date").rowsBetween(Window.unboundedPreceding, 0)
    values = rows.where(F.col("monthly_return").isNotNull()).withColumn("net_value", F.product(1 + F.col("monthly_return")).over(w))
    return values.unionByName(anchors)


def layered_performance(monthly: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per period and portfolio: performance, excess over the group benchmark and information ratio."""
    keys = [*ids, "period", "portfolio"]
    rows = portfolio_rows(period_samples(monthly), [*ids, "period"])
    rows = rows.withColumn("__active", F.col("monthly_return") - F.col("__bench"))
    out = rows.groupBy(*keys).agg(
        series("monthly_return").alias("__r"), series(F.when(F.col("monthly_return").isNotNull(), F.col("__bench"))).alias("__b"), series("__active").alias("__x")
    ).where(F.size("__r") > 0)
    x = F.col("__x")
    mean = F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x))
    compare = ~F.col("portfolio").isin("benchmark", "long_short")
    out = _performance(out, "__r").withColumns(
        {
            "annualized_excess_return": F.when(compare, F.col("annualized_return") - annual_return(F.col("__b"))),
            "information_ratio": F.when(compare, ratio(mean * 12, _spread(x) * YEAR)),
        }
    )
    return out.drop("__r", "__b", "__x")


SCENARIO_BPS = {"base_5bps": 5.0, "stress_10bps": 10.0}


def cost_metrics(monthly: DataFrame, ids: Sequence[str], scenarios: Mapping[str, float] = SCENARIO_BPS) -> DataFrame:
    """Long metric rows of the top group after turnover costs, per period and scenario."""
    keys = [*ids, "period", "cost_scenario"]
    turnover = F.coalesce("rank_turnover", F.lit(0.0))
    options = F.array(*[F.struct(F.lit(n).alias("cost_scenario"), F.lit(b).alias("bps")) for n, b in scenarios.items()])
    rows = period_samples(descending_groups(monthly)).withColumn("__turnover", turnover).select("*", F.inline(options))
    rows = rows.withColumn("__net", F.col("group_1") - F.col("__turnover") * F.col("bps") / 10_000)
    out = rows.groupBy(*keys).agg(series("__net").alias("__r"), F.avg("__turnover").alias("mean_turnover"))
    out = _performance(out.where(F.size("__r") > 0), "__r").drop("__r")
    return out.unpivot(keys, [*METRICS, "mean_turnover"], "metric_name", "metric_value")


def metric_rows(summary: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Wide summary to (metric_name, metric_value) rows."""
    numbers = [f.name for f in summary.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in ids]
    wide = summary.select(*ids, *[F.col(c).cast("double").alias(c) for c in numbers])
    return wide.unpivot(list(ids), numbers, "metric_name", "metric_value")


def metric_table(metrics: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One column per metric."""
    return metrics.groupBy(*ids).pivot("metric_name", list(names)).agg(F.first("metric_value"))


def nested_metrics(metrics: DataFrame, entity: str, levels: Sequence[str]) -> DataFrame:
    """All metric rows of an entity as one sorted array of structs (a report: factors x variants x periods)."""
    entry = F.struct(*levels, "metric_name", "metric_value")
    return metrics.groupBy(entity).agg(F.sort_array(F.collect_list(entry)).alias("metrics"))


def nav_series(nav: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Dates and values of every portfolio as arrays in time order."""
    points = F.sort_array(F.collect_list(F.struct("signal_date", "net_value")))
    return nav.groupBy(*ids, "portfolio").agg(points.alias("points"))


def member_coverage(rows: DataFrame) -> DataFrame:
    """Members per index and date, then mean, lowest and highest."""
    daily = rows.groupBy("index_code", "signal_date").agg(F.countDistinct("symbol").alias("n"))
    return daily.groupBy("index_code").agg(F.avg("n").alias("mean_members"), F.min("n").alias("min_members"), F.max("n").alias("max_members"))


def family_counts(factors: DataFrame) -> DataFrame:
    return factors.groupBy("family").agg(F.count(F.lit(1)).alias("factors"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def metrics_of_runs(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Metric rows joined to their run, newest run first."""
    return metrics.join(runs, "run_id").orderBy(F.desc("created_at"), "metric_name")


def stale_dependencies(dependencies: DataFrame, current: DataFrame) -> DataFrame:
    """Flag dependencies locked to a revision that is no longer current."""
    joined = dependencies.join(current, "factor_id", "left")
    return joined.withColumn("stale", F.when(F.col("locked_revision").eqNullSafe(F.col("current_revision")), 0).otherwise(1))
