"""Research runs end to end. A panel is stored once and every later step reads the stored copy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.operators import asof, combine, cross_section, evaluate, library, models, performance, pit, portfolio, quality, selection
from quantloom.session import cut
from quantloom.sources import tables

IDS = ("factor_name", "value_type", "orientation")


def backtest_panel(panel: DataFrame, periods: Mapping, *, hot: bool | None = None, value_types: Sequence[str] = ("raw",)) -> dict[str, DataFrame]:
    """Evaluate a supplied panel: monthly, summary, NAV, performance and cost metrics."""
    quality.check_panel(panel)
    panel = cut(panel)
    hot = groups.is_hot(panel, ["signal_date", "factor_name"]) if hot is None else hot
    monthly, summary = evaluate.evaluate_batch(panel, periods, value_types=value_types, hot=hot)
    return {
        "panel": panel,
        "monthly": monthly,
        "summary": summary,
        "nav": performance.layered_nav(monthly, IDS),
        "performance": performance.layered_performance(monthly, IDS),
        "metrics": performance.cost_metrics(monthly, IDS),
    }


def factor_panel(
    bars: DataFrame, filings: DataFrame | None, calendar: DataFrame, names: Sequence[str], *, universe: DataFrame | None = None,
    index_code: str = "ALL_A", frequency: str = "monthly", forward: DataFrame | None = None, signals: DataFrame | None = None,
) -> DataFrame:
    """Factor values with forward labels for traded securities of a universe."""
    quality.check_fields(library.required_fields(names), bars, *([filings] if filings is not None else []))
    signals = asof.signal_dates(calendar, frequency) if signals is None else signals
    plan = asof.holding_plan(signals, calendar)
    values = library.compute_factors(bars, filings, signals, names)
    labels = asof.forward_open_returns(bars, plan) if forward is None else forward
    return library.labelled_panel(values, labels, index_code, universe, plan)


def backtest_factors(bars, filings, calendar, names, periods, **options) -> dict[str, DataFrame]:
    """Compute, label and evaluate factors."""
    return backtest_panel(factor_panel(bars, filings, calendar, names, **options), periods)


def audited_factors(tables: Mapping[str, DataFrame], names: Sequence[str], signals: DataFrame) -> DataFrame:
    """Audit the canonical tables, then factor values at the signal dates."""
    quality.require(quality.audit(tables, formal=False))
    bars = asof.adjust(tables["daily"], tables["adjustments"])
    return library.compute_factors(bars, tables["fundamentals"], signals, names)


def factor_layers(bars, members, securities, status, calendar, industries, signals, values: DataFrame, sign: float = 1.0, index_code: str = "ALL_A", hot: bool = False) -> DataFrame:
    """Neutralised five-layer targets of eligible members at signal dates.

    ``values`` holds signal_date, symbol, raw_value.
    """
    eligible = pit.eligible(signals, index_code, members, securities, status, calendar)
    cap = pit.latest_on_dates(bars, signals, ["float_market_cap"])
    rows = eligible.select("signal_date", "symbol", "benchmark_weight").join(cap, ["signal_date", "symbol"]).join(
        values.select("signal_date", "symbol", "raw_value").where(F.col("raw_value").isNotNull()), ["signal_date", "symbol"]
    )
    rows = asof.attach_interval(rows, industries, ["industry_code"], how="inner")
    neutral = cross_section.neutralize(rows, ("signal_date",), hot=hot)
    scored = neutral.withColumn("factor_value", sign * F.col("neutralized_value")).where(F.col("factor_value").isNotNull())
    return cross_section.industry_layers(scored, ("signal_date",), hot=hot)


def combination(
    panel: DataFrame, directions: DataFrame, periods: Mapping, names: Sequence[str], *, methods: Sequence[str] = ("equal", "ic_decay", "factor_return_decay", "max_ic"),
    threshold: float = 0.80, rolling_months: int = 12, hot: bool = False,
) -> dict:
    """Standardise, sign, decorrelate, weigh and evaluate composite scores.

    Signs, the correlation filter and the weights only see dates up to the
    validation end; the composites are then evaluated over all dates.
    """
    z = cut(cross_section.zscore(panel, ["signal_date", "factor_name"], "raw_value", "z", hot=hot))
    ic = cut(evaluate.ic_matrix(z, "z", hot=hot))
    last = F.lit(periods["validation"][1]).cast("date")
    history = ic.where(F.col("signal_date") <= last)
    mean = history.groupBy("factor_name").agg(F.avg("rank_ic").alias("priority"))
    sign = F.when(F.col("direction") == "negative", -1.0).when((F.col("direction") == "unknown") & (F.col("priority") < 0), -1.0).otherwise(1.0)
    signs = {r["factor_name"]: r["sign"] for r in mean.join(directions, "factor_name", "left").select("factor_name", sign.alias("sign")).collect()}
    recent = history.select("signal_date").distinct().orderBy(F.desc("signal_date")).limit(rolling_months)
    by_date = evaluate.panel_correlation(z.join(recent, "signal_date", "left_semi"), names, "z", hot=hot)
    kept = selection.low_correlation(evaluate.mean_correlation(by_date, 10), mean, names, threshold)
    chosen = history.where(F.col("factor_name").isin(*kept))
    weights = None
    for method in methods:
        column = "factor_return" if method == "factor_return_decay" else "rank_ic"
        one = combine.factor_weights(chosen.select("signal_date", "factor_name", F.col(column).alias("value")), method)
        one = one.withColumn("method", F.lit(method))
        weights = one if weights is None else weights.unionByName(one)
    sign_map = F.create_map(*[x for n, s in signs.items() for x in (F.lit(n), F.lit(s))])
    signed = z.where(F.col("factor_name").isin(*kept)).select("signal_date", "symbol", "factor_name", "forward_return", (F.col("z") * sign_map[F.col("factor_name")]).alias("value"))
    scores = combine.combine_scores(signed, weights, ["signal_date"])
    labels = z.groupBy("signal_date", "symbol").agg(F.first("forward_return", ignorenulls=True).alias("forward_return"))
    composite = scores.where(F.col("score").isNotNull()).join(labels, ["signal_date", "symbol"]).select(
        "signal_date", "symbol", F.col("method").alias("factor_name"), F.col("score").alias("raw_value"), "forward_return")
    composite = cut(composite)
    monthly = cut(evaluate.monthly_statistics(composite, periods=periods, value_types=("raw",), hot=hot, turnover=False))
    return {"kept": kept, "signs": signs, "weights": weights, "scores": composite, "monthly": monthly, "summary": evaluate.summary_statistics(monthly)}


def walk_forward_combination(
    panel: DataFrame, monthly: DataFrame, factors: DataFrame, signs: DataFrame, benchmark: DataFrame | None, periods: Mapping, *,
    methods: Sequence[str] = ("equal", "ic_decay", "max_ic"), freeze_from: str, test_start: str, minimum: int = portfolio.MINIMUM_NAMES, hot: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights from the 12 months before each date, frozen for the test period; costed top-quintile portfolios per method."""
    ids = ["index_code"]
    rows = panel.join(factors, ["index_code", "factor_name"], "left_semi").join(signs, ["index_code", "factor_name"])
    rows = rows.withColumn("value", F.col("raw_value") * F.col("sign"))
    history = monthly.where((F.col("value_type") == "raw") & (F.col("orientation") == "original"))
    history = history.join(factors, ["index_code", "factor_name"], "left_semi").join(signs, ["index_code", "factor_name"])
    decisions = rows.select("index_code", "signal_date").distinct()
    keys = [*ids, "decision_date"]
    weights = None
    for method in methods:
        column = "factor_return" if method == "factor_return_decay" else "rank_ic"
        past = combine.walk_forward_history(
            history.select(*ids, "signal_date", "factor_name", (F.col(column) * F.col("sign")).alias("value")), decisions, ids)
        one = combine.factor_weights(past, method, keys).withColumn("method", F.lit(method))
        weights = one if weights is None else weights.unionByName(one)
    # dates with under two months of history hold equal weights of all chosen factors
    seen = combine.walk_forward_history(history.select(*ids, "signal_date", "factor_name"), decisions, ids)
    enough = seen.groupBy(*keys).agg(F.countDistinct("signal_date").alias("n")).where("n >= 2").select(*keys)
    first = decisions.withColumnRenamed("signal_date", "decision_date").join(enough, keys, "left_anti").join(factors, ids)
    w = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*keys))
    start = first.withColumn("weight", w).withColumn("method", F.explode(F.array(*[F.lit(x) for x in methods])))
    weights = cut(weights.join(enough, keys, "left_semi").select(*keys, "method", "factor_name", "weight").unionByName(start.select(*keys, "method", "factor_name", "weight")))
    held = combine.frozen_weights(weights, [*ids, "method"], freeze_from, test_start)
    dated = held.withColumnRenamed("decision_date", "signal_date").drop("frozen")
    scores = combine.combine_scores(rows, dated, ["index_code", "signal_date"])
    labels = panel.groupBy("index_code", "signal_date", "symbol").agg(F.first("forward_return", ignorenulls=True).alias("forward_return"))
    table = scores.where(F.col("score").isNotNull()).join(labels, ["index_code", "signal_date", "symbol"]).withColumnRenamed("score", "raw_value")
    detail = cut(portfolio.quintile_portfolios(table, None, benchmark, periods, ids=["index_code", "method"], minimum=minimum, hot=hot))
    return held, detail, portfolio.portfolio_metrics(detail, ["index_code", "method"])


def model_run(features: DataFrame, names: Sequence[str], periods: Mapping, methods: Sequence[str], *, protocol: str = "frozen", settings: Mapping = models.STOCK_MODELS, label_ends=None, hot: bool = False) -> DataFrame:
    """Predictions of several models in the shape of a factor panel."""
    out = None
    sample = models.frozen_sample(features, names, periods, label_ends=label_ends, hot=hot) if protocol == "frozen" else None
    for method in methods:
        if sample is not None:
            scored, _ = models.frozen(features, names, periods, method, settings=settings, sample=sample)
        else:
            scored = models.walk_forward(features, names, periods, method, settings=settings, hot=hot)
        one = models.predictions_panel(scored, method)
        out = one if out is None else out.unionByName(one)
    return out


def smooth_scores(scores: DataFrame, dates: DataFrame, months: int, value: str = "score") -> DataFrame:
    """Mean of the last ``months`` scores per security; months without a score count as missing.

    A score counts in its own and the next ``months`` - 1 dates, and nowhere else.
    """
    place = Window.partitionBy(F.lit(0)).orderBy("signal_date")  # calendar-sized
    numbered = dates.select("signal_date").distinct().withColumn("__no", F.row_number().over(place))
    counted = scores.where(F.col(value).isNotNull()).join(numbered, "signal_date")
    spread = counted.select("symbol", F.col(value).alias("__value"), F.explode(F.sequence(F.col("__no"), F.col("__no") + months - 1)).alias("__no"))
    return spread.groupBy("symbol", "__no").agg(F.avg("__value").alias(value)).join(numbered, "__no").select("signal_date", "symbol", value)


def export_signal(scores: DataFrame, calendar: DataFrame, n: int, *, smooth_months: int = 1, hot: bool = False) -> tuple[DataFrame, DataFrame]:
    """The latest date's top-n list with equal weights, and a one-row state record with dates and a digest."""
    dates = scores.select("signal_date").distinct()
    if smooth_months > 1:
        scores = smooth_scores(scores, dates, smooth_months)
    last = scores.where(F.col("score").isNotNull()).agg(F.max("signal_date")).scalar()
    latest = scores.where(F.col("signal_date") == last)
    target = selection.top_names(latest, n, hot=hot).select("signal_date", "symbol", "score", "target_weight", "place")
    # at most n names: the list fits one row
    listing = F.array_sort(F.collect_list(F.struct("place", "symbol", F.round("score", 10).alias("score"))))
    text = F.array_join(F.transform(listing, lambda e: F.concat_ws(",", e["symbol"], F.format_string("%.10f", e["score"]))), "\n")
    record = target.groupBy("signal_date").agg(F.count(F.lit(1)).alias("names"), F.sha2(text, 256).alias("list_digest"))
    record = asof.next_month_signal(asof.next_open(record, calendar, "effective_date"), calendar)
    newest = asof.open_dates(calendar).agg(F.max("trade_date")).scalar()
    return target, record.withColumns({"latest_data": newest, "stale_days": F.datediff(newest, "signal_date")})


def write_signal(target: DataFrame, record: DataFrame, folder: str) -> None:
    """The list and its record as CSV, one file each: a list is at most n rows long."""
    tables.write_frame(target.orderBy("place"), f"{folder}/targets.csv", single_file=True)
    tables.write_frame(record, f"{folder}/state.csv", single_file=True)


def schedule_comparison(scores: DataFrame, forward: DataFrame, plan: DataFrame, caps: DataFrame, periods: Mapping, n: int, schedule: str, per_year: float, hot: bool = False) -> DataFrame:
    """Top-n returns of every method under all cost scenarios against the cash benchmark, per period."""
    returns = portfolio.top_n_backtest(scores, forward, plan, n, ids=["method"], hot=hot)
    pool = forward.join(caps, ["signal_date", "symbol"])
    bench = portfolio.cash_benchmark(pool)
    table = portfolio.period_table(returns.join(bench, "signal_date"), periods, ["method"], per_year)
    return table.withColumn("schedule", F.lit(schedule))


def report_check(table: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Rows, distinct keys and whether both equal the expected grid."""
    out = table.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(*keys).alias("unique_rows"))
    return out.withColumn("complete", (F.col("rows") == expected) & (F.col("unique_rows") == expected))
