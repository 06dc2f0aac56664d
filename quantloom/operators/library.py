"""The 169 registered factors and the panels built from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.rolling import change
from quantloom.functions.scalar import at_least, at_most, ratio
from quantloom.functions.trailing import Wanted, add_last
from quantloom.operators import asof, formula, fundamentals, pit, technical
from quantloom.operators.fundamentals import latest, stability, ttm, yoy


@dataclass(frozen=True)
class Factor:
    """A registered factor. ``bar`` reads adjusted bars (stage columns first) and asks for what it
    needs of the last rows; ``filing`` reads a disclosure state; ``per`` divides it by a market column."""

    name: str
    hypothesis: str
    family: str
    direction: str
    lookback: int
    bar: Callable[[Wanted], Column] | None = None
    filing: Callable[[], Column] | None = None
    per: str | None = None
    fields: tuple[str, ...] = field(default=())


REGISTRY: dict[str, Factor] = {}
CUSTOM: dict[str, Callable[..., DataFrame]] = {}


def register(factor: Factor) -> Factor:
    if factor.name in REGISTRY:
        raise ValueError(f"factor {factor.name} is already registered")
    REGISTRY[factor.name] = factor
    return factor


def register_operator(name: str, function: Callable[..., DataFrame]) -> None:
    """Add a custom operator: any DataFrame -> DataFrame function."""
    if name in CUSTOM:
        raise ValueError(f"operator {name} is already registered")
    CUSTOM[name] = function


def operator(name: str) -> Callable[..., DataFrame]:
    if name not in CUSTOM:
        raise KeyError(f"unknown operator {name}")
    return CUSTOM[name]


# --- price and volume factors over stage columns ------------------------------------


def stage(bars: DataFrame) -> DataFrame:
    """Bars with one-session return, its clipped forms and illiquidity."""
    bars = bars.withColumn("ret", change("adj_close"))
    return bars.withColumns(
        {
            "ret_up": at_least("ret", 0.0),
            "ret_down": at_most("ret", 0.0),
            "illiquidity": ratio(F.abs("ret"), "amount"),
        }
    )


def minimum(window: int) -> int:
    return max(1, int(window * 0.8))


def momentum(rows: Wanted, window: int, skip: int = 0, sign: float = 1.0) -> Column:
    top = rows.last("back", "adj_close", skip)
    return sign * (ratio(top, rows.last("back", "adj_close", skip + window)) - 1)


def proximity(rows: Wanted, window: int, least: int | None = None) -> Column:
    return ratio(rows.last("back", "adj_close", 0), rows.last("highest", "adj_close", window, least or int(window * 0.8))) - 1


def mean_of(rows: Wanted, column: str, window: int, least: int | None = None) -> Column:
    return rows.last("mean", column, window, least or minimum(window))


def spread_of(rows: Wanted, column: str, window: int) -> Column:
    return rows.last("spread", column, window, minimum(window))


def turnover_bias(rows: Wanted, short: int, long: int = 480) -> Column:
    return ratio(rows.last("mean", "turnover", short, 1), rows.last("mean", "turnover", long, int(long * 0.8))) - 1


def _bar(name, hypothesis, family, direction, lookback, make) -> None:
    register(Factor(name, hypothesis, family, direction, lookback, bar=make))


def _filing(name, hypothesis, family, fields, make, per=None) -> None:
    register(Factor(name, hypothesis, family, "positive", 1, filing=make, per=per, fields=tuple(fields)))


# Names, windows, directions and formulas of the registered factors.
def _register_all() -> None:
    _filing("EP_TTM", "value_ep", "value", ["eps"], lambda: ttm("eps"), "close")
    _filing("BP_MRQ", "value_bp", "value", ["bps"], lambda: latest("bps"), "close")
    _filing("SP_TTM", "value_sp", "value", ["revenue"], lambda: ttm("revenue"), "float_market_cap")
    _filing("CFP_TTM", "value_cfp", "value", ["ocfps"], lambda: ttm("ocfps"), "close")
    for name, c, difference in (
        ("REVENUE_YOY", "revenue", False), ("NET_PROFIT_YOY", "net_profit", False), ("EPS_YOY", "eps", False),
        ("OCFPS_YOY", "ocfps", False), ("ROE_YOY_CHANGE", "roe", True), ("GROSS_MARGIN_YOY_CHANGE", "gross_margin", True),
    ):
        _filing(name, f"growth_{c}", "growth", [c], lambda c=c, d=difference: yoy(c, d))
    for w in (1, 2, 3, 5, 7, 10, 20):
        _bar(f"REVERSAL_{w}D", "price_reversal", "momentum", "positive", w + 1, lambda rows, w=w: momentum(rows, w, sign=-1.0))
    for w, skip in ((60, 0), (120, 0), (120, 20), (252, 20)):
        name = f"MOMENTUM_{w}D" + (f"_SKIP{skip}" if skip else "")
        _bar(name, "price_momentum", "momentum", "positive", w + skip + 1, lambda rows, w=w, s=skip: momentum(rows, w, s))
    for w in (20, 60, 120, 252):
        _bar(f"HIGH_{w}D_PROXIMITY", "price_high_proximity", "momentum", "positive", w, lambda rows, w=w: proximity(rows, w))
    for w in (1, 5, 7, 10, 20, 60, 120):
        _bar(f"TURNOVER_MEAN_{w}D", "turnover_level", "liquidity", "negative", w, lambda rows, w=w: mean_of(rows, "turnover", w))
    for w in (20, 60):
        _bar(f"TURNOVER_BIAS_{w}_480D", "turnover_bias", "liquidity", "negative", 480, lambda rows, w=w: turnover_bias(rows, w))
    for w in (5, 7, 10, 20, 60):
        _bar(f"TURNOVER_VOL_{w}D", "turnover_volatility", "liquidity", "negative", w, lambda rows, w=w: spread_of(rows, "turnover", w))
    for w in (5, 7, 10, 20):
        least = 15 if w == 20 else max(3, math.ceil(w * 0.8))
        _bar(f"AMIHUD_{w}D", "illiquidity_amihud", "liquidity", "negative", w + 1,
             lambda rows, w=w, m=least: mean_of(rows, "illiquidity", w, m) * 1e8)
    for w in (2, 3, 5, 7, 10, 20, 60, 120):
        _bar(f"VOLATILITY_{w}D", "return_volatility", "risk", "negative", w + 1, lambda rows, w=w: spread_of(rows, "ret", w))
    for w in (10, 20, 60):
        _bar(f"UPSIDE_VOL_{w}D", "asymmetric_volatility", "risk", "negative", w + 1, lambda rows, w=w: spread_of(rows, "ret_up", w))
        _bar(f"DOWNSIDE_VOL_{w}D", "asymmetric_volatility", "risk", "negative", w + 1, lambda rows, w=w: spread_of(rows, "ret_down", w))
    for w in (5, 7, 10, 20):
        _bar(f"MAX_RETURN_{w}D", "lottery_max_return", "risk", "negative", w + 1,
             lambda rows, w=w: rows.last("highest", "ret", w, minimum(w)))
    _bar("ABS_RETURN_1D", "return_volatility", "risk", "negative", 2, lambda rows: F.abs(rows.last("back", "ret", 0)))
    register(Factor("IDIO_VOL_60D", "capm_idiosyncratic_risk", "risk", "negative", 61))
    register(Factor("IDIO_SKEW_60D", "capm_idiosyncratic_skew", "risk", "positive", 61))
    _filing("ROE", "quality_roe", "quality", ["roe"], lambda: latest("roe"))
    _filing("GROSS_MARGIN", "quality_gross_margin", "quality", ["gross_margin"], lambda: latest("gross_margin"))
    _filing("NET_MARGIN_TTM", "quality_net_margin", "quality", ["net_profit", "revenue"], lambda: ratio(ttm("net_profit"), ttm("revenue")))
    _filing("OCF_TO_EARNINGS", "quality_cash_conversion", "quality", ["ocfps", "eps"], lambda: ratio(ttm("ocfps"), ttm("eps")))
    _filing("ROE_STABILITY_8Q", "quality_roe_stability", "quality", ["roe"], lambda: stability("roe", 8, 6))
    _filing("GROSS_MARGIN_STABILITY_8Q", "quality_margin_stability", "quality", ["gross_margin"], lambda: stability("gross_margin", 8, 6))
    _filing("EARNINGS_GROWTH_STABILITY_8Q", "quality_growth_stability", "quality", ["net_profit"], lambda: stability("net_profit", 9, 7, growth=True))
    for name in technical.ALL_NAMES:
        register(Factor(name, f"technical_{technical.GROUP_OF[name].lower()}", "technical", "unknown", 120))


_register_all()
IDIO = ("IDIO_VOL_60D", "IDIO_SKEW_60D")


def names(family: str | None = None) -> list[str]:
    return [n for n, f in REGISTRY.items() if family is None or f.family == family]


def required_fields(selected: Sequence[str]) -> set[str]:
    """Columns the factors read from the daily and fundamentals tables."""
    out: set[str] = set()
    for name in selected:
        f = REGISTRY[name]
        out |= set(f.fields)
        if f.per:
            out.add(f.per)
        if f.family == "liquidity":
            out.add("amount" if name.startswith("AMIHUD") else "turnover")
        if f.bar is not None or name in IDIO:
            out.add("close")
        if f.family == "technical":
            out |= {"open", "high", "low", "close", "volume"}
    return out


# The batch panels ask for fewer observations of two factors than the formulas do.
BATCH_MINIMUM = {"HIGH_252D_PROXIMITY": 200, "AMIHUD_7D": 5}


def batch_columns() -> dict[str, Callable[[Wanted], Column]]:
    return {
        "HIGH_252D_PROXIMITY": lambda rows: proximity(rows, 252, BATCH_MINIMUM["HIGH_252D_PROXIMITY"]),
        "AMIHUD_7D": lambda rows: mean_of(rows, "illiquidity", 7, BATCH_MINIMUM["AMIHUD_7D"]) * 1e8,
    }


def wide(
    bars: DataFrame,
    filings: DataFrame | None,
    selected: Sequence[str],
    signals: DataFrame | None = None,
    *,
    batch: bool = False,
    market: DataFrame | None = None,
    traded: bool = True,
) -> DataFrame:
    """symbol, trade_date and one column per factor, for every bar or the bars of some dates.

    Price, volume and residual factors share one sort and, at the rows of signal dates
    alone, one pass per security; technical outputs are one more pass; disclosures attach as-of. Only the rows of the
    signal dates leave the window stages. ``market`` (trade_date, market_return)
    replaces the mean return as the market of residual factors. With
    ``traded=False`` every security with any history gets its latest values at
    each signal date, not only those traded that day.
    """
    unknown = [n for n in selected if n not in REGISTRY]
    if unknown:
        raise KeyError(f"unknown factors: {unknown}")
    signal_rows = None if signals is None else signals.select(F.col("signal_date").alias("trade_date"))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(signal_rows.distinct().withColumn("__asked", F.lit(True))), "trade_date", "left")  # at most one row per session

    def at_signals(df: DataFrame) -> DataFrame:
        if signal_rows is None:
            return df
        if traded:
            return df.join(signal_rows, "trade_date", "left_semi")
        columns = [c for c in df.columns if c not in ("symbol", "trade_date")]
        return pit.latest_on_dates(df, signals, columns).withColumnRenamed("signal_date", "trade_date")

    plain = [n for n in selected if REGISTRY[n].bar is not None]
    residual = [n for n in selected if n in IDIO]
    studies = [n for n in selected if REGISTRY[n].family == "technical"]
    filed = [n for n in selected if REGISTRY[n].filing is not None]
    base = [c for c in ("close", "float_market_cap") if c in bars.columns]
    out = bars
    if plain or residual:
        rows, at, wanted = bars, None, Wanted()
        if signal_rows is not None and traded:
            at = "__asked"
            rows = marked(rows)
        if residual:
            rows = formula.market_mean_return(rows, "adj_close") if market is None else rows.join(F.broadcast(market), "trade_date", "left")
            rows = formula.pairs(rows, "adj_close")
            means = formula.pair_means(wanted, 60, skew="IDIO_SKEW_60D" in residual)
        special = batch_columns() if batch else {}
        made = {n: special.get(n, REGISTRY[n].bar)(wanted) for n in plain}
        rows = stage(rows) if plain else rows
        asked, keep = list(wanted.asked.values()), ["symbol", "trade_date", *base]
        if at is None:
            # every row is asked for: window functions, but for what leaves rows out
            framed = [one for one in asked if one.observed is None]
            asked = [one for one in asked if one.observed is not None]
            rows = rows.withColumns({one.out: one.column() for one in framed})
            keep += [one.out for one in framed]
        rows = add_last(rows, asked, keep=keep, at=at) if asked else rows
        if residual:
            rows = formula.residuals(
                rows, means,
                vol="IDIO_VOL_60D" if "IDIO_VOL_60D" in residual else None,
                skew="IDIO_SKEW_60D" if "IDIO_SKEW_60D" in residual else None,
            )
        out = rows.withColumns(made)
    out = out.select("symbol", "trade_date", *base, *plain, *residual)
    if not (plain or residual) or not traded:
        out = at_signals(out)
    if studies:
        if signal_rows is not None and traded:
            study = technical.indicators(marked(bars), studies, at="__asked")
        else:
            study = at_signals(technical.indicators(bars, studies))
        out = out.join(study, ["symbol", "trade_date"])
    if filed:
        fields = sorted({c for n in filed for c in REGISTRY[n].fields})
        released = fundamentals.events(filings, {f"__{n}": REGISTRY[n].filing() for n in filed}, fields)
        out = fundamentals.attach_events(out, released, [f"__{n}" for n in filed], date="trade_date")
        out = out.withColumns(
            {n: ratio(f"__{n}", REGISTRY[n].per) if REGISTRY[n].per else F.col(f"__{n}") for n in filed}
        )
    return out.select("symbol", "trade_date", *[n for n in selected])


def melt(table: DataFrame, selected: Sequence[str], keys: Sequence[str] = ("signal_date", "symbol")) -> DataFrame:
    """One row per factor. Unlike ``unpivot`` this leaves rows in partitions that Spark knows."""
    pairs = [F.struct(F.lit(n).alias("factor_name"), F.col(n).alias("raw_value")) for n in selected]
    return table.select(*keys, F.inline(F.array(*pairs)))


def compute_factors(
    bars: DataFrame, filings: DataFrame | None, signals: DataFrame, selected: Sequence[str], traded: bool = False
) -> DataFrame:
    """Long panel of factor values at the signal dates, for all visible securities or those traded that day."""
    table = wide(bars, filings, selected, signals, traded=traded).withColumnRenamed("trade_date", "signal_date")
    return melt(table, selected).withColumns(
        {"neutralized_value": F.lit(None).cast("double"), "available_date": F.col("signal_date")}
    )


def labelled_panel(
    values: DataFrame, forward: DataFrame, index_code: str = "ALL_A", universe: DataFrame | None = None, plan: DataFrame | None = None
) -> DataFrame:
    """Attach forward returns; a date whose exit lies ahead keeps its values with a null label.

    On dates with prices ahead only securities with an entry price stay. The
    holding ``plan`` tells those dates without reading the returns twice.
    """
    rows = values if universe is None else values.join(universe, ["signal_date", "symbol"], "left_semi")
    labels = forward.select("signal_date", "symbol", "forward_return", F.lit(True).alias("__priced"))
    priced = forward if plan is None else plan.where(F.col("exit_date").isNotNull())
    dated = priced.select("signal_date").distinct().withColumn("__dated", F.lit(True))
    joined = rows.join(labels, ["signal_date", "symbol"], "left").join(dated, "signal_date", "left")
    return joined.where(F.col("__priced") | F.col("__dated").isNull()).select(
        "signal_date", "symbol", "factor_name", "raw_value", "neutralized_value", "forward_return",
        F.lit(index_code).alias("index_code"),
    )


# Factor lists of the batch panels.
BASE_PANEL = (
    "REVERSAL_5D", "REVERSAL_20D", "MOMENTUM_60D", "MOMENTUM_120D", "MOMENTUM_120D_SKIP20", "MOMENTUM_252D_SKIP20",
    "HIGH_252D_PROXIMITY", "TURNOVER_MEAN_20D", "TURNOVER_MEAN_60D", "TURNOVER_MEAN_120D", "TURNOVER_BIAS_20_480D",
    "TURNOVER_BIAS_60_480D", "TURNOVER_VOL_20D", "TURNOVER_VOL_60D", "AMIHUD_20D", "VOLATILITY_20D", "VOLATILITY_60D",
    "VOLATILITY_120D", "UPSIDE_VOL_60D", "DOWNSIDE_VOL_60D", "IDIO_VOL_60D", "IDIO_SKEW_60D", "MAX_RETURN_20D",
)
SHORT_PANEL = tuple(
    [f"REVERSAL_{w}D" for w in (1, 2, 3, 5, 7, 10, 20)]
    + [f"HIGH_{w}D_PROXIMITY" for w in (20, 60, 120, 252)]
    + [f"TURNOVER_MEAN_{w}D" for w in (1, 5, 7, 10, 20)]
    + [f"TURNOVER_VOL_{w}D" for w in (5, 7, 10, 20)]
    + [f"AMIHUD_{w}D" for w in (5, 7, 10, 20)]
    + ["ABS_RETURN_1D"]
    + [f"VOLATILITY_{w}D" for w in (2, 3, 5, 7, 10, 20)]
    + [f"UPSIDE_VOL_{w}D" for w in (10, 20, 60)]
    + [f"DOWNSIDE_VOL_{w}D" for w in (10, 20, 60)]
    + [f"MAX_RETURN_{w}D" for w in (5, 7, 10, 20)]
)
MARKET_SET = (
    "AMIHUD_7D", "TURNOVER_MEAN_5D", "TURNOVER_VOL_20D", "VOLATILITY_60D", "UPSIDE_VOL_60D", "MAX_RETURN_20D",
    "REVERSAL_5D", "REVERSAL_20D", "MOMENTUM_120D", "ATR_14D_PCT", "BOLL_LOWER_20D_PCT", "KELTNER_LOWER_20_10_PCT",
    "DONCHIAN_WIDTH_20D",
)
FINANCIAL_SET = (
    "BP_MRQ", "SP_TTM", "CFP_TTM", "ROE_STABILITY_8Q", "GROSS_MARGIN_STABILITY_8Q", "REVENUE_YOY", "NET_PROFIT_YOY",
)


def market_features(bars: DataFrame, signals: DataFrame, selected: Sequence[str] = MARKET_SET) -> DataFrame:
    """Market features and the price observations at any signal calendar."""
    unknown = set(selected) - set(MARKET_SET) - set(FINANCIAL_SET)
    if unknown:
        raise ValueError(f"unsupported features: {sorted(unknown)}")
    chosen = [n for n in MARKET_SET if n in selected]
    table = wide(bars, None, chosen, signals).withColumnRenamed("trade_date", "signal_date")
    seen = bars.withColumnRenamed("trade_date", "signal_date").select("signal_date", "symbol", "close", "float_market_cap")
    return table.join(seen, ["signal_date", "symbol"])


def member_rows(members: DataFrame, signals: DataFrame, securities: DataFrame, calendar: DataFrame) -> DataFrame:
    """Index members at each signal date with their sessions since listing."""
    active = asof.active_on_dates(members, signals, ["index_code", "symbol"])
    return asof.listed_sessions(active, securities, calendar)


def technical_catalog(spark) -> DataFrame:
    """Catalog of technical outputs: implemented names, exact vendor aliases and blocked vendor names."""
    rows = [(n, "implemented", n, REGISTRY[n].lookback) for n in technical.ALL_NAMES]
    rows += [(a, "exact_alias", n, REGISTRY[n].lookback) for a, n in technical.ALIASES.items()]
    rows += [(n, "blocked", None, None) for n in technical.BLOCKED]
    return spark.createDataFrame(rows, "name string, state string, output string, lookback int")
