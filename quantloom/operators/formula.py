"""Formula operators over one field's history, for every session at once.

Each operator appends its value as known at the close of each row's session.
Nulls of the field are dropped before the last N observations are taken: the
window is partitioned by "is null" next to the entity, which keeps the
observations contiguous without another shuffle, and rows without an
observation repeat the value of the latest one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.ewm import Step, add_averages
from quantloom.functions.rolling import frame as frame_of
from quantloom.functions.rolling import lag, so_far
from quantloom.functions.scalar import at_least, at_most, clip, col, finite, log, ratio
from quantloom.functions.trailing import Wanted, add_last

__all__ = [
    "asof", "rolling_mean", "std", "total", "low", "high", "returns", "diff", "ewm", "safe_div", "log", "clip",
    "turnover_bias", "amihud", "high_proximity", "volatility", "upside_vol", "downside_vol", "max_return",
    "abs_return", "idio", "rank", "zscore", "winsorize", "ensemble",
]


def default_minimum(window: int) -> int:
    return max(1, int(window * 0.8))


def observed(field: Column) -> WindowSpec:
    return Window.partitionBy("symbol", field.isNull()).orderBy("trade_date")


def _carry(df: DataFrame, field: Column, out: str) -> DataFrame:
    """Give rows without an observation the value of the latest observation."""
    known = F.when(field.isNotNull(), F.struct(F.col(out).alias("v")))
    w = so_far()
    return df.withColumn(out, F.last(known, ignorenulls=True).over(w)["v"])


def _over(
    df: DataFrame, field: str, window: int, minimum: int, fn: Callable[[Column], Column], out: str
) -> DataFrame:
    c = col(field)
    frame = observed(c).rowsBetween(-(window - 1), 0)
    df = df.withColumn(out, F.when(F.count(c).over(frame) >= minimum, fn(c).over(frame)))
    return _carry(df, c, out)


def asof(df: DataFrame, field: str, out: str) -> DataFrame:
    """The latest visible row's value, null included."""
    return df.withColumn(out, col(field))


def rolling_mean(df, field: str, window: int, out: str, minimum: int | None = None) -> DataFrame:
    return _over(df, field, window, minimum or default_minimum(window), F.avg, out)


def std(df, field: str, window: int, out: str, minimum: int | None = None) -> DataFrame:
    return _over(df, field, window, minimum or default_minimum(window), F.stddev_samp, out)


def total(df, field: str, window: int, out: str, minimum: int | None = None) -> DataFrame:
    return _over(df, field, window, minimum or default_minimum(window), F.sum, out)


def low(df, field: str, window: int, out: str, minimum: int | None = None) -> DataFrame:
    return _over(df, field, window, minimum or default_minimum(window), F.min, out)


def high(df, field: str, window: int, out: str, minimum: int | None = None) -> DataFrame:
    return _over(df, field, window, minimum or default_minimum(window), F.max, out)


def returns(df, field: str, window: int, out: str, skip: int = 0) -> DataFrame:
    """P[t - skip] / P[t - skip - window] - 1 over observations."""
    c = col(field)
    w = observed(c)
    return _carry(df.withColumn(out, ratio(lag(c, skip, w) if skip else c, lag(c, skip + window, w)) - 1), c, out)


def diff(df, field: str, out: str, periods: int = 1) -> DataFrame:
    c = col(field)
    return _carry(df.withColumn(out, c - lag(c, periods, observed(c))), c, out)


def ewm(df, field: str, span: int, out: str) -> DataFrame:
    """Exponential average over observations, null below ``span`` of them."""
    c = col(field)
    smoothed = add_averages(
        df.where(c.isNotNull()).select("symbol", "trade_date", c.cast("double").alias("__x")),
        [Step(out, "__x", span, span=span)],
    ).select("symbol", "trade_date", F.struct(F.col(out).alias("v")).alias("__known"))
    w = so_far()
    joined = df.join(smoothed, ["symbol", "trade_date"], "left")
    return joined.withColumn(out, F.last("__known", ignorenulls=True).over(w)["v"]).drop("__known")


safe_div = ratio


def turnover_bias(df, field: str, short: int, long: int, out: str) -> DataFrame:
    c = col(field)
    w = observed(c)
    near, far = w.rowsBetween(-(short - 1), 0), w.rowsBetween(-(long - 1), 0)
    value = ratio(F.avg(c).over(near), F.avg(c).over(far)) - 1
    df = df.withColumn(out, F.when(F.count(c).over(far) >= int(long * 0.8), value))
    return _carry(df, c, out)


def amihud(df, close: str, amount: str, window: int, out: str, minimum: int | None = None) -> DataFrame:
    """Mean |return| per unit of amount over the last ``window`` rows, times 1e8."""
    minimum = minimum or default_minimum(window)
    illiquid = ratio(F.abs(ratio(col(close), lag(close)) - 1), col(amount))
    df = df.withColumn("__illiquid", illiquid)
    frame = frame_of(window)
    enough = F.count("__illiquid").over(frame) >= minimum
    return df.withColumn(out, F.when(enough, F.avg("__illiquid").over(frame) * 1e8)).drop("__illiquid")


def high_proximity(df, field: str, window: int, out: str) -> DataFrame:
    c = col(field)
    frame = observed(c).rowsBetween(-(window - 1), 0)
    value = ratio(c, F.max(c).over(frame)) - 1
    return _carry(df.withColumn(out, F.when(F.count(c).over(frame) >= int(window * 0.8), value)), c, out)


def _return_stat(df, field: str, window: int, out: str, shape, fn) -> DataFrame:
    """``fn`` over the last ``window`` observed one-session returns after ``shape``."""
    df = df.withColumn("__ret", ratio(col(field), lag(field)) - 1)
    df = df.withColumn("__shaped", shape(F.col("__ret")))
    return _over(df, "__shaped", window, default_minimum(window), fn, out).drop("__ret", "__shaped")


def volatility(df, field: str, window: int, out: str) -> DataFrame:
    return _return_stat(df, field, window, out, lambda r: r, F.stddev_samp)


def upside_vol(df, field: str, window: int, out: str) -> DataFrame:
    return _return_stat(df, field, window, out, lambda r: at_least(r, 0.0), F.stddev_samp)


def downside_vol(df, field: str, window: int, out: str) -> DataFrame:
    return _return_stat(df, field, window, out, lambda r: at_most(r, 0.0), F.stddev_samp)


def max_return(df, field: str, window: int, out: str) -> DataFrame:
    return _return_stat(df, field, window, out, lambda r: r, F.max)


def abs_return(df, field: str, window: int, out: str) -> DataFrame:
    df = df.withColumn("__ret", ratio(col(field), lag(field)) - 1)
    c = F.col("__ret")
    frame = observed(c).rowsBetween(-(window - 1), 0)
    df = df.withColumn(out, F.when(F.count(c).over(frame) >= default_minimum(window), F.abs(c)))
    return _carry(df, c, out).drop("__ret")


def market_mean_return(df: DataFrame, field: str, out: str = "market_return") -> DataFrame:
    """Equal-weight mean one-session return of all securities per session.

    The mean is a partial aggregation; one row per session is sent back to all tasks.
    """
    df = df.withColumn("__ret", ratio(col(field), lag(field)) - 1)
    mean = df.groupBy("trade_date").agg(F.avg("__ret").alias(out))
    return df.join(F.broadcast(mean), "trade_date").drop("__ret")


def idio(
    df: DataFrame, field: str, window: int, *, vol: str | None = None, skew: str | None = None, market: str = "market_return"
) -> DataFrame:
    """Spread and bias-corrected skewness of the residuals of return on market return.

    Needs a ``market`` column and at least 0.8 window pairs with a moving
    market. Both follow from means of products of the last pairs.
    """
    wanted = Wanted()
    means = pair_means(wanted, window, skew=skew is not None)
    rows = add_last(pairs(df, field, market), list(wanted.asked.values()), keep=df.columns)
    return residuals(rows, means, vol=vol, skew=skew).drop(*wanted.asked)


PRODUCTS = ("yy", "xy", "xx", "yyy", "yyx", "yxx", "xxx")


def pairs(df: DataFrame, field: str, market: str = "market_return") -> DataFrame:
    """Return and market return where both are known, and their products."""
    df = df.withColumn("__ret", ratio(col(field), lag(field)) - 1)
    paired = F.col("__ret").isNotNull() & col(market).isNotNull()
    df = df.withColumns({"__y": F.when(paired, F.col("__ret")), "__x": F.when(paired, col(market))}).drop("__ret")
    return df.withColumns({f"__{p}": reduce(mul, [F.col(f"__{c}") for c in p]) for p in PRODUCTS})


def pair_means(wanted: Wanted, window: int, *, skew: bool) -> dict[str, Column]:
    """Number of pairs and means of their products over the last ``window`` pairs."""
    minimum = int(window * 0.8)
    names = ["y", "x", *(PRODUCTS if skew else PRODUCTS[:3])]
    means = {p: wanted.last("mean", f"__{p}", window, minimum, "__y") for p in names}
    return {"n": wanted.last("count", "__y", window, minimum, "__y"), **means}


def residuals(df: DataFrame, e: dict[str, Column], *, vol: str | None = None, skew: str | None = None) -> DataFrame:
    """Spread and skewness of the residuals from the means of ``pair_means``."""
    # central moments of the pair
    mx, my = e["x"], e["y"]
    cxx, cxy, cyy = e["xx"] - mx * mx, e["xy"] - mx * my, e["yy"] - my * my
    df = df.withColumns({"__cxx": F.when(cxx > 1e-18, cxx), "__cxy": cxy, "__cyy": cyy})
    df = df.withColumn("__b", ratio("__cxy", "__cxx"))
    b = F.col("__b")
    df = df.withColumn("__m2", F.greatest(F.col("__cyy") - b * F.col("__cxy"), F.lit(0.0)) + b * 0)
    out = {}
    if vol:
        out[vol] = F.sqrt(F.col("__m2") * ratio(e["n"], e["n"] - 1))
    if skew:
        cyyy = e["yyy"] - 3 * my * e["yy"] + 2 * my * my * my
        cyyx = e["yyx"] - 2 * my * e["xy"] - mx * e["yy"] + 2 * my * my * mx
        cyxx = e["yxx"] - 2 * mx * e["xy"] - my * e["xx"] + 2 * mx * mx * my
        cxxx = e["xxx"] - 3 * mx * e["xx"] + 2 * mx * mx * mx
        m3 = cyyy - 3 * b * cyyx + 3 * b * b * cyxx - b * b * b * cxxx
        g1 = ratio(m3, F.pow("__m2", F.lit(1.5)))
        out[skew] = F.when(e["n"] > 2, g1 * F.sqrt(e["n"] * (e["n"] - 1)) / F.nullif(e["n"] - 2, F.lit(0.0)))
    return df.withColumns(out).drop("__cxx", "__cxy", "__cyy", "__b", "__m2")


# --- cross-sections ---------------------------------------------------------------


def rank(df: DataFrame, field: str, out: str, keys: Sequence[str] = ("trade_date",), pct: bool = True, hot: bool = False) -> DataFrame:
    df = groups.ranks(df, keys, field, ["symbol"], average=out, count="__n", hot=hot)
    return (df.withColumn(out, F.col(out) / F.col("__n")) if pct else df).drop("__n")


def zscore(df: DataFrame, field: str, out: str, keys: Sequence[str] = ("trade_date",), hot: bool = False) -> DataFrame:
    df = groups.stats(df, keys, {"__mean": F.avg(field), "__std": F.stddev_pop(field)}, hot=hot)
    return df.withColumn(out, ratio(F.col(field) - F.col("__mean"), "__std")).drop("__mean", "__std")


def winsorize(df: DataFrame, field: str, out: str, keys: Sequence[str] = ("trade_date",), scale: float = 5.0, hot: bool = False) -> DataFrame:
    """Clamp to median +- scale * median absolute deviation; a zero deviation changes nothing."""
    df = groups.median(df, keys, field, "__med", hot=hot)
    df = df.withColumn("__dev", F.abs(F.col(field) - F.col("__med")))
    df = groups.median(df, keys, "__dev", "__mad", hot=hot)
    clamped = clip(field, F.col("__med") - scale * F.col("__mad"), F.col("__med") + scale * F.col("__mad"))
    value = F.when(F.coalesce(F.col("__mad"), F.lit(0.0)) == 0, F.col(field)).otherwise(clamped)
    return df.withColumn(out, value).drop("__med", "__dev", "__mad")


def features(*columns: str) -> Column:
    return F.array(*[col(c).cast("double") for c in columns])


def ensemble(columns: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of predictions, only where every one is present."""
    weights = list(weights) if weights is not None else [1.0] * len(columns)
    if not columns:
        raise ValueError("at least one prediction is needed")
    if len(weights) != len(columns) or sum(weights) == 0:
        raise ValueError("weights must match the predictions and not sum to zero")
    scale = sum(weights)
    value = sum((col(c) * (w / scale) for c, w in zip(columns, weights)), F.lit(0.0))
    return finite(value)


def predict_guard(models_end: str, signal_date: str | Column) -> Column:
    """Fail when a model was trained on data after the signal date."""
    bad = F.lit(models_end).cast("date") > col(signal_date)
    return F.assert_true(~bad, F.lit("model training ends after the signal date"))


def document_agg(df: DataFrame, entity: str, value: str, method: str, out: str) -> DataFrame:
    fns = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    if method not in fns:
        raise ValueError(f"unsupported document aggregation: {method}")
    return df.groupBy(entity).agg(fns[method](value).alias(out))
