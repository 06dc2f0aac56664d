"""Cross-sections: winsorise, standardise, neutralise, layer.

``keys`` name one cross-section, for example (signal_date, factor_name). All
steps are windows over those keys or a superset, so a cross-section that fits a
task is shuffled once; ``hot=True`` switches to aggregation and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.scalar import log, ratio
from quantloom.operators import formula

KEYS = ("signal_date",)
NOISE = 1e-9


def mad_winsorize(df: DataFrame, keys: Sequence[str], value: str, out: str, scale: float = 5.0, hot: bool = False) -> DataFrame:
    return formula.winsorize(df, value, out, keys, scale, hot)


def zscore(df: DataFrame, keys: Sequence[str], value: str, out: str, weight: str | None = None, hot: bool = False) -> DataFrame:
    """Population z-score; with weights, mean and spread weigh rows by max(weight, 0)."""
    if weight is None:
        return formula.zscore(df, value, out, keys, hot)
    w = F.when(F.col(value).isNotNull() & (F.col(weight) > 0), F.col(weight)).otherwise(F.lit(0.0))
    df = df.withColumn("__w", w)
    df = groups.stats(df, keys, {"__sw": F.sum("__w"), "__swx": F.sum(F.col("__w") * F.col(value))}, hot=hot)
    df = df.withColumn("__off", F.col(value) - ratio("__swx", "__sw"))
    df = groups.stats(df, keys, {"__sww": F.sum(F.col("__w") * F.col("__off") * F.col("__off"))}, hot=hot)
    return df.withColumn(out, ratio("__off", F.sqrt(ratio("__sww", "__sw")))).drop("__w", "__sw", "__swx", "__off", "__sww")


def standardise(df: DataFrame, keys: Sequence[str], value: str, out: str, hot: bool = False) -> DataFrame:
    """Winsorise at five deviations, then z-score."""
    df = mad_winsorize(df, keys, value, "__clamped", hot=hot)
    return zscore(df, keys, "__clamped", out, hot=hot).drop("__clamped")


def neutralize(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "raw_value", out: str = "neutralized_value", hot: bool = False) -> DataFrame:
    """Residual of the standardised value on industry dummies and log float cap, cap-weighted, as a weighted z-score.

    The weighted regression is solved by partialling out: demean value and log
    cap inside each industry with cap weights, one slope per cross-section, and
    the residual remains. Needs industry_code and float_market_cap; a
    cross-section with fewer than three valid rows gets nulls.
    """
    df = standardise(df, keys, value, "__z", hot=hot)
    valid = F.col(value).isNotNull() & F.col("industry_code").isNotNull() & (F.col("float_market_cap") > 0)
    df = df.withColumns(
        {
            "__y": F.when(valid, F.col("__z")),
            "__x": F.when(valid, log("float_market_cap")),
            "__cap": F.when(valid & F.col("__z").isNotNull(), F.col("float_market_cap")),
        }
    )
    inside = [*keys, "industry_code"]
    cap = F.col("__cap")
    df = groups.stats(
        df, inside, {"__iw": F.sum(cap), "__iwy": F.sum(cap * F.col("__y")), "__iwx": F.sum(cap * F.col("__x"))}, hot=hot
    )
    df = df.withColumns({"__dy": F.col("__y") - ratio("__iwy", "__iw"), "__dx": F.col("__x") - ratio("__iwx", "__iw")})
    df = groups.stats(
        df,
        keys,
        {
            "__sxy": F.sum(cap * F.col("__dx") * F.col("__dy")),
            "__sxx": F.sum(cap * F.col("__dx") * F.col("__dx")),
            "__n": F.count("__y"),
            "__total": F.sum(cap),
        },
        hot=hot,
    )
    # no slope where log cap does not vary inside any industry
    flat = F.col("__sxx") <= 1e-12 * F.col("__total")
    slope = F.when(flat, F.lit(0.0)).otherwise(ratio("__sxy", "__sxx"))
    df = df.withColumn("__res", F.when(F.col("__n") >= 3, F.col("__dy") - slope * F.col("__dx")))
    df = zscore(df, keys, "__res", out, weight="__cap", hot=hot)
    # a perfect fit leaves rounding noise, not a residual
    df = groups.stats(df, keys, {"__size": F.max(F.abs("__res"))}, hot=hot)
    df = df.withColumn(out, F.when(F.col("__size") > NOISE, F.col(out)))
    return df.drop("__size").drop("__z", "__y", "__x", "__cap", "__iw", "__iwy", "__iwx", "__dy", "__dx", "__sxy", "__sxx", "__n", "__total", "__res")


def require_context(df: DataFrame) -> DataFrame:
    """Fail when a row lacks industry or float cap instead of imputing it."""
    missing = df.where(F.col("industry_code").isNull() | F.col("float_market_cap").isNull() | (F.col("float_market_cap") <= 0)).count()
    if missing:
        raise ValueError(f"{missing} rows lack industry or float market cap")
    return df


def industry_layers(df: DataFrame, keys: Sequence[str] = KEYS, groups_: int = 5, hot: bool = False) -> DataFrame:
    """Layers of equal width inside each industry, layer 1 highest, boundary stocks split by fraction.

    Industry weights equal the benchmark's in every layer. A stock emits only
    the layers its rank interval touches.
    """
    inside = [*keys, "industry_code"]
    df = groups.stats(df, keys, {"__all": F.sum("benchmark_weight")}, hot=hot)
    df = groups.stats(df, inside, {"__industry": F.sum("benchmark_weight")}, hot=hot)
    # count every row: a missing value ranks last, as in the sorted list
    df = df.withColumn("__v", F.coalesce(F.col("factor_value"), F.lit(float("-inf"))))
    df = groups.ranks(df, inside, "__v", ["symbol"], first="__rank", count="__count", descending=True, hot=hot)
    left = (F.col("__rank") - 1) / F.col("__count")
    right = F.col("__rank") / F.col("__count")
    lowest = F.greatest(F.floor(left * groups_) + 1, F.lit(1)).cast("int")
    highest = F.least(F.ceil(right * groups_), F.lit(groups_)).cast("int")
    out = df.withColumns({"__left": left, "__right": right}).withColumn("layer", F.explode(F.sequence(lowest, F.greatest(lowest, highest))))
    overlap = F.least(F.col("__right"), F.col("layer") / groups_) - F.greatest(F.col("__left"), (F.col("layer") - 1) / groups_)
    out = out.withColumn("__overlap", overlap).where(F.col("__overlap") > 1e-15)
    return out.select(
        *keys,
        "symbol",
        "industry_code",
        "layer",
        (F.col("__overlap") * F.col("__count")).alias("boundary_fraction"),
        (ratio("__industry", "__all") * F.col("__overlap") * groups_).alias("target_weight"),
    )


def layer_weight_sums(layers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return layers.groupBy(*keys, "layer").agg(F.sum("target_weight").alias("weight"))


def check_layers(layers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    bad = layer_weight_sums(layers, keys).where(F.abs(F.col("weight") - 1) > 1e-10)
    if not bad.isEmpty():
        raise AssertionError("layer weights do not sum to one")
    return layers
