"""Normal tail, robust t-statistics and multiple-testing control as columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.scalar import col, ratio


def two_sided_p(t: str | Column) -> Column:
    """2 * P(Z > |t|): power series near zero, continued fraction in the tail."""
    x = F.abs(col(t)) / math.sqrt(2.0)
    near = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)),
        F.struct((x * (2.0 / math.sqrt(math.pi))).alias("term"), (x * (2.0 / math.sqrt(math.pi))).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * x * x / (k + 0.5)).alias("term"),
            (acc["total"] + acc["term"] * x * x / (k + 0.5)).alias("total"),
        ),
        lambda acc: 1 - F.exp(-x * x) * acc["total"],
    )
    far = F.aggregate(
        F.sequence(F.lit(100), F.lit(1), F.lit(-1)),
        x,
        lambda acc, k: x + k / 2.0 / acc,
        lambda acc: F.exp(-x * x) / math.sqrt(math.pi) / acc,
    )
    return F.when(x < 2.0, near).otherwise(far)


def add_hac_t(df: DataFrame, series: str, out: str, lags: int | None = None) -> DataFrame:
    """t of the mean with Bartlett weights; ``series`` is an array in time order without nulls."""
    n = F.size(series)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    df = df.withColumn("__mean", ratio(total(F.col(series)), n))
    df = df.withColumn("__c", F.transform(series, lambda x: x - F.col("__mean")))
    most = F.lit(lags) if lags is not None else F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0)))
    df = df.withColumn("__L", F.least(most, n - 1).cast("int"))
    c = F.col("__c")

    def covariance(k: Column) -> Column:
        ahead, behind = F.slice(c, k + 1, n - k), F.slice(c, F.lit(1), n - k)
        return total(F.zip_with(ahead, behind, lambda a, b: a * b)) / n

    base = total(F.transform(c, lambda x: x * x)) / n
    extra = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("__L"), F.lit(1))),
        F.lit(0.0),
        lambda s, k: s + 2 * (1 - k / (F.col("__L") + 1)) * covariance(k),
    )
    variance = F.when(F.col("__L") >= 1, base + extra).otherwise(base)
    df = df.withColumn("__var", F.when(n >= 3, F.greatest(variance, F.lit(0.0))))
    value = ratio("__mean", F.sqrt(F.col("__var") / n))
    return df.withColumn(out, F.when(n >= 3, value)).drop("__mean", "__c", "__L", "__var")


def benjamini_hochberg(df: DataFrame, p: str, out: str, family: Sequence[str] = (), *, ties: Sequence[str] = (), hot: bool = False) -> DataFrame:
    """Step-up q-values inside each family.

    ``hot`` is for families beyond a task: places come from a range-partitioned sort, in which
    ``ties`` make rows of equal p unique, and the running minimum from slices of places.
    """
    if hot:
        return _hot_benjamini_hochberg(df, p, out, family, ties)
    keys = [F.col(k) for k in family] or [F.lit(0)]
    keys = [*keys, F.col(p).isNull()]
    ordered = Window.partitionBy(*keys).orderBy(p)
    df = df.withColumns(
        {"__rank": F.row_number().over(ordered), "__tests": F.count(p).over(Window.partitionBy(*keys))}
    )
    scaled = F.col(p) * F.col("__tests") / F.col("__rank")
    backwards = Window.partitionBy(*keys).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(F.col(p).isNotNull(), F.least(F.min(scaled).over(backwards), F.lit(1.0)))
    return df.withColumn(out, q).drop("__rank", "__tests")


def _hot_benjamini_hochberg(df: DataFrame, p: str, out: str, family: Sequence[str], ties: Sequence[str]) -> DataFrame:
    ranked = groups.ranks(df, family, p, ties, first="__rank", count="__tests", hot=True)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without p have no place; they are spread over slices of their own
    piece = F.coalesce(F.floor((F.col("__rank") - 1) / groups.ROWS_PER_TASK), -1 - F.pmod(F.xxhash64(*ties), F.lit(parts)))
    ranked = ranked.withColumns({"__q": F.col(p) * F.col("__tests") / F.col("__rank"), "__piece": piece})
    later = Window.partitionBy(*family).orderBy("__piece").rowsBetween(1, Window.unboundedFollowing)
    least = ranked.groupBy(*family, "__piece").agg(F.min("__q").alias("__least"))
    least = least.select(*family, "__piece", F.min("__least").over(later).alias("__later"))
    ranked = groups.attach(ranked, least, [*family, "__piece"])
    backwards = Window.partitionBy(*family, "__piece").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.min("__q").over(backwards), F.col("__later"), F.lit(1.0))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), q)).drop("__rank", "__tests", "__q", "__piece", "__later")
