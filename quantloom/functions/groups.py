"""Statistics, medians and ranks inside groups, safe when one group is huge.

A cross-section (one date, or one date and factor) normally fits a task, and
then windows over the group keys share a single shuffle. When the largest
group is above ``ROWS_PER_TASK`` the same results are built without ever
holding a group in one task: statistics by partial aggregation and a join,
ranks and medians by range-partitioned sorting with per-slice offsets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import col
from quantloom.session import cut

ROWS_PER_TASK = 4_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def is_hot(df: DataFrame, keys: Sequence[str], bound: int | None = None, limit: int | None = None) -> bool:
    """True when a group may exceed one task. ``bound`` is a known upper bound on
    rows per group (such as the number of securities); without it the rows are counted."""
    limit = ROWS_PER_TASK if limit is None else limit
    if bound is not None and bound <= limit:
        return False
    return largest_group(df, keys) > limit


def stats(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, Column], *, hot: bool = False) -> DataFrame:
    """Append group aggregates to every row."""
    if not hot:
        w = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
    df = cut(df.drop(*aggregates))
    small = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
    return attach(df, small, keys)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join of one row per group; adaptive execution broadcasts it or splits skew."""
    renamed = small.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"__{k}"))
        condition = match if condition is None else condition & match
    return df.join(renamed, condition, "left").drop(*[f"__{k}" for k in keys])


def ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    ties: Sequence[str | Column],
    *,
    first: str | None = None,
    average: str | None = None,
    count: str | None = None,
    reverse: str | None = None,
    descending: bool = False,
    hot: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Append ranks of the non-null values, 1 = smallest (or largest).

    ``first`` numbers rows uniquely, equal values in the order of ``ties``;
    ``average`` gives equal values their mean rank; ``count`` is the number of
    non-null values; ``reverse`` is what ``first`` would be in the other direction,
    equal values still in the order of ``ties``. ``ties`` must make rows unique inside
    a group. All of them come from one sort.
    """
    value = col(value)
    ties = [col(t) for t in ties]
    order = [value.desc_nulls_last() if descending else value.asc_nulls_last(), *[t.asc() for t in ties]]
    if not hot:
        group = Window.partitionBy(*keys)
        by_value = group.orderBy(order[0])
        number = F.row_number().over(group.orderBy(*order))
        place = F.rank().over(by_value)
        same = F.count(value).over(by_value.rangeBetween(Window.currentRow, Window.currentRow))
        total = F.count(value).over(group)
        columns = {}
        if first:
            columns[first] = F.when(value.isNotNull(), number)
        if average:
            columns[average] = F.when(value.isNotNull(), place + (same - 1) / F.lit(2.0))
        if count:
            columns[count] = total
        if reverse:
            columns[reverse] = F.when(value.isNotNull(), total - same - 2 * place + 2 + number)
        return df.withColumns(columns)

    df = df.withColumn("__v", value)
    parts = slices or max(2, math.ceil(df.count() / ROWS_PER_TASK) * 2)
    keyed = [F.col(k).asc() for k in keys]
    placed = cut(df.repartitionByRange(parts, *keyed, *order).withColumn("__slice", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "__slice").agg(F.count("__v").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys,
        "__slice",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    placed = attach(placed, sizes, [*keys, "__slice"])
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    placed = placed.withColumn(
        "__first", F.when(F.col("__v").isNotNull(), F.row_number().over(inside) + F.col("__offset"))
    )
    out = {}
    if average or reverse:
        placed = cut(placed)
        spans = (
            placed.where(F.col("__v").isNotNull())
            .groupBy(*keys, "__v")
            .agg(F.min("__first").alias("__least"), F.max("__first").alias("__most"))
        )
        placed = attach(placed, spans, [*keys, "__v"])
    if average:
        out[average] = (F.col("__least") + F.col("__most")) / 2.0
    if reverse:
        out[reverse] = F.col("__total") - F.col("__most") - F.col("__least") + 1 + F.col("__first")
    if first:
        out[first] = F.col("__first")
    if count:
        out[count] = F.col("__total")
    return placed.withColumns(out).drop("__v", "__slice", "__offset", "__total", "__first", "__least", "__most")


def median(
    df: DataFrame, keys: Sequence[str], value: str | Column, out: str, *, ties: Sequence[str] = ("symbol",), hot: bool = False
) -> DataFrame:
    """Append the exact median of the non-null values of each group."""
    if not hot:
        return df.withColumn(out, F.median(col(value)).over(Window.partitionBy(*keys)))
    df = df.withColumn("__m", col(value))
    ranked = cut(ranks(df, keys, "__m", ties, first="__r", count="__c", hot=True))
    middle = (F.col("__r") == F.floor((F.col("__c") + 1) / 2)) | (F.col("__r") == F.floor((F.col("__c") + 2) / 2))
    small = ranked.where(middle).groupBy(*keys).agg(F.avg("__m").alias(out))
    return attach(ranked.drop("__r", "__c", "__m"), small, keys)


def quintile(rank: str | Column, count: str | Column, groups: int = 5) -> Column:
    """Equal-count group 1..groups, 1 = highest, from a unique ascending rank.

    Group boundaries sit at the linear quantiles of ranks 1..n, so the k-th bin
    from below ends at 1 + k (n - 1) / groups.
    """
    r, n = col(rank), col(count)
    k = F.greatest(F.lit(1), F.ceil(F.try_divide(groups * (r - 1), n - 1)))
    return F.when(r.isNotNull(), groups + 1 - k).cast("int")
