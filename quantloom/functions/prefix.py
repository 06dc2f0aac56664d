"""Running sums over histories of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.scalar import col
from quantloom.session import stored


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, out: str) -> DataFrame:
    """Append the sum of ``value`` over the rows of the same keys up to and including the place of each in ``order``.

    Rows are dealt out by ranges of keys and order, so a key with most of the rows is spread over
    as many tasks as its rows fill; each slice is summed on its own and begins with the sums of
    the key's earlier slices (one row per key and slice). Rows equal in ``order`` count together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__v", col(value)).repartitionByRange(parts, *keys, *order)
    # Boundaries are sampled: the slices are written once, so that both uses see the same.
    placed = stored(ranged.withColumn("__slice", F.spark_partition_id()), "slices")
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*keys, "__slice").agg(F.sum("__v").alias("__sum"))
    sums = sums.select(*keys, "__slice", F.sum("__sum").over(earlier).alias("__before"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = groups.attach(placed, sums, [*keys, "__slice"])
    return summed.withColumn(out, F.coalesce("__before", F.lit(0)) + F.sum("__v").over(inside)).drop("__v", "__slice", "__before")
