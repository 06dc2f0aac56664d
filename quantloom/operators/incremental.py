"""Stored factor values: coverage, missing parts, partition upserts, signatures."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources.tables import fingerprint


def universe_key(index_code: str, include: Sequence[str] = (), exclude: Sequence[str] = (), symbols: Sequence[str] = ()) -> str:
    """Order-free short hash of a universe."""
    parts = {"index": index_code, "include": sorted(include), "exclude": sorted(exclude), "symbols": sorted(symbols)}
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]


def data_signature(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and content fingerprint per table."""
    out = None
    for name, df in tables.items():
        one = fingerprint(df).select(F.lit(name).alias("table"), "rows", "content")
        out = one if out is None else out.unionByName(one)
    return out


def merge_month_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of month ranges: touching or overlapping [first_month, last_month] become one."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("first_month", "last_month")
    reach = F.max("last_month").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("first_month") > F.add_months(reach, 1))
    marked = ranges.withColumn("__island", fresh.cast("int"))
    numbered = marked.withColumn("__island", F.sum("__island").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__island").agg(F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month")).drop("__island")


def months(df: DataFrame, first: str = "first_month", last: str = "last_month", out: str = "month") -> DataFrame:
    rest = [c for c in df.columns if c not in (first, last)]
    return df.select(*rest, F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 month"))).alias(out))


def missing_months(required: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required (key, month) pairs no stored range covers."""
    return months(required).join(months(stored), [*keys, "month"], "left_anti")


def covered(required: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: months required, months missing, and whether nothing is missing."""
    need = months(required).groupBy(*keys).agg(F.count(F.lit(1)).alias("required_months"))
    gap = missing_months(required, stored, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_months"))
    out = need.join(gap, list(keys), "left").withColumn("missing_months", F.coalesce("missing_months", F.lit(0)))
    return out.withColumn("covered", F.col("missing_months") == 0)


def stored_months(values: DataFrame, keys: Sequence[str] = ("factor_name",)) -> DataFrame:
    """Month ranges present in stored values, one row per month."""
    month = F.trunc("signal_date", "MM")
    return values.select(*keys, month.alias("first_month"), month.alias("last_month")).distinct()


def upsert_values(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("factor_name", "signal_date", "symbol")) -> DataFrame:
    """Last-wins merge. A new revision of a factor replaces all its old rows."""
    revised = incoming.select("factor_name", F.col("revision").alias("__new")).distinct()
    old = existing.join(revised, "factor_name", "left").where(F.col("__new").isNull() | (F.col("__new") == F.col("revision"))).drop("__new")
    both = old.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    best = F.max_by(F.struct(*rest), "__new").alias("__row")
    return both.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*existing.columns)


def store_values(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """Write values partitioned by factor, revision and month, replacing only the partitions present.

    A written partition is complete for its month, so a rerun or a lost task ends in the same files.
    Rows are dealt by partition and then by size: a large partition is shared by several
    tasks, small ones share a task, and the number of files follows the data.
    """
    rows = incoming.withColumn("month", F.date_format("signal_date", "yyyy-MM"))
    rows.hint("rebalance", "factor_name", "revision", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "factor_name", "revision", "month"
    ).parquet(path)


def fill_missing(
    spark: SparkSession, path: str, required: DataFrame, revision: str, compute: Callable[[list[str], DataFrame], DataFrame], stored: DataFrame | None
) -> list[str]:
    """Compute and store only factors or months that are not stored yet; returns the factors worked on.

    ``required`` holds factor_name, first_month, last_month: one row per registered factor.
    """
    gaps = required
    if stored is not None:
        have = stored_months(stored.where(F.col("revision") == revision))
        missing = missing_months(required, have, ["factor_name"])
        gaps = missing.groupBy("factor_name").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    spans = gaps.collect()
    if not spans:
        return []
    names = sorted(r["factor_name"] for r in spans)
    window = gaps.agg(F.min("first_month").alias("first_month"), F.max("last_month").alias("last_month"))
    store_values(spark, compute(names, window).withColumn("revision", F.lit(revision)), path)
    return names


def cache_status(required: DataFrame, stored: DataFrame) -> DataFrame:
    """Covered and missing factor counts."""
    status = covered(required, stored_months(stored), ["factor_name"])
    return status.groupBy("covered").agg(F.count(F.lit(1)).alias("factors"))
