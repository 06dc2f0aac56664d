"""Incremental file sync: new rows upserted into a change log, once per batch id."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quantloom.sources import changelog, vendor

OVERLAP_DAYS = 7


def overlap_start(checkpoint: str, days: int = OVERLAP_DAYS):
    """First day to read again after a completed sync."""
    return F.date_sub(F.lit(checkpoint).cast("date"), days)


def resume(rows: DataFrame, completed_through: str | None, date: str = "trade_date", days: int = OVERLAP_DAYS) -> DataFrame:
    return rows if completed_through is None else rows.where(F.col(date) >= overlap_start(completed_through, days))


def market_days(bars: DataFrame, factors: DataFrame, basics: DataFrame, completed_through: str | None = None) -> DataFrame:
    """Canonical daily rows to publish after a completed sync; days whose bars lack a factor are refused."""
    daily, missing = vendor.market_day(resume(bars, completed_through), factors, basics)
    vendor.require_factors(missing)
    return daily


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream of a checkpoint folder; a new checkpoint is another stream."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def append_batches(
    spark: SparkSession, source: str, schema: T.StructType, keys: Sequence[str], log: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1, sequence: str | None = None, progress: str | None = None,
) -> StreamingQuery:
    """Read every new Parquet file and publish each micro-batch as the next version of the log.

    The manifest entry of a version names its batch, so a replay after a failure finds what was
    published and leaves it; what was written without an entry is written again. Versions
    published by others before or meanwhile stay. With ``progress``, the largest value of that
    column so far is published with the data and is read back by ``changelog.Log.through``.
    ``sequence`` orders rows of one key; read with ``by=("_row", "_version")`` if files may arrive in any order.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    published = changelog.Log(spark, log)

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else batch.transform(transform)
        through = published.through if progress else None
        if progress:
            here = rows.agg(F.max(F.col(progress).cast("string")).alias("last")).first()["last"]
            through = max(filter(None, (through, here)), default=None)
        published.publish(rows, keys, "upsert", sequence, batch=f"{stream_id(spark, checkpoint)}:{batch_id}", through=through)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
