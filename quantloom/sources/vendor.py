"""Vendor files to canonical tables: fixed-width bars, codes, units, disclosure merge."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.scalar import domestic_code, listed_share, local_day, number, parse_day, security_code
from quantloom.operators import asof, pit
from quantloom.sources.tables import ContractError

# Little-endian record layout of the daily bar files.
HEADER_BYTES = 8
RECORD = np.dtype(
    [("seconds", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("gap1", "<u4"),
     ("volume", "<u4"), ("gap2", "<u4"), ("amount", "<i8"), ("rest", "V24")]
)
PRICE_SCALE = 1000.0
# Unit labels and the multiplier to shares, currency units and ratios.
UNITS = {
    "volume": {"手": 100.0},
    "amount": {"千元": 1000.0},
    "turnover": {"%": 0.01},
    "float_market_cap": {"万元": 10000.0},
}
VENDOR_SCALES = {"volume": 100.0, "amount": 1000.0, "turnover": 0.01, "float_market_cap": 10000.0}


def bar_files(spark: SparkSession, folder: str) -> DataFrame:
    """symbol, length, content of every share's bar file under EXCHANGE/86400/CODE.DAT."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.DAT").option("recursiveFileLookup", "true").load(folder)
    part = r"([A-Z]{2})/86400/([^/]+)\.DAT$"
    exchange, code = F.regexp_extract("path", part, 1), F.regexp_extract("path", part, 2)
    return files.where(listed_share(code, exchange)).select(
        F.concat(code, F.lit("."), exchange).alias("symbol"), "length", "content"
    )


def whole_records(length: str = "length"):
    """True for files made of a header and complete records."""
    return (F.col(length) >= HEADER_BYTES) & ((F.col(length) - HEADER_BYTES) % RECORD.itemsize == 0)


def broken_files(files: DataFrame) -> DataFrame:
    return files.where(~whole_records()).select("symbol", "length")


def decode_bars(files: DataFrame) -> DataFrame:
    """Typed daily bars from file contents; invalid bars are left out.

    A truncated file fails the read; ``broken_files`` lists such files beforehand.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("open", "high", "low", "close")
        for batch in batches:
            for symbol, content in zip(batch["symbol"], batch["content"]):
                rows = np.frombuffer(content, dtype=RECORD, offset=HEADER_BYTES)
                out = {"symbol": symbol, "seconds": rows["seconds"].astype("int64")}
                out |= {n: rows[n] / PRICE_SCALE for n in names}
                out |= {n: rows[n].astype("float64") for n in ("volume", "amount")}
                yield pd.DataFrame(out)

    schema = "symbol string, seconds long, open double, high double, low double, close double, volume double, amount double"
    refused = F.raise_error(F.concat(F.lit("truncated bar file: "), "symbol")).cast("binary")
    raw = files.select("symbol", F.when(whole_records(), F.col("content")).otherwise(refused).alias("content")).mapInPandas(parse, schema)
    return raw.withColumn("trade_date", local_day("seconds")).drop("seconds").where(pit.holds())


def scale_units(df: DataFrame, units: Mapping[str, str]) -> DataFrame:
    """Columns in labelled vendor units to base units."""
    factors = {c: UNITS[c][u] for c, u in units.items() if u in UNITS.get(c, {}) and c in df.columns}
    return df.withColumns({c: F.col(c).cast("double") * F.lit(f) for c, f in factors.items()})


def market_day(bars: DataFrame, factors: DataFrame, basics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vendor daily rows to canonical units, and the bars that lack a positive adjustment factor."""
    joined = bars.join(basics, ["symbol", "trade_date"], "left")
    daily = joined.withColumns({c: F.col(c).cast("double") * F.lit(s) for c, s in VENDOR_SCALES.items() if c in joined.columns})
    good = factors.where(F.col("adjust_factor") > 0)
    return daily, bars.join(good, ["symbol", "trade_date"], "left_anti")


def require_factors(missing: DataFrame) -> None:
    if not missing.isEmpty():
        raise ContractError("bars without a positive adjustment factor")


def listings(parts: list[DataFrame]) -> DataFrame:
    """Listed, delisted and paused lists in one securities table of domestic codes."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.where(domestic_code("symbol")).select("symbol", parse_day("list_date").alias("list_date"), parse_day("delist_date").alias("delist_date"))


INDICATOR_FIELDS = {"eps": "eps", "bps": "bps", "ocfps": "ocfps", "roe": "roe", "grossprofit_margin": "gross_margin"}
INCOME_FIELDS = {"revenue": "revenue", "n_income_attr_p": "net_profit"}


def merge_disclosures(indicator: DataFrame, income: DataFrame, start: str | None = None) -> DataFrame:
    """Stack two vendor statements and carry each field forward per period as releases arrive.

    Only consolidated reports (type 1) count; a release is known from the later
    of its two announcement dates.
    """
    parts = []
    for frame, fields in ((indicator, INDICATOR_FIELDS), (income, INCOME_FIELDS)):
        if "report_type" in frame.columns:
            frame = frame.where(F.col("report_type").cast("string").isin("1", "1.0"))
        known = parse_day("ann_date")
        if "f_ann_date" in frame.columns:
            known = F.greatest(known, parse_day("f_ann_date"))
        values = [number(s).alias(c) if s in frame.columns else F.lit(None).cast("double").alias(c) for s, c in fields.items()]
        parts.append(frame.select(F.col("ts_code").alias("symbol"), parse_day("end_date").alias("stat_date"), known.alias("available_date"), *values))
    stacked = parts[0].unionByName(parts[1], allowMissingColumns=True)
    fields = [c for c in stacked.columns if c not in ("symbol", "stat_date", "available_date")]
    merged = pit.carry_forward(stacked, ["symbol", "stat_date"], "available_date", fields)
    merged = merged.groupBy("symbol", "stat_date", "available_date").agg(*[F.max(c).alias(c) for c in fields])
    return merged if start is None else merged.where(F.col("available_date") >= F.lit(start).cast("date"))


def local_contract(
    constituents: DataFrame, stocks: DataFrame, index_daily: DataFrame, aux: DataFrame, fundamentals: DataFrame, industry: DataFrame
) -> dict[str, DataFrame]:
    """Canonical tables from vendor frames, restricted to securities that were ever index members."""
    snapshots = constituents.select(
        "index_code", security_code("code").alias("symbol"), parse_day("updateDate").alias("snapshot_date")
    )
    universe = snapshots.select("symbol").distinct()

    def inside(df: DataFrame) -> DataFrame:
        return df.withColumn("symbol", security_code("code")).join(universe, "symbol", "left_semi")

    securities = inside(stocks).select(
        "symbol", parse_day("ipoDate").alias("list_date"), parse_day("outDate").alias("delist_date"))
    current = inside(industry).select(
        "symbol",
        F.coalesce("industry", F.lit("UNKNOWN")).alias("industry_code"),
        F.coalesce("industry", F.lit("UNKNOWN")).alias("industry_name"),
        parse_day("updateDate").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.lit("current_snapshot_only").alias("source"),
        F.lit("snapshot").alias("version"),
    )
    return {
        "index_members": asof.snapshot_intervals(snapshots),
        "securities": pit.newest(securities, ["symbol"], ["list_date", "delist_date"]),
        "calendar": index_daily.select(parse_day("date").alias("trade_date")).distinct().withColumn("is_open", F.lit(True)),
        "status": inside(aux).select(
            parse_day("date").alias("trade_date"),
            "symbol",
            (F.coalesce(number("isST"), F.lit(0.0)) != 0).alias("is_st"),
            F.lit(False).alias("is_pt"),
            (F.coalesce(number("tradestatus"), F.lit(0.0)) != 1).alias("is_suspended"),
            F.lit(False).alias("limit_up"),
            F.lit(False).alias("limit_down"),
        ),
        "fundamentals": inside(fundamentals).withColumnRenamed("avail_date", "available_date").drop("code"),
        "industries": pit.newest(current, ["symbol"], ["valid_from", "industry_code"]),
    }


def dividend_adjustments(events: DataFrame) -> DataFrame:
    """Cumulative factor per symbol from dated event factors (the newest of duplicate events counts)."""
    from quantloom.functions.rolling import running_product

    unique = pit.newest(events.select("symbol", F.col("ex_date").alias("trade_date"), "factor", "entry"), ["symbol", "trade_date"], ["entry"])
    return unique.select("trade_date", "symbol", running_product("factor").alias("adjust_factor"))


def dividend_summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("symbol").alias("symbols"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.min("factor").alias("lowest_factor"),
        F.max("factor").alias("highest_factor"),
    )
