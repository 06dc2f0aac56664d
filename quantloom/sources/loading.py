"""Pruned, padded and filtered loads of the market tables. ``t`` holds canonical DataFrames by name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import asof
from quantloom.sources.tables import padded_range

BASE_COLUMNS = ("trade_date", "symbol", "open", "high", "low", "close", "volume", "amount")


def frequency_inputs(t: Mapping[str, DataFrame], start: str, end: str) -> DataFrame:
    """Adjusted daily bars from 600 days before ``start`` to 15 days after ``end``."""
    columns = [*BASE_COLUMNS, "turnover", "float_market_cap"]
    daily = t["daily"].select(*columns).where(padded_range("trade_date", start, end, 600, 15))
    known = t["adjustments"].where(padded_range("trade_date", "1900-01-01", end, 0, 15))
    return asof.adjust(daily, known)


def adjusted_market(
    t: Mapping[str, DataFrame], start: str | None = None, end: str | None = None, symbols: DataFrame | None = None
) -> DataFrame:
    """Adjusted open and close with trading status, optionally for some symbols."""
    daily = t["daily"].select("trade_date", "symbol", "open", "close", "float_market_cap")
    status = t["status"].select("trade_date", "symbol", "is_suspended", "limit_up", "limit_down")
    known = t["adjustments"]
    low, high = start or "1900-01-01", end or "2200-01-01"
    inside = padded_range("trade_date", low, high, 0, 0)
    daily, status = daily.where(inside), status.where(inside)
    if end is not None:
        known = known.where(padded_range("trade_date", "1900-01-01", end, 0, 0))
    if symbols is not None:
        daily = daily.join(symbols, "symbol", "left_semi")
    bars = asof.attach_latest(daily, known, columns=["adjust_factor"])
    bars = bars.withColumn("adjust_factor", F.coalesce("adjust_factor", F.lit(1.0))).withColumns(
        {"adj_open": F.col("open") * F.col("adjust_factor"), "adj_close": F.col("close") * F.col("adjust_factor")}
    )
    return bars.join(status, ["trade_date", "symbol"], "left")


def padding(lookback: int) -> int:
    return max(45, 2 * lookback + 15)


def research_daily(t: Mapping[str, DataFrame], start: str, end: str, *, lookback: int, extra: Sequence[str] = ()) -> DataFrame:
    """Adjusted bars with only the extra columns the requested factors read."""
    columns = list(dict.fromkeys([*BASE_COLUMNS, *extra]))
    daily = t["daily"].select(*columns).where(padded_range("trade_date", start, end, padding(lookback), 70))
    return asof.adjust(daily, t["adjustments"])


def filtered_daily(daily: DataFrame, start: str, end: str, symbols: DataFrame, extras: DataFrame) -> DataFrame:
    """Bars of some symbols in a date range with turnover and trade status attached."""
    rows = daily.where(padded_range("trade_date", start, end, 0, 0)).join(symbols, "symbol", "left_semi")
    return rows.join(extras, ["trade_date", "symbol"], "left")


def pit_context(t: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Industry intervals and float market cap per (signal_date, symbol)."""
    cap = t["daily"].select(F.col("trade_date").alias("signal_date"), "symbol", "float_market_cap")
    return t["industries"].select("symbol", "industry_code", "valid_from", "valid_to"), cap


def features_on(features: DataFrame, dates: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored features of some signal dates."""
    return features.select("signal_date", "symbol", *columns).join(dates, "signal_date", "left_semi")


def index_members(members: DataFrame, index_codes: Iterable[str]) -> DataFrame:
    return members.where(F.col("index_code").isin(*index_codes))
