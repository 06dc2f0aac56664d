"""Point-in-time reads: what was known, listed and tradable on a date."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import asof


def visible(rows: DataFrame, date: str | Column, event: str = "trade_date", available: str | None = None, *, strict_columns: bool = False) -> DataFrame:
    """Rows whose event and availability are on or before the date."""
    date = F.lit(date).cast("date") if isinstance(date, str) else date
    keep = F.col(event) <= date
    if available is not None:
        if available in rows.columns:
            keep = keep & (F.col(available) <= date)
        elif strict_columns:
            raise ValueError(f"availability column {available} is required")
    return rows.where(keep)


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``. An aggregation, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(best).select(*keys, "__row.*").select(*rows.columns)


def disclosures_on(fundamentals: DataFrame, date: str) -> DataFrame:
    """Newest revision per (symbol, stat_date) known on a date."""
    return newest(visible(fundamentals, date, "available_date"), ["symbol", "stat_date"], ["available_date"])


def intervals_on(intervals: DataFrame, date: str) -> DataFrame:
    return intervals.where(asof.valid_on(F.lit(date).cast("date")))


def point_in_time(rows: DataFrame, date: str) -> DataFrame:
    """A disclosure or interval table as known on a date."""
    if "available_date" in rows.columns:
        return disclosures_on(rows, date) if {"symbol", "stat_date"} <= set(rows.columns) else visible(rows, date, "available_date")
    if {"valid_from", "valid_to"} <= set(rows.columns):
        return intervals_on(rows, date)
    raise ValueError("not a point-in-time table")


def latest_row(rows: DataFrame, date: str, time: str = "trade_date") -> DataFrame:
    """Last row per symbol visible on a date."""
    return newest(visible(rows, date, time), ["symbol"], [time])


def latest_disclosure(fundamentals: DataFrame, date: str) -> DataFrame:
    """Newest period per symbol after revision dedupe, as known on a date."""
    return newest(visible(fundamentals, date, "available_date"), ["symbol"], ["stat_date", "available_date"])


def latest_on_dates(rows: DataFrame, dates: DataFrame, columns: Sequence[str], time: str = "trade_date") -> DataFrame:
    """The latest visible values of every symbol at every signal date (symbols with any history)."""
    spans = asof.latest_intervals(rows, list(columns), time)
    days = dates.select("signal_date").distinct()
    found = asof.covering(days, spans, start="__from", end="__until", last=days.agg(F.max("signal_date")).scalar())
    return found.select("symbol", "signal_date", *columns)


def in_universe(rows: DataFrame, universe: DataFrame, on: Sequence[str] = ("symbol",)) -> DataFrame:
    return rows.join(universe, list(on), "left_semi")


def universe(
    daily: DataFrame,
    signals: DataFrame,
    *,
    members: DataFrame | None = None,
    index_code: str = "ALL_A",
    industries: DataFrame | None = None,
    include_industries: Iterable[str] = (),
    exclude_industries: Iterable[str] = (),
    include_symbols: Iterable[str] = (),
    exclude_symbols: Iterable[str] = (),
) -> DataFrame:
    """(signal_date, symbol) traded on the signal day, in the index, after industry and symbol filters."""
    out = daily.select(F.col("trade_date").alias("signal_date"), "symbol").distinct().join(signals, "signal_date", "left_semi")
    keys = ["signal_date", "symbol"]
    if index_code != "ALL_A":
        active = asof.active_on_dates(members.where(F.col("index_code") == index_code), signals, ["symbol"])
        out = out.join(active, keys, "left_semi")
    if industries is not None and (list(include_industries) or list(exclude_industries)):
        held = asof.active_on_dates(industries, signals, ["symbol", "industry_code"])
        if list(include_industries):
            out = out.join(held.where(F.col("industry_code").isin(*include_industries)), keys, "left_semi")
        if list(exclude_industries):
            out = out.join(held.where(F.col("industry_code").isin(*exclude_industries)), keys, "left_anti")
    if list(include_symbols):
        out = out.where(F.col("symbol").isin(*include_symbols))
    if list(exclude_symbols):
        out = out.where(~F.col("symbol").isin(*exclude_symbols))
    return out


MINIMUM_SESSIONS = 250


def eligible(
    signals: DataFrame, index_code: str, members: DataFrame, securities: DataFrame, status: DataFrame, calendar: DataFrame,
    minimum_sessions: int = MINIMUM_SESSIONS,
) -> DataFrame:
    """Index members on each signal date: listed long enough, not delisted, not under special treatment (unknown = not)."""
    active = asof.active_on_dates(
        members.where(F.col("index_code") == index_code), signals, ["index_code", "symbol", "benchmark_weight"]
    )
    listed = asof.listed_sessions(active, securities, calendar).where(
        (F.col("listed_sessions") >= minimum_sessions)
        & (F.col("list_date") <= F.col("signal_date"))
        & (F.col("delist_date").isNull() | (F.col("delist_date") > F.col("signal_date")))
    )
    flags = status.select(F.col("trade_date").alias("signal_date"), "symbol", "is_st", "is_pt")
    return listed.join(flags, ["signal_date", "symbol"], "left").where(
        ~F.coalesce("is_st", F.lit(False)) & ~F.coalesce("is_pt", F.lit(False))
    )


def tradable_status(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Keep rows with known status that are neither special treatment nor suspended."""
    flags = status.select(F.col("trade_date").alias("signal_date"), "symbol", "is_st", "is_suspended")
    return rows.join(flags, ["signal_date", "symbol"], "left").where(
        F.col("is_st").isNotNull() & F.col("is_suspended").isNotNull() & ~F.col("is_st") & ~F.col("is_suspended")
    )


def priced_pool(bars: DataFrame, securities: DataFrame, calendar: DataFrame, signals: DataFrame, minimum_sessions: int = MINIMUM_SESSIONS) -> DataFrame:
    """All securities listed for enough sessions with a positive close and float cap at the signal."""
    rows = bars.withColumnRenamed("trade_date", "signal_date").join(signals, "signal_date", "left_semi")
    rows = rows.where((F.col("close") > 0) & (F.col("float_market_cap") > 0)).select("signal_date", "symbol", "close", "float_market_cap")
    return asof.listed_sessions(rows, securities, calendar).where(F.col("listed_sessions") >= minimum_sessions)


def period(date: str | Column, periods: dict[str, tuple[str, str]]) -> Column:
    """Name of the inclusive period holding a date, else null."""
    date = F.col(date) if isinstance(date, str) else date
    out = None
    for name, (start, end) in periods.items():
        hit = date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def holds(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> Column:
    """Valid bar: positive prices inside [low, high], no negative volume or amount."""
    o, h, l, c = (F.col(x) for x in (open_, high, low, close))  # noqa: E741
    positive = (o > 0) & (h > 0) & (l > 0) & (c > 0)
    return positive & (h >= F.greatest(o, c, l)) & (l <= F.least(o, c, h)) & (F.col("volume") >= 0) & (F.col("amount") >= 0)


def industry_options(industries: DataFrame) -> DataFrame:
    known = F.trim("industry_code") != ""
    return industries.where(known & (F.upper("industry_code") != "UNKNOWN")).select("industry_code", "industry_name").distinct()


def carry_forward(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Last non-null value of each column within a key as rows arrive."""
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
