"""As-of attachment, validity intervals and the trading calendar.

Everything keyed by security stays an equi join or a window on the security;
calendar-sized tables are at most one row per session and joined by date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_latest(
    left: DataFrame,
    right: DataFrame,
    *,
    on: str = "symbol",
    left_time: str = "trade_date",
    right_time: str = "trade_date",
    columns: Sequence[str],
    strict: bool = False,
) -> DataFrame:
    """Attach to each left row the newest right row with time <= its own (< when strict).

    Both sides are stacked and one window per entity carries the last right
    payload forward; a right row on the same day counts as already known.
    The partition is one entity's history.
    """
    keep = left.columns
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    known = right.where(F.col(right_time).isNotNull()).select(
        F.col(on).alias("__entity"),
        F.col(right_time).alias("__time"),
        F.lit(1 if strict else 0).alias("__side"),
        payload.alias("__known"),
    )
    asked = left.select(
        F.col(on).alias("__entity"),
        F.col(left_time).alias("__time"),
        F.lit(0 if strict else 1).alias("__side"),
        F.struct(*[F.col(c).alias(c) for c in keep]).alias("__row"),
    )
    w = Window.partitionBy("__entity").orderBy("__time", "__side").rowsBetween(Window.unboundedPreceding, 0)
    stacked = asked.unionByName(known, allowMissingColumns=True)
    filled = stacked.withColumn("__last", F.last("__known", ignorenulls=True).over(w))
    # entity and time come back as plain columns, so later windows reuse this shuffle and sort
    plain = {left_time: F.col("__time"), on: F.col("__entity")}
    kept = [plain[c].alias(c) if c in plain else F.col(f"__row.{c}").alias(c) for c in keep]
    return filled.where(F.col("__row").isNotNull()).select(*kept, *[F.col(f"__last.{c}").alias(c) for c in columns])


def adjust(daily: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Backward as-of adjustment factor (1 before the first event) and adjusted prices."""
    out = attach_latest(daily, adjustments, columns=["adjust_factor"])
    out = out.withColumn("adjust_factor", F.coalesce("adjust_factor", F.lit(1.0)))
    return out.withColumns({f"adj_{c}": F.col(c) * F.col("adjust_factor") for c in ("open", "high", "low", "close")})


def valid_on(date: str | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    date = F.col(date) if isinstance(date, str) else date
    return (F.col(start) <= date) & (F.col(end).isNull() | (F.col(end) >= date))


def _bin(c: Column, months: int) -> Column:
    return F.floor((F.year(c) * 12 + F.month(c)) / months).cast("int")


def covering(points: DataFrame, intervals: DataFrame, on: Sequence[str] = (), *, date: str = "signal_date", start: str = "valid_from", end: str = "valid_to", last: Column | None = None, months: int = 1) -> DataFrame:
    """Every point with every interval of its keys that holds its date; ends are inclusive, a null end is open.

    A range join binned by month (or ``months``): an interval stands once in each bin it crosses,
    meets the points of that bin and its keys by equality, and is then tested exactly. A point so
    meets the intervals around its own bin only. Open intervals reach one bin beyond all
    dates of the intervals, and later points count to that bin; ``last``, a date that no point
    passes, saves reading the intervals for it. Columns of the intervals other than the keys must differ
    from those of the points. Without keys the points are distinct dates, at most one per day of
    the calendar, and are sent to all tasks.
    """
    binned, horizon = _binned(intervals, start, end, last, months)
    asked = points.withColumn("__bin", F.least(_bin(F.col(date), months), horizon))
    met = asked.join(binned.hint("merge"), [*on, "__bin"]) if on else F.broadcast(asked).join(binned, "__bin")
    met = met.where((F.col(start) <= F.col(date)) & (F.col(end).isNull() | (F.col(end) >= F.col(date))))
    return met.drop("__bin")


def _binned(intervals: DataFrame, start: str, end: str, last: Column | None, months: int) -> tuple[DataFrame, Column]:
    """``intervals`` once per bin that they cross, and the last bin."""
    if last is None:
        last = F.add_months(intervals.agg(F.greatest(F.max(start), F.max(end))).scalar(), months)
    horizon = _bin(last, months)
    held = intervals.where((F.col(start) <= F.col(end)) | F.col(end).isNull()).where(F.col(start) <= last)
    until = F.least(_bin(F.coalesce(F.col(end), last), months), horizon)
    return held.withColumn("__bin", F.explode(F.sequence(_bin(F.col(start), months), until))), horizon


def attach_interval(left: DataFrame, intervals: DataFrame, columns: Sequence[str], *, date: str = "signal_date", how: str = "left") -> DataFrame:
    """Values of the interval covering each (symbol, date); the latest start wins an overlap.

    The few intervals of a security that cross a month stand in one row, so each
    left row meets one row and the left side is read once. Both sides are shuffled: a
    row per security and month is far more than the size of the intervals lets Spark
    expect, and must not be sent to all tasks through the driver.
    """
    spans = intervals.select("symbol", F.col("valid_from").alias("__a"), F.col("valid_to").alias("__b"), F.struct(*columns).alias("__payload"))
    binned, horizon = _binned(spans, "__a", "__b", None, 1)
    held = F.reverse(F.array_sort(F.collect_list(F.struct("__a", "__b", "__payload"))))
    shelves = binned.groupBy("symbol", "__bin").agg(held.alias("__held"))
    asked = left.withColumn("__bin", F.least(_bin(F.col(date), 1), horizon))
    covers = lambda i: (i["__a"] <= F.col(date)) & (i["__b"].isNull() | (i["__b"] >= F.col(date)))
    found = asked.join(shelves.hint("merge"), ["symbol", "__bin"], "left").withColumn("__best", F.try_element_at(F.filter("__held", covers), F.lit(1)))
    found = found if how == "left" else found.where(F.col("__best").isNotNull())
    return found.select(*left.columns, *[F.col(f"__best.__payload.{c}").alias(c) for c in columns])


def active_on_dates(intervals: DataFrame, dates: DataFrame, columns: Sequence[str], date: str = "signal_date") -> DataFrame:
    """One row per interval row and covered date. ``dates`` is calendar-sized."""
    spans = intervals.select(F.col("valid_from").alias("__a"), F.col("valid_to").alias("__b"), *columns)
    days = dates.select(date).distinct()
    return covering(days, spans, date=date, start="__a", end="__b", last=days.agg(F.max(date)).scalar()).select(*columns, date)


def latest_intervals(rows: DataFrame, columns: Sequence[str], time: str = "trade_date", on: str = "symbol") -> DataFrame:
    """The time for which each row is the entity's latest: ``__from`` its own, ``__until`` the day before the next row's."""
    following = F.lead(time).over(Window.partitionBy(on).orderBy(time))
    known = rows.where(F.col(time).isNotNull())
    return known.select(on, F.col(time).alias("__from"), F.date_sub(following, 1).alias("__until"), *columns)


def snapshot_intervals(snapshots: DataFrame) -> DataFrame:
    """Constituent lists to [snapshot, next snapshot - 1 day] intervals with equal weights."""
    lists = snapshots.groupBy("index_code", "snapshot_date").agg(F.count(F.lit(1)).alias("names"))
    nxt = F.lead("snapshot_date").over(Window.partitionBy("index_code").orderBy("snapshot_date"))
    lists = lists.withColumn("valid_to", F.date_sub(nxt, 1))
    return snapshots.join(lists, ["index_code", "snapshot_date"]).select(
        "index_code",
        "symbol",
        F.col("snapshot_date").alias("valid_from"),
        "valid_to",
        (1.0 / F.col("names")).alias("benchmark_weight"),
    )


# --- calendar ------------------------------------------------------------------


def open_dates(calendar: DataFrame) -> DataFrame:
    return calendar.where("is_open").select(F.to_date("trade_date").alias("trade_date")).where(
        F.col("trade_date").isNotNull()
    ).distinct()


def _calendar_window():
    # One row per session worldwide: a single partition of calendar size.
    return Window.partitionBy(F.lit(0)).orderBy("trade_date")


def numbered_sessions(calendar: DataFrame) -> DataFrame:
    """trade_date, session number from 1, next session."""
    return open_dates(calendar).select(
        "trade_date",
        F.row_number().over(_calendar_window()).alias("session"),
        F.lead("trade_date").over(_calendar_window()).alias("next_session"),
    )


def month_ends(calendar: DataFrame) -> DataFrame:
    return open_dates(calendar).groupBy(F.trunc("trade_date", "MM").alias("month")).agg(
        F.max("trade_date").alias("signal_date")
    ).select("signal_date")


def signal_dates(calendar: DataFrame, frequency: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Last session of each fully covered week (Saturday to Friday) or month, or every session."""
    opened = open_dates(calendar)
    if frequency == "daily":
        out = opened.select(F.col("trade_date").alias("signal_date"))
    else:
        from quantloom.functions.scalar import period_key

        rule = {"weekly": "W-FRI", "monthly": "M"}.get(frequency)
        if rule is None:
            raise ValueError(f"frequency must be daily, weekly or monthly, got {frequency}")
        last = calendar.agg(F.max(F.to_date("trade_date"))).scalar()
        out = (
            opened.groupBy(period_key("trade_date", rule).alias("closes"))
            .agg(F.max("trade_date").alias("signal_date"))
            .where(F.col("closes") <= last)
            .select("signal_date")
        )
    if start is not None:
        out = out.where(F.col("signal_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("signal_date") <= F.lit(end).cast("date"))
    return out


def next_open(signals: DataFrame, calendar: DataFrame, out: str = "execution_date") -> DataFrame:
    """First session strictly after each signal date (null when the calendar ends)."""
    sessions = open_dates(calendar).select(F.col("trade_date").alias("d"), F.lit(True).alias("is_session"))
    asked = signals.select(F.col("signal_date").alias("d"), F.lit(False).alias("is_session")).distinct()
    # Newest first, a signal before the session of its own day: what precedes it is strictly later.
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("d"), F.asc("is_session"))
    later = F.last(F.when(F.col("is_session"), F.col("d")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    looked = sessions.unionByName(asked).withColumn(out, later)
    return signals.join(
        looked.where(~F.col("is_session")).select(F.col("d").alias("signal_date"), out), "signal_date", "left"
    )


def holding_plan(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """signal_date, entry_date (next session), exit_date (next session of the following signal), sequence number."""
    w = Window.partitionBy(F.lit(0)).orderBy("signal_date")
    return (
        next_open(signals.select("signal_date").distinct(), calendar, "entry_date")
        .withColumns({"exit_date": F.lead("entry_date").over(w), "period_no": F.row_number().over(w)})
    )


def next_month_signal(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Last session of the month after each signal; null unless the calendar covers that month."""
    months = open_dates(calendar).groupBy(F.trunc("trade_date", "MM").alias("__month")).agg(
        F.max("trade_date").alias("__end")
    )
    last = calendar.agg(F.max(F.to_date("trade_date"))).scalar()
    following = F.add_months(F.trunc("signal_date", "MM"), 1)
    return (
        signals.withColumn("__next", following)
        .join(months, F.col("__next") == F.col("__month"), "left")
        .select(*signals.columns, F.when(F.last_day("__next") <= last, F.col("__end")).alias("next_signal_date"))
    )


def label_end_dates(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """signal_date, label_end_date: the last price date a forward label needs."""
    return holding_plan(signals, calendar).select("signal_date", F.col("exit_date").alias("label_end_date"))


def forward_open_returns(bars: DataFrame, plan: DataFrame, price: str = "adj_open") -> DataFrame:
    """Open-to-open return per (signal_date, symbol); null when a price is missing.

    Every (session, signal) pair of a plan is matched through the price rows of
    that session, so the join stays an equi join on the date.
    """
    entry = bars.select("symbol", F.col("trade_date").alias("entry_date"), F.col(price).alias("entry_price"))
    leave = bars.select("symbol", F.col("trade_date").alias("exit_date"), F.col(price).alias("exit_price"))
    spans = plan.where(F.col("exit_date").isNotNull()).select("signal_date", "entry_date", "exit_date")
    return (
        entry.join(spans, "entry_date")
        .join(leave, ["symbol", "exit_date"], "left")
        .select(
            "signal_date",
            "symbol",
            "entry_date",
            "exit_date",
            (F.try_divide("exit_price", "entry_price") - 1).alias("forward_return"),
        )
    )


def session_counts(calendar: DataFrame) -> DataFrame:
    """Per calendar day between the first and last session: sessions up to and including it."""
    opened = open_dates(calendar)
    days = opened.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")
    )
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    marked = days.join(opened.withColumnRenamed("trade_date", "day").withColumn("__one", F.lit(1)), "day", "left")
    return marked.select("day", F.sum(F.coalesce("__one", F.lit(0))).over(w).alias("sessions"))


def listed_sessions(rows: DataFrame, securities: DataFrame, calendar: DataFrame, date: str = "signal_date") -> DataFrame:
    """Append list_date, delist_date and the number of sessions in [list_date, date]."""
    counts = session_counts(calendar)
    upto = counts.select(F.col("day").alias(date), F.col("sessions").alias("__upto"))
    before = counts.select(F.date_add("day", 1).alias("list_date"), F.col("sessions").alias("__before"))
    last = counts.agg(F.max("day")).scalar()
    total = counts.agg(F.max("sessions")).scalar()
    listed = securities.select("symbol", "list_date", "delist_date").join(before, "list_date", "left").withColumn(
        "__before", F.coalesce("__before", F.when(F.date_sub("list_date", 1) > last, total), F.lit(0))
    )
    return (
        rows.join(listed, "symbol", "inner")
        .join(upto, date, "left")
        .withColumn("__upto", F.coalesce("__upto", F.when(F.col(date) > last, total), F.lit(0)))
        .withColumn("listed_sessions", F.greatest(F.lit(0), F.col("__upto") - F.col("__before")))
        .select(*rows.columns, "list_date", "delist_date", "listed_sessions")
    )


def dates_array(dates: DataFrame, date: str):
    """All dates as one sorted array column (a scalar subquery over a calendar-sized table)."""
    return dates.agg(F.sort_array(F.collect_set(date))).scalar()


def densify(dates: DataFrame, entities: DataFrame, date: str = "trade_date") -> DataFrame:
    """Every entity on every date: each entity row expands the calendar array (calendar-sized, bounded)."""
    return entities.select(*entities.columns, F.explode(dates_array(dates, date)).alias(date))


def carry_marks(bars: DataFrame, calendar: DataFrame, price: str = "adj_open", sessions: int = 60) -> DataFrame:
    """Marks on the full grid: last positive quote up to ``sessions`` sessions old, then 0, plus an observed flag."""
    grid = densify(open_dates(calendar), bars.select("symbol").distinct())
    quote = bars.select("symbol", "trade_date", F.when(F.col(price) > 0, F.col(price)).alias("quote"))
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-sessions, 0)
    return grid.join(quote, ["symbol", "trade_date"], "left").select(
        "symbol",
        "trade_date",
        F.coalesce(F.last("quote", ignorenulls=True).over(w), F.lit(0.0)).alias("mark"),
        F.col("quote").isNotNull().alias("observed"),
    )


def market_returns(index_daily: DataFrame) -> DataFrame:
    """Index close-to-close returns: index_code, trade_date, market_return."""
    w = Window.partitionBy("index_code").orderBy("trade_date")
    return index_daily.select(
        "index_code", "trade_date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("market_return")
    )


def benchmark_forward(index_daily: DataFrame, plan: DataFrame) -> DataFrame:
    """Index open-to-open return per (index_code, signal_date)."""
    return forward_open_returns(
        index_daily.withColumnRenamed("index_code", "symbol"), plan, price="open"
    ).select(F.col("symbol").alias("index_code"), "signal_date", F.col("forward_return").alias("benchmark_return"))


def marks_on_dates(bars: DataFrame, dates: DataFrame, calendar: DataFrame, price: str = "adj_open", sessions: int = 60) -> DataFrame:
    """``carry_marks`` at some dates only: symbol x dates rows instead of the full grid."""
    numbered = numbered_sessions(calendar).select("trade_date", "session")
    quote = bars.where(F.col(price) > 0).select("symbol", "trade_date", F.col(price).alias("__quote")).join(numbered, "trade_date")
    quote = quote.withColumnRenamed("session", "__seen")
    grid = densify(dates, bars.select("symbol").distinct()).join(numbered, "trade_date")
    known = attach_latest(grid, quote, columns=["__quote", "__seen"])
    fresh = F.col("session") - F.col("__seen") <= sessions
    return known.select("symbol", "trade_date", F.when(fresh, F.col("__quote")).otherwise(F.lit(0.0)).alias("mark"),
                        (F.col("session") == F.col("__seen")).alias("observed"))


def forward_mark_returns(bars: DataFrame, plan: DataFrame, calendar: DataFrame, price: str = "adj_open", sessions: int = 60) -> DataFrame:
    """Forward returns on carried marks: a position without a quote keeps its last one for 60 sessions, then is worth 0.

    From its first quote on a security has a mark on every execution date, so the exit mark
    is the next row of the same security and the marks are built once.
    """
    dates = plan.select("entry_date").where(F.col("entry_date").isNotNull()).distinct()
    numbered = F.broadcast(numbered_sessions(calendar).select("trade_date", "session"))  # one row per session
    quotes = latest_intervals(bars.where(F.col(price) > 0), [price])
    # The session of a quote is looked up where it is needed: at execution dates.
    held = covering(dates, quotes, date="entry_date", start="__from", end="__until", last=dates.agg(F.max("entry_date")).scalar())
    held = held.join(numbered.toDF("entry_date", "__now"), "entry_date").join(numbered.toDF("__from", "__seen"), "__from")
    mark = F.when(F.col("__now") - F.col("__seen") <= sessions, F.col(price)).otherwise(F.lit(0.0))
    w = Window.partitionBy("symbol").orderBy("entry_date")
    marks = held.withColumn("mark", mark).select(
        "symbol", "entry_date", (F.try_divide(F.lead("mark").over(w), "mark") - 1).alias("forward_return"), (F.col("__now") == F.col("__seen")).alias("tradable")
    )
    spans = plan.where(F.col("exit_date").isNotNull()).select("signal_date", "entry_date", "exit_date")
    return marks.where(F.col("forward_return").isNotNull()).join(spans, "entry_date").select(
        "signal_date", "symbol", "entry_date", "exit_date", "forward_return", "tradable"
    )
