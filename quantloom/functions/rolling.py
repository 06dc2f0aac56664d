"""Row-window helpers over one history per entity.

A history holds at most one row per entity and trading session, so a window
partition is never longer than the trading calendar.

Two conventions exist and both are kept:
* ``rolling`` counts rows and skips nulls inside the frame;
* formula operators first drop rows whose input is null, then take the last N
  observations (see ``operators.formula``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from quantloom.functions.scalar import col, ratio


def history(entity: str = "symbol", order: str = "trade_date") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(order)


def frame(window: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or history()).rowsBetween(-(window - 1), 0)


def so_far(w: WindowSpec | None = None) -> WindowSpec:
    return (w or history()).rowsBetween(Window.unboundedPreceding, 0)


def rolling(
    c: str | Column, window: int, minimum: int | None, fn: Callable[[Column], Column] = F.avg, w: WindowSpec | None = None
) -> Column:
    """``fn`` over the last ``window`` rows, null below ``minimum`` non-null values."""
    c = col(c)
    if minimum is None:
        minimum = max(3, int(window * 0.8))
    over = frame(window, w)
    return F.when(F.count(c).over(over) >= minimum, fn(c).over(over))


def sample_std(c: Column) -> Column:
    return F.stddev_samp(c)


def lag(c: str | Column, periods: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(c), periods).over(w or history())


def change(c: str | Column, periods: int = 1, w: WindowSpec | None = None) -> Column:
    """c[t] / c[t - periods] - 1."""
    return ratio(col(c), lag(c, periods, w)) - 1


def running(fn: Callable[[Column], Column], c: str | Column, w: WindowSpec | None = None) -> Column:
    return fn(col(c)).over(so_far(w))


def running_product(c: str | Column, w: WindowSpec | None = None) -> Column:
    """Cumulative product of positive numbers."""
    return F.exp(F.sum(F.ln(col(c))).over(so_far(w)))
