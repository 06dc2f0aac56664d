"""Path-dependent and order-heavy statistics of one history, in one grouped Arrow pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Step:
    """Exponential average ``out`` of ``source`` (``minus`` subtracts another column first).

    The first non-null value seeds the average, missing values keep it while
    its weight decays, and the result stays null until ``minimum`` values.
    """

    out: str
    source: str
    minimum: int
    span: float | None = None
    alpha: float | None = None
    minus: str | None = None

    @property
    def reads(self) -> tuple[str, ...]:
        return tuple(c for c in (self.source, self.minus) if c is not None)

    def apply(self, history: Mapping[str, np.ndarray]) -> np.ndarray:
        values = history[self.source] if self.minus is None else history[self.source] - history[self.minus]
        alpha = self.alpha if self.alpha is not None else 2.0 / (self.span + 1.0)
        return pd.Series(values).ewm(alpha=alpha, adjust=False, min_periods=self.minimum).mean().to_numpy()


@dataclass(frozen=True)
class Deviation:
    """Mean absolute distance to the mean over the last ``window`` rows, at least ``minimum`` of them."""

    out: str
    source: str
    window: int
    minimum: int
    minus: str | None = None

    @property
    def reads(self) -> tuple[str, ...]:
        return (self.source,)

    def apply(self, history: Mapping[str, np.ndarray]) -> np.ndarray:
        views = _frames(history[self.source], self.window)
        seen = ~np.isnan(views)
        n = seen.sum(axis=1)
        safe = np.maximum(n, 1)
        mean = np.where(seen, views, 0.0).sum(axis=1) / safe
        spread = np.where(seen, np.abs(views - mean[:, None]), 0.0).sum(axis=1) / safe
        return np.where(n >= self.minimum, spread, np.nan)


@dataclass(frozen=True)
class Quotient:
    """``top`` over ``bottom`` of ``back`` rows before, minus ``less``; missing where the divisor is 0."""

    out: str
    top: str
    bottom: str
    back: int = 0
    less: float = 0.0

    @property
    def reads(self) -> tuple[str, ...]:
        return self.top, self.bottom

    def apply(self, history: Mapping[str, np.ndarray]) -> np.ndarray:
        top, bottom = history[self.top], history[self.bottom]
        bottom = np.concatenate([np.full(self.back, np.nan), bottom])[: len(top)]
        return top / np.where(bottom == 0, np.nan, bottom) - self.less


@dataclass(frozen=True)
class Rolling:
    """Mean, or sum, of the values among the last ``window`` rows, at least ``minimum`` of them."""

    out: str
    source: str
    window: int
    minimum: int
    total: bool = False

    @property
    def reads(self) -> tuple[str, ...]:
        return (self.source,)

    def apply(self, history: Mapping[str, np.ndarray]) -> np.ndarray:
        views = _frames(history[self.source], self.window)
        seen = ~np.isnan(views)
        n = seen.sum(axis=1)
        total = np.where(seen, views, 0.0).sum(axis=1)
        return np.where(n >= self.minimum, total if self.total else total / np.maximum(n, 1), np.nan)


def _frames(values: np.ndarray, window: int) -> np.ndarray:
    """The last ``window`` values of every row, missing before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window - 1, np.nan), values]), window)


def add_averages(
    df: DataFrame, steps: Sequence[Step | Deviation | Quotient | Rolling], *, entity: str = "symbol", order: str = "trade_date", at: str | None = None
) -> DataFrame:
    """Append every step's column, later steps may read earlier ones; for all rows or those where the column ``at`` is true.

    A group is one entity's history: at most one row per trading session. It stays an Arrow
    table; only the columns that steps read become arrays, missing values NaN. What follows has
    to shuffle again by entity, so windows over a step's column are better steps themselves.
    """
    steps = tuple(steps)
    if not steps:
        return df if at is None else df.where(at)
    schema = T.StructType(df.schema.fields + [T.StructField(step.out, T.DoubleType()) for step in steps])

    made = {step.out for step in steps}
    read = {c for step in steps for c in step.reads if c not in made}

    def smooth(history: pa.Table) -> pa.Table:
        history = history.take(pc.sort_indices(history[order]))
        values = {c: history[c].cast(pa.float64()).to_numpy() for c in read}
        for step in steps:
            values[step.out] = step.apply(values)
        places = slice(None)
        if at is not None:
            places = np.flatnonzero(history[at].fill_null(False).to_numpy())
            history = history.take(pa.array(places))
        new = [pa.array(values[step.out][places], from_pandas=True) for step in steps]
        return pa.Table.from_arrays([*history.columns, *new], names=[*history.column_names, *[step.out for step in steps]])

    return df.groupBy(entity).applyInArrow(smooth, schema)
