"""Statistics of the last rows of one history, all windows in one grouped Arrow pass.

A window function of Spark goes over its whole frame for every row. Here a frame is one row of an
array, and only the rows asked for have one, so long frames at a few dates cost little.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.rolling import lag, rolling

BLOCK = 1 << 20  # array entries held at once


@dataclass(frozen=True)
class Last:
    """``kind`` of ``source`` over the last ``window`` rows, null below ``minimum`` values.

    Kinds: count, mean, spread (sample deviation), highest, and back (the value ``window`` rows
    before). ``observed`` names a column whose rows without a value are left out first; they repeat
    the result of the row before.
    """

    kind: str
    source: str
    window: int
    minimum: int = 1
    observed: str | None = None

    @property
    def out(self) -> str:
        return "_".join(["__last", self.kind, self.source, str(self.window), str(self.minimum), *([self.observed] if self.observed else [])])

    def column(self) -> Column:
        """The same as a window function: where every row is asked for and frames are short, it needs no Python."""
        if self.observed is not None:
            raise ValueError("a window function does not leave rows out")
        if self.kind == "back":
            return lag(self.source, self.window) if self.window else F.col(self.source)
        return rolling(self.source, self.window, self.minimum, {"count": F.count, "mean": F.avg, "spread": F.stddev_samp, "highest": F.max}[self.kind])

    def reduce(self, frame: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of frames, a row each with 0 where nothing is filled, and whether they are known."""
        if self.kind == "back":
            return frame[:, -self.window - 1], filled[:, -self.window - 1]
        frame, filled = frame[:, -self.window :], filled[:, -self.window :]
        n = filled.sum(axis=1)
        some = np.maximum(n, 1)
        if self.kind == "count":
            return n.astype(float), n >= self.minimum
        if self.kind == "mean":
            return frame.sum(axis=1) / some, n >= self.minimum
        if self.kind == "highest":
            return np.where(filled, frame, -np.inf).max(axis=1), n >= self.minimum
        if self.kind != "spread":
            raise ValueError(f"unknown kind {self.kind}")
        # distances to a value of the frame: equal values have no spread at all, not one of rounding
        newest = self.window - 1 - np.argmax(filled[:, ::-1], axis=1)
        off = np.where(filled, frame - frame[np.arange(len(frame)), newest][:, None], 0.0)
        off = np.where(filled, off - (off.sum(axis=1) / some)[:, None], 0.0)
        return np.sqrt((off * off).sum(axis=1) / np.maximum(n - 1, 1)), n >= max(self.minimum, 2)


def _reduce_all(asked: Sequence[Last], values: np.ndarray, seen: np.ndarray, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Statistics of one column at ``places`` of a history; every window is the end of the longest."""
    longest = max(one.window + (one.kind == "back") for one in asked)
    padded = np.concatenate([np.zeros(longest), np.where(seen, values, 0.0)])
    held = np.concatenate([np.zeros(longest, dtype=bool), seen])
    out = [(np.zeros(len(places)), np.zeros(len(places), dtype=bool)) for _ in asked]
    step = max(1, BLOCK // longest)
    for i in range(0, len(places), step):
        index = places[i : i + step, None] + np.arange(1, longest + 1)
        frame, filled = padded[index], held[index]
        for one, (value, known) in zip(asked, out):
            value[i : i + step], known[i : i + step] = one.reduce(frame, filled)
    return out


class Wanted:
    """What some columns read of the last rows; ``add_last`` computes it."""

    def __init__(self) -> None:
        self.asked: dict[str, Last] = {}

    def last(self, kind: str, source: str, window: int, minimum: int = 1, observed: str | None = None) -> Column:
        one = Last(kind, source, window, minimum, observed)
        self.asked[one.out] = one
        return F.col(one.out)


def add_last(df: DataFrame, wanted: Sequence[Last], *, keep: Sequence[str], at: str | None = None, entity: str = "symbol", order: str = "trade_date") -> DataFrame:
    """``keep`` and one column per wanted statistic, for all rows or those where the column ``at`` is true.

    A group is one entity's history: at most one row per trading session.
    """
    wanted, keep = tuple(wanted), list(keep)
    sources = sorted({c for one in wanted for c in (one.source, one.observed) if c is not None})
    flags = [] if at is None else [at]
    groups: dict[tuple[str, str | None], list[Last]] = {}
    for one in wanted:
        groups.setdefault((one.source, one.observed), []).append(one)
    df = df.select(*dict.fromkeys([entity, order, *keep, *flags]), *[F.col(c).cast("double").alias(f"__of_{c}") for c in sources])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(one.out, T.DoubleType()) for one in wanted])

    def reduce(history: pa.Table) -> pa.Table:
        history = history.take(pc.sort_indices(history[order]))
        places = np.arange(len(history))
        if at is not None:
            places = np.flatnonzero(history[at].fill_null(False).to_numpy())
        read = {c: (history[f"__of_{c}"].fill_null(0.0).to_numpy(), history[f"__of_{c}"].is_valid().to_numpy()) for c in sources}
        new = {}
        for (source, observed), asked in groups.items():
            values, seen = read[source]
            some, at_rows = np.ones(len(places), dtype=bool), places
            if observed is not None:
                there = read[observed][1]
                newest = np.cumsum(there)[places] - 1  # place among the observed rows
                some = newest >= 0
                values, seen, at_rows = values[there], seen[there], newest[some]
            for one, (value, known) in zip(asked, _reduce_all(asked, values, seen, at_rows)):
                full, missing = np.zeros(len(places)), np.ones(len(places), dtype=bool)
                full[some], missing[some] = value, ~known
                new[one.out] = pa.array(full, mask=missing)
        return pa.Table.from_arrays([*history.select(keep).take(pa.array(places)).columns, *[new[one.out] for one in wanted]], names=schema.names)

    return df.groupBy(entity).applyInArrow(reduce, schema)
