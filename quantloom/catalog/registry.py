"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.catalog.sql import with_ctes
from quantloom.sources.market import Market


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Market], DataFrame]
    keys: tuple[str, ...]
    values: tuple[str, ...]
    sql: str | None
    digits: int

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return shape(self.build(Market(spark, folder)), self.keys, self.values, self.digits)


REGISTRY: dict[str, Query] = {}


def off_midpoint(digits: int) -> float:
    """A shift below the printed digits: prices over quantities often end on an exact
    half, where the last bit of two engines would decide the rounding."""
    return 3.71 / 10 ** (digits + 2)


def shape(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int) -> DataFrame:
    """Keys as they are, numbers rounded and widened so two engines print them alike."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in (*keys, *values):
        kind, c = kinds[name], F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(off_midpoint(digits)), digits) + F.lit(0.0)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def query(
    name: str,
    build: Callable[[Market], DataFrame],
    keys: Sequence[str] | str,
    values: Sequence[str] | str = (),
    *,
    sql: str | None = None,
    ctes: Sequence[str] | str = (),
    extra: dict[str, str] | None = None,
    ints: Sequence[str] | str = (),
    texts: Sequence[str] | str = (),
    digits: int = 8,
) -> None:
    """Register a query. ``values`` are doubles unless named in ``ints`` or ``texts``.

    ``sql`` selects at least the keys and values; the wrapper rounds doubles.
    """
    keys, values, ints, texts, ctes = (tuple(x.split()) if isinstance(x, str) else tuple(x) for x in (keys, values, ints, texts, ctes))
    full = None
    if sql is not None:
        parts = [f'"{k}"' for k in keys]
        for v in values:
            if v in texts:
                parts.append(f'"{v}"')
            elif v in ints:
                parts.append(f'CAST("{v}" AS BIGINT) AS "{v}"')
            else:
                parts.append(f'round(CAST("{v}" AS DOUBLE) + {off_midpoint(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS "{v}"')
        full = with_ctes(f"SELECT {', '.join(parts)} FROM (\n{sql}\n) AS answer", *ctes, extra=extra)
    if name in REGISTRY:
        raise ValueError(f"query {name} registered twice")
    REGISTRY[name] = Query(name, build, keys, values, full, digits)
