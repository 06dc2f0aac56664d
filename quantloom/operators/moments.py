"""Moments and medians of features that add up over time, for any number of training samples.

Rows belong to spans of dates, cut at given edges. Moments are one small matrix per span: every
task adds up products of its rows about a common shift, tasks are added, and a sample that
begins and ends at edges is a difference of two running sums. A row that lacks a value counts
in a second column per feature, so any filling of gaps is a linear map of the matrix and needs no
second look at the rows. Medians of all samples that end at an edge come from one sort of the
distinct values with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import stored

SPAN = "__span"


def with_span(rows: DataFrame, edges: Sequence, date: str = "signal_date") -> DataFrame:
    """Rows with the number of edges that are not after their date. ``edges`` are a few dates, ascending."""
    if not edges:
        return rows.withColumn(SPAN, F.lit(0))
    return rows.withColumn(SPAN, F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(date))))


@dataclass(frozen=True)
class Moments:
    """Per span the products of (1, features with 0 for gaps, gaps, label), features and label less their ``shift``."""

    names: tuple[str, ...]
    shift: np.ndarray
    spans: np.ndarray

    def before(self, edge: int) -> np.ndarray:
        """Products over all rows before edge number ``edge`` (from 0)."""
        return self.spans[: edge + 1].sum(axis=0)

    def between(self, first: int, last: int) -> np.ndarray:
        """Products over the rows from edge ``first`` up to edge ``last``."""
        return self.spans[first + 1 : last + 1].sum(axis=0)

    def filled(self, products: np.ndarray, fill: Mapping[str, float]) -> np.ndarray:
        """Products of (1, features, label), less their shift, after gaps take the values of ``fill``."""
        p = len(self.names)
        turn = np.zeros((p + 2, 2 * p + 2))
        turn[0, 0] = turn[p + 1, 2 * p + 1] = 1
        for j, name in enumerate(self.names):
            turn[j + 1, j + 1] = 1
            turn[j + 1, p + j + 1] = fill.get(name, 0.0) - self.shift[j]
        return turn @ products @ turn.T


def moments(rows: DataFrame, names: Sequence[str], label: str, spans: int = 1) -> Moments:
    """Moments of the rows that have a label, by their span (0 to ``spans`` - 1; 0 for rows without the column)."""
    rows = rows if SPAN in rows.columns else rows.withColumn(SPAN, F.lit(0))
    rows = rows.where(F.col(label).isNotNull()).select(F.col(SPAN).cast("int").alias(SPAN), *[F.col(c).cast("double").alias(c) for c in (*names, label)])
    means = rows.agg(*[F.avg(c).alias(f"m{j}") for j, c in enumerate((*names, label))]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    size = 2 * len(names) + 2
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            span = batch.column(0).to_numpy()
            values = np.column_stack([pc.fill_null(c, np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[1:]]) - shift
            gaps = np.isnan(values[:, :-1])
            z = np.column_stack([np.ones(len(span)), np.where(gaps, 0.0, values[:, :-1]), gaps, values[:, -1]])
            for s in np.unique(span).tolist():
                part = z[span == s]
                total[s] = total.get(s, 0.0) + part.T @ part
        for s, matrix in total.items():
            n = len(upper[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(matrix[upper])], names=["span", "i", "v"])

    found = np.zeros((spans, size, size))
    for r in rows.mapInArrow(partial, "span int, i int, v double").groupBy("span", "i").agg(F.sum("v").alias("v")).collect():
        a, b = upper[0][r["i"]], upper[1][r["i"]]
        found[r["span"], a, b] = found[r["span"], b, a] = r["v"]
    return Moments(tuple(names), shift, found)


def medians(rows: DataFrame, names: Sequence[str], spans: int = 1) -> list[dict[str, float]]:
    """Exact medians of each column over the rows of spans 0 to s, for every s. Columns without values are left out."""
    rows = rows if SPAN in rows.columns else rows.withColumn(SPAN, F.lit(0))
    long = rows.select(SPAN, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([SPAN], list(names), "name", "x")
    values = long.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("name", "x", SPAN).agg(F.count(F.lit(1)).alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal values never straddle slices: ``n`` counts them, and a slice is what two boundary values enclose.
    placed = stored(values.repartitionByRange(parts, "name", "x").withColumn("slice", F.spark_partition_id()), "values")
    sizes = placed.groupBy("name", "slice", SPAN).agg(F.sum("n").alias("n"))
    later = sizes.withColumn("upto", F.explode(F.sequence(F.col(SPAN), F.lit(spans - 1)))).groupBy("name", "upto", "slice").agg(F.sum("n").alias("n"))
    sample = Window.partitionBy("name", "upto")
    running = sample.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = later.select("name", "upto", "slice", (F.sum("n").over(running) - F.col("n")).alias("before"), "n", F.sum("n").over(sample).alias("total"))
    place = F.explode(F.array(F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2))).alias("place")
    hits = later.select("name", "upto", "slice", "before", "n", place).where((F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("n")))
    # Two places per column and sample: as small as the answer.
    hits = F.broadcast(hits.select("name", "upto", "slice", (F.col("place") - F.col("before")).alias("place")).groupBy("name", "upto", "slice").agg(F.collect_list("place").alias("places")))
    inside = Window.partitionBy("name", "upto", "slice").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.join(hits, ["name", "slice"]).where(F.col(SPAN) <= F.col("upto")).groupBy("name", "upto", "slice", "places", "x").agg(F.sum("n").alias("n"))
    near = near.withColumn("last", F.sum("n").over(inside))
    share = F.size(F.filter("places", lambda k: (k > F.col("last") - F.col("n")) & (k <= F.col("last"))))
    found = near.withColumn("share", share).where("share > 0").groupBy("name", "upto").agg((F.sum(F.col("x") * F.col("share")) / F.sum("share")).alias("m"))
    out: list[dict[str, float]] = [{} for _ in range(spans)]
    for r in found.collect():
        out[r["upto"]][r["name"]] = r["m"]
    return out
