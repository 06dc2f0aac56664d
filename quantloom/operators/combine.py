"""Weights from factor histories and scores from weights.

A history is one value per (problem keys, signal_date, factor_name): months by
factors, at most a few hundred numbers a side. Closed-form methods are windows;
the two matrix methods solve one small problem per key inside a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.functions.scalar import ratio

CLOSED_FORM = ("equal", "ic_decay", "factor_return_decay", "max_ic")
MATRIX = ("max_icir", "pca")
HALF_LIFE = 6.0
MONTHS = 12


def decay_weight(age: Column, half_life: float = HALF_LIFE) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def align_signs(rows: DataFrame, signs: DataFrame, value: str, on: Sequence[str] = ("factor_name",)) -> DataFrame:
    return rows.join(signs, list(on)).withColumn(value, F.col(value) * F.col("sign")).drop("sign")


def normalise_nonnegative(df: DataFrame, keys: Sequence[str], weight: str, hot: bool = False) -> DataFrame:
    """max(w, 0) / sum, equal weights when nothing is positive.

    Without keys all rows are one group: the weights of registered factors. ``hot`` is for groups beyond a task.
    """
    positive = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    df = groups.stats(df, keys, {"__total": F.sum(positive), "__n": F.count(F.lit(1))}, hot=hot)
    share = F.when(F.col("__total") > 0, positive / F.col("__total")).otherwise(1.0 / F.col("__n"))
    return df.withColumn(weight, share).drop("__total", "__n")


def last_months(history: DataFrame, keys: Sequence[str], months: int = MONTHS) -> DataFrame:
    """The last dates per key with their age, factors without any value removed, gaps as 0."""
    key_columns = [F.col(k) for k in keys] or [F.lit(0)]
    place = F.dense_rank().over(Window.partitionBy(*key_columns).orderBy(F.desc("signal_date")))
    recent = history.withColumn("age", place - 1).where(F.col("age") < months)
    return recent.withColumn("value", F.coalesce("value", F.lit(0.0))).join(
        recent.groupBy(*keys, "factor_name").agg(F.count("value").alias("__seen")).where("__seen > 0").drop("__seen"),
        [*keys, "factor_name"], "left_semi",
    )


def decayed_mean(history: DataFrame, keys: Sequence[str], half_life: float = HALF_LIFE) -> DataFrame:
    """Exponentially weighted mean per factor over the last months; a missing month counts as 0."""
    recent = last_months(history, keys)
    weight = decay_weight(F.col("age"), half_life)
    ages = recent.select(*keys, "age").distinct().groupBy(*keys).agg(F.sum(weight).alias("__total"))
    sums = recent.groupBy(*keys, "factor_name").agg(F.sum(weight * F.col("value")).alias("__sum"))
    joined = sums.join(ages, list(keys)) if keys else sums.withColumn("__total", ages.scalar())
    return joined.select(*keys, "factor_name", ratio("__sum", "__total").alias("mean"))


def factor_weights(history: DataFrame, method: str, keys: Sequence[str] = (), half_life: float = HALF_LIFE) -> DataFrame:
    """keys, factor_name, weight: non-negative and summing to one per key."""
    keys = list(keys)
    if method in MATRIX:
        return _matrix_weights(history, method, keys, half_life)
    if method not in CLOSED_FORM:
        raise ValueError(f"unknown weight method {method}")
    means = decayed_mean(history, keys, half_life)
    if method == "equal":
        out = means.withColumn("weight", F.lit(1.0))
    elif method == "max_ic":
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("mean"), "factor_name")
        out = means.withColumn("weight", F.when(F.row_number().over(w) == 1, 1.0).otherwise(0.0))
    else:
        out = means.withColumn("weight", F.col("mean"))
    return normalise_nonnegative(out, keys, "weight").select(*keys, "factor_name", "weight")


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk towards a scaled identity with the optimal intensity."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    cov = x.T @ x / n
    scale = np.trace(cov) / p
    distance = ((cov - scale * np.eye(p)) ** 2).sum() / p
    noise = ((x**2).T @ (x**2) / n - cov**2).sum() / (n * p)
    intensity = 0.0 if distance == 0 else min(noise, distance) / distance
    return (1 - intensity) * cov + intensity * scale * np.eye(p)


def best_ratio(mean: np.ndarray, cov: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Long-only weights with the largest mean over spread.

    The direction solves min w'Cw/2 - mean'w over w >= 0, by cyclic coordinate
    descent; without a positive mean the best single factor is taken.
    """
    if (mean <= 0).all():
        w = np.zeros_like(mean)
        w[np.argmax(mean / np.sqrt(np.maximum(np.diag(cov), 1e-12)))] = 1.0
        return w
    w = np.zeros_like(mean)
    diagonal = np.maximum(np.diag(cov), 1e-12)
    for _ in range(rounds):
        before = w.copy()
        for i in range(len(w)):
            w[i] = max(0.0, w[i] + (mean[i] - cov[i] @ w) / diagonal[i])
        if np.abs(w - before).max() <= 1e-12 * max(1.0, np.abs(w).max()):
            break
    return w


def _matrix_weights(history: DataFrame, method: str, keys: list[str], half_life: float) -> DataFrame:
    recent = last_months(history, keys)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot_table(index="age", columns="factor_name", values="value", aggfunc="first").sort_index(ascending=False)
        x = table.fillna(0.0).to_numpy()
        weight = 0.5 ** (np.arange(len(x) - 1, -1, -1) / half_life)
        mean = np.average(x, axis=0, weights=weight)
        if method == "max_icir":
            w = best_ratio(mean, shrunk_covariance(x) if len(x) >= 2 else np.eye(len(mean)))
        else:
            first = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
            w = first * (np.sign(first @ mean) or 1.0)
        w = np.maximum(w, 0.0)
        w = w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))
        out = pd.DataFrame({"factor_name": table.columns, "weight": w})
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "factor_name", "weight"]]

    kinds = {f.name: f.dataType.simpleString() for f in history.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["factor_name string", "weight double"])
    grouped = recent.groupBy(*keys) if keys else recent.groupBy(F.lit(0).alias("__one"))
    return grouped.applyInPandas(solve, schema)


def combine_scores(rows: DataFrame, weights: DataFrame, keys: Sequence[str] = ("signal_date",), value: str = "value", absolute: bool = False) -> DataFrame:
    """Weighted mean over the factors a security has; ``absolute`` divides by the sum of |w| for signed weights.

    ``weights`` has factor_name and weight plus any of ``keys`` (and methods); it is factor-sized.
    """
    shared = [k for k in (*keys, "factor_name") if k in weights.columns]
    extra = [c for c in weights.columns if c not in (*shared, "weight")]
    joined = rows.join(weights, shared)
    present = F.col(value).isNotNull()
    size = F.abs("weight") if absolute else F.col("weight")
    # one security and date hold at most one row per factor
    return joined.groupBy(*keys, *extra, "symbol").agg(
        ratio(F.sum(F.when(present, F.col(value) * F.col("weight"))), F.sum(F.when(present, size))).alias("score")
    )


def walk_forward_history(history: DataFrame, dates: DataFrame, keys: Sequence[str], months: int = MONTHS) -> DataFrame:
    """For every decision date the rows of the ``months`` dates strictly before it (per key)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("signal_date")
    known = history.select(*keys, "signal_date").distinct()
    numbered = known.withColumn("__no", F.row_number().over(w))
    asked = dates.select(*keys, F.col("signal_date").alias("decision_date"))
    # each history date serves the next ``months`` decisions; both tables are calendar-sized
    before = asked.join(numbered, keys).where(F.col("signal_date") < F.col("decision_date"))
    back = Window.partitionBy(*keys, "decision_date").orderBy(F.desc("__no"))
    window = before.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= months)
    return window.select(*keys, "decision_date", "signal_date").join(history, [*keys, "signal_date"])


def frozen_weights(weights: DataFrame, keys: Sequence[str], freeze_from: str, test_start: str) -> DataFrame:
    """From the test start on, every date uses the last weights decided between freeze and test start."""
    keys = list(keys)
    d = F.col("decision_date")
    early = weights.where(d < F.lit(test_start).cast("date"))
    last = early.where(d >= F.lit(freeze_from).cast("date")).groupBy(*keys).agg(F.max("decision_date").alias("__last"))
    held = early.join(last, keys).where(d == F.col("__last")).drop("decision_date", "__last")
    later = weights.where(d >= F.lit(test_start).cast("date")).select(*keys, "decision_date").distinct()
    return early.withColumn("frozen", F.lit(False)).unionByName(later.join(held, keys).withColumn("frozen", F.lit(True)))


# --- learned weights -----------------------------------------------------------------


ML_FEATURES = ("mean12", "mean3", "mean6", "spread", "last", "low", "high", "place", "breadth")


def learning_rows(history: DataFrame, months: int | None = None) -> DataFrame:
    """Per factor and month: features of its previous 12 values, the target, and the final scoring row (null target).

    ``months`` keeps only the last so many dates; all of them if not given.
    """
    rows = history
    if months is not None:
        recent = history.select("signal_date").distinct().orderBy(F.desc("signal_date")).limit(months)
        rows = history.join(recent, "signal_date")
    month = Window.partitionBy("signal_date")
    rows = rows.withColumns(
        {
            "breadth": F.avg("value").over(month),
            "place": F.row_number().over(month.orderBy("value", "factor_name")) / F.count("value").over(month),
        }
    )
    closing = rows.select("factor_name").distinct().withColumns({"signal_date": F.lit("9999-12-31").cast("date")})
    rows = rows.unionByName(closing, allowMissingColumns=True)
    own = Window.partitionBy("factor_name").orderBy("signal_date")
    past = own.rowsBetween(-MONTHS, -1)
    out = rows.select(
        "factor_name",
        "signal_date",
        F.col("value").alias("target"),
        F.count("value").over(past).alias("__n"),
        F.avg("value").over(past).alias("mean12"),
        F.avg("value").over(own.rowsBetween(-3, -1)).alias("mean3"),
        F.avg("value").over(own.rowsBetween(-6, -1)).alias("mean6"),
        F.stddev_pop("value").over(past).alias("spread"),
        F.lag("value").over(own).alias("last"),
        F.min("value").over(past).alias("low"),
        F.max("value").over(past).alias("high"),
        F.lag("place").over(own).alias("place"),
        F.lag("breadth").over(own).alias("breadth"),
    )
    return out.where(F.col("__n") == MONTHS).drop("__n")


def learned_weights(history: DataFrame, method: str, *, latest_allowed: str | None = None, minimum_rows: int = 40, **settings) -> DataFrame:
    """Weights from the predicted next value of each factor (positive part, normalised)."""
    from quantloom.operators import models

    if latest_allowed is not None and not history.where(F.col("signal_date") > F.lit(latest_allowed).cast("date")).isEmpty():
        raise ValueError("history reaches past the last date allowed for selection")
    rows = learning_rows(history).persist()
    train = rows.where(F.col("target").isNotNull())
    count = train.count()
    if count < minimum_rows:
        raise ValueError(f"too few training rows: {count} < {minimum_rows}")
    model = models.fit(train, ML_FEATURES, "target", method, models.WEIGHT_MODELS | settings)
    final = rows.where(F.col("signal_date") == F.lit("9999-12-31").cast("date"))
    scored = model.predict(final, "weight").select("factor_name", "weight")
    everyone = history.where(F.col("value").isNotNull()).select("factor_name").distinct().join(scored, "factor_name", "left")
    return normalise_nonnegative(everyone, [], "weight")


def methods_table(history: DataFrame, methods: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    out = None
    for method in methods:
        one = factor_weights(history, method, keys).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return out


def signed(weights: DataFrame, signs: Mapping[str, float]) -> DataFrame:
    sign = F.create_map(*[x for n, s in signs.items() for x in (F.lit(n), F.lit(float(s)))])
    return weights.withColumn("weight", F.col("weight") * F.coalesce(sign[F.col("factor_name")], F.lit(1.0)))
