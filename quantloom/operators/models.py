"""Return models on factor features: exact linear solves and Spark ML trees."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import groups
from quantloom.operators import moments, selection
from quantloom.session import cut, stored

# Model settings on securities and on factor histories.
STOCK_MODELS = {
    "lasso": {"alpha": 0.001},
    "ridge": {"alpha": 1.0},
    "dtree": {"maxDepth": 4, "minInstancesPerNode": 50},
    "rf": {"numTrees": 200, "maxDepth": 6, "minInstancesPerNode": 25},
    "xgb": {"maxIter": 160, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8},
    "lgbm": {"maxIter": 160, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8},
}
WEIGHT_MODELS = {
    "lasso": {"alpha": 0.01},
    "ridge": {"alpha": 1.0},
    "rf": {"numTrees": 200, "maxDepth": 3, "minInstancesPerNode": 5},
    "xgb": {"maxIter": 120, "maxDepth": 2, "stepSize": 0.05, "subsamplingRate": 0.8},
}
LINEAR = ("ols", "ridge", "lasso")
SEED = 42


def feature_matrix(panel: DataFrame, names: Sequence[str], index_code: str | None = None, value: str = "raw_value") -> DataFrame:
    """One row per (signal_date, symbol): a column per factor and the label."""
    rows = panel if index_code is None else panel.where(F.col("index_code") == index_code)
    rows = rows.where(F.col("factor_name").isin(*names))
    label = F.first("forward_return", ignorenulls=True).alias("forward_return")
    wide = rows.groupBy("signal_date", "symbol").pivot("factor_name", list(names)).agg(F.first(value).alias("v"), label)
    labels = F.coalesce(*[F.col(f"{n}_forward_return") for n in names])
    return wide.select("signal_date", "symbol", *[F.col(f"{n}_v").alias(n) for n in names], labels.alias("forward_return"))


def medians(train: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Exact column medians of the training rows (0 where a column is empty)."""
    return dict.fromkeys(names, 0.0) | moments.medians(train, names)[0]


def impute(rows: DataFrame, names: Sequence[str], fill: Mapping[str, float]) -> DataFrame:
    return rows.withColumns({n: F.coalesce(F.col(n), F.lit(float(fill.get(n, 0.0)))) for n in names})


def label_column(rows: DataFrame, mode: str, hot: bool = False) -> DataFrame:
    """The forward return, or its percentile rank inside the month."""
    if mode == "return":
        return rows.withColumn("label", F.col("forward_return"))
    if mode != "rank":
        raise ValueError(f"label mode must be return or rank, got {mode}")
    ranked = groups.ranks(rows, ["signal_date"], "forward_return", ["symbol"], average="label", count="__n", hot=hot)
    return ranked.withColumn("label", F.col("label") / F.col("__n")).drop("__n")


@dataclass(frozen=True)
class Linear:
    names: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        return sum((F.col(n) * float(c) for n, c in zip(self.names, self.coefficients)), F.lit(float(self.intercept)))

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        return rows.withColumn(out, self.column())


@dataclass(frozen=True)
class Trees:
    names: tuple[str, ...]
    model: object

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        ready = VectorAssembler(inputCols=list(self.names), outputCol="__features", handleInvalid="keep").transform(rows)
        return self.model.transform(ready).withColumnRenamed("prediction", out).drop("__features")


def solve_linear(g: np.ndarray, method: str, alpha: float = 0.0, rounds: int = 5000) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from products of (1, features, label): least squares, ridge or lasso.

    Ridge and lasso work on standardised features; alpha multiplies the squared
    norm against the summed errors (ridge) or the L1 norm against half the mean
    squared error (lasso).
    """
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    if method == "ols":
        w = np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
        return w, mean[-1] - mean[:-1] @ w
    scale = np.sqrt(np.maximum(np.diag(xx), 0.0))
    scale[scale < 1e-12] = 1.0
    a, b = xx / np.outer(scale, scale), xy / scale
    if method == "ridge":
        w = np.linalg.solve(a + alpha / n * np.eye(len(b)), b)
    else:
        w = np.zeros(len(b))
        for _ in range(rounds):
            before = w.copy()
            for i in range(len(w)):
                if a[i, i] <= 0:
                    continue
                r = b[i] - a[i] @ w + a[i, i] * w[i]
                w[i] = np.sign(r) * max(abs(r) - alpha, 0.0) / a[i, i]
            if np.abs(w - before).max() < 1e-12:
                break
    w = w / scale
    return w, mean[-1] - mean[:-1] @ w


def linear(found: moments.Moments, products: np.ndarray, fill: Mapping[str, float], method: str, options: Mapping) -> Linear:
    """The linear model of a sample given by its moments, gaps filled."""
    w, intercept = solve_linear(found.filled(products, fill), method, options.get("alpha", 0.0))
    return Linear(found.names, tuple(w), float(intercept + found.shift[-1] - found.shift[:-1] @ w))


def fit(train: DataFrame, names: Sequence[str], label: str, method: str, settings: Mapping = STOCK_MODELS) -> Linear | Trees:
    """Fit on complete rows."""
    options = dict(settings.get(method, {}))
    names = tuple(names)
    if method in LINEAR:
        found = moments.moments(train, names, label)
        return linear(found, found.before(0), {}, method, options)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

    kinds = {"dtree": DecisionTreeRegressor, "rf": RandomForestRegressor, "xgb": GBTRegressor, "lgbm": GBTRegressor}
    if method not in kinds:
        raise ValueError(f"unknown model {method}")
    estimator = kinds[method](featuresCol="__features", labelCol=label, seed=SEED, **options)
    ready = VectorAssembler(inputCols=list(names), outputCol="__features").transform(settled(train, names, label)).select("__features", label)
    return Trees(names, estimator.fit(ready))


#: Columns that tell training rows apart.
ROW_KEYS = ("signal_date", "symbol", "factor_name", "index_code")
#: Training rows of one task: boosting runs some hundred jobs over them, one after the other.
ROWS_PER_PART = 50_000


def settled(train: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """``train`` stored in a layout that follows from its rows alone.

    Trees draw rows and columns with one seed per partition, in the order of rows. Dealt by a
    hash of their key to as many parts as they fill and sorted, the same rows give the same draws
    however they came, whatever the session's number of shuffle partitions.
    """
    keys = [c for c in ROW_KEYS if c in train.columns]
    columns = list(dict.fromkeys([*keys, *names, label]))
    parts = max(1, math.ceil(train.count() / ROWS_PER_PART))
    dealt = train.select(*columns).repartition(parts, *(keys or columns))
    return cut(dealt.sortWithinPartitions(*columns))


def fit_errors(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rows with a label, and the root mean squared errors of the predictions and of the labels' mean."""
    known = rows.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    error = F.col(label) - F.col(prediction)
    return known.agg(F.count(F.lit(1)).alias("rows"), F.sqrt(F.avg(error * error)).alias("model_error"), F.stddev_pop(label).alias("constant_error"))


MINIMUM_TRAINING = 60


def training_rows(rows: DataFrame, period: tuple[str, str], label_ends: DataFrame | None = None) -> DataFrame:
    """Rows inside the development period whose label, too, ends inside it."""
    start, end = (F.lit(d).cast("date") for d in period)
    train = rows.where(F.col("signal_date").between(start, end))
    if label_ends is not None:
        known = label_ends.where(F.col("label_end_date") <= end).select("signal_date")
        train = train.join(known, "signal_date", "left_semi")
    return train


@dataclass(frozen=True)
class Sample:
    """Development rows, stored, with what the models of one run share."""

    names: tuple[str, ...]
    rows: DataFrame
    count: int
    fill: dict[str, float]

    @cached_property
    def moments(self) -> moments.Moments:
        return moments.moments(self.rows, self.names, "label")


def frozen_sample(
    features: DataFrame, names: Sequence[str], periods: Mapping[str, tuple[str, str]], *,
    label_mode: str = "return", label_ends: DataFrame | None = None, hot: bool = False,
) -> Sample:
    """The training sample of ``frozen``: written and counted once for any number of models."""
    labelled = label_column(features, label_mode, hot)
    train = training_rows(labelled, periods["development"], label_ends)
    train = stored(train.select("signal_date", "symbol", *names, "label"), "training")
    selection.check_isolation(train, periods["test"][0])
    count = train.count()
    if count < MINIMUM_TRAINING:
        raise ValueError(f"development sample too small: {count}")
    return Sample(tuple(names), train, count, medians(train, names))


def frozen(
    features: DataFrame,
    names: Sequence[str],
    periods: Mapping[str, tuple[str, str]],
    method: str,
    *,
    label_mode: str = "return",
    label_ends: DataFrame | None = None,
    hot: bool = False,
    settings: Mapping = STOCK_MODELS,
    sample: Sample | None = None,
) -> tuple[DataFrame, dict]:
    """Fit once on development rows and score every row, labelled or not.

    ``sample``, the training rows of the same arguments, saves preparing them for every model.
    """
    if sample is None:
        sample = frozen_sample(features, names, periods, label_mode=label_mode, label_ends=label_ends, hot=hot)
    fill = sample.fill
    if method in LINEAR:
        model = linear(sample.moments, sample.moments.before(0), fill, method, settings.get(method, {}))
    else:
        model = fit(impute(sample.rows, names, fill).where(F.col("label").isNotNull()), names, "label", method, settings)
    scored = model.predict(impute(features, names, fill))
    return scored.select("signal_date", "symbol", "prediction", "forward_return"), {"train_rows": sample.count, "imputation": fill, "model": model}


#: Fixed value: days after the start of development before the first fit.
GRACE_DAYS = 400


def refit_dates(months: Sequence, start, stop, refit_months: int = 12, minimum: int = 24, grace_days: int = GRACE_DAYS) -> list:
    """Months at which a walk-forward model is fitted again."""
    out, last = [], None
    start = start + dt.timedelta(days=grace_days)
    for i, month in enumerate(months):
        due = last is None or i - last >= refit_months
        if start <= month <= stop and i >= minimum and due:
            out.append(month)
            last = i
    return out


def walk_forward(
    features: DataFrame,
    names: Sequence[str],
    periods: Mapping[str, tuple[str, str]],
    method: str,
    *,
    label_mode: str = "return",
    refit_months: int = 12,
    minimum: int = 24,
    grace_days: int = GRACE_DAYS,
    hot: bool = False,
    settings: Mapping = STOCK_MODELS,
) -> DataFrame:
    """Refit on strictly past rows up to the validation end; each model scores until the next.

    Linear models are solved from running sums of moments, so the rows are read as often for one
    fit as for many, and all are scored in one pass. Trees need the rows of every fit.
    """
    labelled = label_column(features, label_mode, hot)
    months = sorted(r["signal_date"] for r in features.select("signal_date").distinct().collect())
    start, stop = (dt.date.fromisoformat(d) for d in (periods["development"][0], periods["validation"][1]))
    refits = refit_dates(months, start, stop, refit_months, minimum, grace_days)
    keep = ["signal_date", "symbol", "prediction", "forward_return"]
    if not refits:
        return features.withColumn("prediction", F.lit(None).cast("double")).select(*keep)
    past = labelled.where(F.col("signal_date") < F.lit(refits[-1])).select("signal_date", "symbol", *names, "label")
    spanned = stored(moments.with_span(past, refits[:-1]), "training")
    selection.check_isolation(spanned, periods["test"][0])
    fills = [dict.fromkeys(names, 0.0) | m for m in moments.medians(spanned, names, len(refits))]
    if method in LINEAR:
        found = moments.moments(spanned, names, "label", len(refits))
        fitted = [linear(found, found.before(i), fill, method, settings.get(method, {})) for i, fill in enumerate(fills)]
        return score_spans(moments.with_span(features, refits), fitted, fills).select(*keep)
    scored = None
    for i, at in enumerate(refits):
        train = spanned.where(F.col(moments.SPAN) <= i)
        model = fit(impute(train, names, fills[i]).where(F.col("label").isNotNull()), names, "label", method, settings)
        block = features.where(F.col("signal_date") >= F.lit(at))
        if i + 1 < len(refits):
            block = block.where(F.col("signal_date") < F.lit(refits[i + 1]))
        part = model.predict(impute(block, names, fills[i])).select(*keep)
        scored = part if scored is None else scored.unionByName(part)
    early = features.where(F.col("signal_date") < F.lit(refits[0]))
    return early.withColumn("prediction", F.lit(None).cast("double")).select(*keep).unionByName(scored)


def score_spans(rows: DataFrame, fitted: Sequence[Linear], fills: Sequence[Mapping[str, float]]) -> DataFrame:
    """``rows`` with the ``prediction`` of the model of their span; span 0 has none, span i the model i - 1."""
    names = fitted[0].names
    table = [(i + 1, list(map(float, m.coefficients)), [float(f[n]) for n in names], float(m.intercept)) for i, (m, f) in enumerate(zip(fitted, fills, strict=True))]
    schema = f"{moments.SPAN} int, __w array<double>, __fill array<double>, __a double"
    models = F.broadcast(rows.sparkSession.createDataFrame(table, schema))  # one row per fit
    value = sum((F.coalesce(F.col(n).cast("double"), F.col("__fill")[j]) * F.col("__w")[j] for j, n in enumerate(names)), F.col("__a"))
    return rows.join(models, moments.SPAN, "left").withColumn("prediction", value).drop(moments.SPAN, "__w", "__fill", "__a")


def predictions_panel(scored: DataFrame, name: str, index_code: str = "ALL_A") -> DataFrame:
    """Predictions in the shape of a factor panel."""
    return scored.where(F.col("prediction").isNotNull()).select(
        "signal_date", "symbol", F.lit(name).alias("factor_name"), F.col("prediction").alias("raw_value"),
        F.lit(None).cast("double").alias("neutralized_value"), "forward_return", F.lit(index_code).alias("index_code"),
    )


#: What separates words: anything but letters and digits of any script.
NO_WORD = r"[^\p{L}\p{N}]+"


def text_model(documents: DataFrame, text: str, label: str, features: int = 1 << 12):
    """Hashed-word linear text scorer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.regression import LinearRegression

    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=NO_WORD),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features),
        LinearRegression(featuresCol="__tf", labelCol=label, regParam=0.1, solver="l-bfgs", maxIter=20),
    ]
    return Pipeline(stages=stages).fit(documents)


def document_vectors(documents: DataFrame, text: str, out: str = "embedding", features: int = 64) -> DataFrame:
    """Word counts as an array, each word in the place that its hash gives."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NO_WORD), lambda w: w != "")
    places = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % features)

    def counts(p):
        return F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("double"))

    return documents.withColumn(out, F.element_at(F.transform(F.array(places), counts), 1))
