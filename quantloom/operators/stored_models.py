"""Models as stored objects: saved with their training end, loaded once per worker, applied to batches.

A model is any object with ``predict`` (or ``transform``) that can be pickled, its class defined in
an installed module or beside the call; reading one runs what was pickled, so load
only what you have written. A stored model is one row
of a Parquet file: its id and version, the end of its training data, the columns it takes, and
its bytes with their digest.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Models are sent to every executor.
MAX_MODEL_BYTES = 256 << 20
ROW = "model_id string, version string, training_end date, columns array<string>, digest string, payload binary"


@dataclass(frozen=True)
class LinearEstimator:
    """Weights on a matrix whose gaps take fixed values."""

    coefficients: np.ndarray
    intercept: float
    fill: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.fill, x) @ self.coefficients + self.intercept


@dataclass(frozen=True)
class StoredModel:
    model_id: str
    version: str
    training_end: dt.date
    columns: tuple[str, ...]
    digest: str
    payload: bytes


def save(spark: SparkSession, folder: str, estimator: object, model_id: str, version: str, training_end: dt.date, columns: Sequence[str]) -> StoredModel:
    """Write a model; a version that is there already is refused."""
    payload = cloudpickle.dumps(estimator)
    if len(payload) > MAX_MODEL_BYTES:
        raise ValueError(f"model {model_id} has {len(payload)} bytes; {MAX_MODEL_BYTES} are allowed")
    row = (model_id, version, training_end, list(columns), hashlib.sha256(payload).hexdigest(), bytearray(payload))
    spark.createDataFrame([row], ROW).coalesce(1).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{model_id}/{version}")
    return load(spark, folder, model_id, version)


def load(spark: SparkSession, folder: str, model_id: str, version: str) -> StoredModel:
    """Read a model's row, without making the object."""
    r = spark.read.schema(ROW).parquet(f"{folder.rstrip('/')}/{model_id}/{version}").first()
    if r is None:
        raise ValueError(f"no model {model_id} of version {version}")
    payload = bytes(r["payload"])
    if hashlib.sha256(payload).hexdigest() != r["digest"]:
        raise ValueError(f"model {model_id} of version {version} is damaged")
    return StoredModel(r["model_id"], r["version"], r["training_end"], tuple(r["columns"]), r["digest"], payload)


_LOADED: dict[str, object] = {}


def _object(model: StoredModel) -> object:
    """The model's object, made once per Python worker."""
    if model.digest not in _LOADED:
        _LOADED.clear()
        _LOADED[model.digest] = pickle.loads(model.payload)
    return _LOADED[model.digest]


def apply(rows: DataFrame, model: StoredModel, out: str = "prediction", *, date: str | None = "signal_date", method: str = "predict") -> DataFrame:
    """``rows`` with what the model gives for them.

    Numeric columns go in as one matrix (gaps as NaN), a single text column as a list of strings.
    ``predict`` gives a number per row, ``transform`` a vector. A row dated before the end of the model's
    training stops the job. ``date=None`` is for rows without a date.
    """
    missing = [c for c in model.columns if c not in rows.columns]
    if missing:
        raise ValueError(f"model {model.model_id} needs the columns {missing}")
    kinds = [rows.schema[c].dataType for c in model.columns]
    texts = [isinstance(k, T.StringType) for k in kinds]
    if any(texts) and len(texts) > 1:
        raise ValueError("a model takes numbers, or one text column")
    kind = T.DoubleType() if method == "predict" else T.ArrayType(T.DoubleType())
    schema = T.StructType([*(f for f in rows.schema if f.name != out), T.StructField(out, kind)])
    kept = [f.name for f in schema][:-1]
    inputs = [F.col(c) if t else F.col(c).cast("double") for c, t in zip(model.columns, texts)]
    asked = rows.select(*kept, *[c.alias(f"__in{i}") for i, c in enumerate(inputs)], *([F.col(date).cast("date").alias("__on")] if date else []))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if date is not None:
                late = [d for d in batch.column("__on").unique().to_pylist() if d is not None and d < m.training_end]
                if late:
                    raise ValueError(f"model {m.model_id} was trained until {m.training_end}, after {min(late)}")
            columns = [batch.column(f"__in{i}") for i in range(len(texts))]
            given = columns[0].to_pylist() if any(texts) else np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
            made = getattr(_object(m), method)(given)
            values = pa.array(np.asarray(made, float)) if method == "predict" else pa.array([list(map(float, v)) for v in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in kept), values.cast(arrow.field(out).type)], schema=arrow)

    return asked.mapInArrow(run, schema)
