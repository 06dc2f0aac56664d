"""Helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the text contracts, and the letters they lower-case.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Python output batches hold about this many text bytes.
BATCH_BYTES = 4 << 20
#: Rows without an id sort after all others.
LAST_ID = 2**63 - 1


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(c, UPPER, LOWER)


def range_of(h: Column, n: int) -> Column:
    """The one of ``n`` equal ranges of the 64-bit numbers that holds ``h``."""
    return F.least(F.floor((h.cast("double") + F.lit(2.0**63)) * F.lit(n / 2.0**64)), F.lit(n - 1)).cast("int")


def shield(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ..., and the new names of ``columns``.

    Operators that return all columns work under these names, so a column of the
    caller can have any name, a repeated one included.
    """
    names = list(df.columns)
    inner = [f"c{i}" for i in range(len(names))]
    return df.toDF(*inner), [inner[names.index(c)] for c in columns]


def unshield(df: DataFrame, names: Sequence[str], **more: str) -> DataFrame:
    """The shielded columns under their own ``names``; ``more`` maps new names to columns of
    ``df`` and takes the place of a column with such a name."""
    picked = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in more]
    return df.select(*picked, *(F.col(c).alias(n) for n, c in more.items()))


def slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` with about ``limit`` bytes of ``text`` each, one row at least."""
    if not batch.num_rows:
        return
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    yield batch.slice(start)


def map_texts(
    df: DataFrame, text: str, keep: Sequence[str], more: Sequence[tuple[str, T.DataType]],
    start: Callable[[], Callable[[list[str | None]], Sequence[pa.Array | Iterable]]], limit: int = BATCH_BYTES, arrow: bool = False,
) -> DataFrame:
    """``keep`` columns plus columns computed from whole texts, in one Arrow pass without a shuffle.

    ``start`` is called once per task and gives the function from a list of texts
    (an Arrow array with ``arrow``) to one array or list per new column.
    """
    source = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(n, t) for n, t in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in more]
        function = start()
        for batch in batches:
            for piece in slices(batch, text, limit):
                made = function(piece.column(text) if arrow else piece.column(text).to_pylist())
                arrays = [m if isinstance(m, pa.Array) else pa.array(m, type=k) for m, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *arrays], names=[*keep, *(n for n, _ in more)])
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one after another."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(np.asarray(starts, np.int64) - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class IdStore:
    """Ids of text chunks, learned once and kept up to a number of chunks."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], limit: int):
        """``learn`` gives the ids of new chunks as little-endian 32-bit numbers."""
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.starts, self.counts, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def rows(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in chunks if c not in self.row]
        if len(self.row) + len(new) > self.limit:
            self.clear()
            new = chunks
        if new:
            ids = self.learn(new)
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
            self.counts = np.concatenate((self.counts, counts))
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u4")))
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        return np.array([self.row[c] for c in chunks], np.int64)

    def encode(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of chunks one after another, and their number per list."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
        rows = self.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        counts = self.counts[rows]
        upto = np.concatenate(([0], np.cumsum(counts)))
        return self.flat[spread(self.starts[rows], counts)], np.diff(upto[offsets - offsets[0]])
