"""Best-fit packing of documents into sequences of bounded length.

Every sequence has three capacities: tokens, documents, and attention cost (the sum of squared
lengths). Pieces go, longest first, into the open sequence that suits them best among those in
which all three still suffice: the one with the least weighted norm of what is left, or the one
whose rest has the largest weighted dot product with the piece. A new one is opened only if none fits.

A piece's demands follow from its length, so pieces of one length are alike, and so are sequences
that have been filled in the same way. The plan is made from the number of pieces per
length alone: runs of equal sequences are filled together. It has at most ``capacity`` lengths to
deal with, whatever the number of documents, and is the same as if pieces were placed one by one. Each
piece then finds its place by its rank among the pieces of its length: its number within the
task that cut it, plus those of earlier tasks. Pieces are never sorted or gathered.

Documents longer than the capacity are cut into full pieces; the first takes what is over.

Defined cases: a null or empty text is the end id alone; repeated ids and texts are documents of their
own; rows without an id keep a null id; an empty table gives no sequences; other columns are not
looked at; a piece that fits no empty sequence (its attention cost alone is too high) is refused.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import bpe
from quantloom.llm.common import shield, slices, spread
from quantloom.session import stored

#: Characters encoded at once, and the bytes of a plan that is sent to all tasks.
TEXT_BYTES = 4 << 20
MAX_PLAN_BYTES = 128 << 20
#: Chunks that one call of the encoding library takes.
ASKED_AT_ONCE = 4000
PIECE = "piece int, start long, length long, ids_crc32 long, part int, place long, ids array<int>"


class Limits(NamedTuple):
    """Capacities of a sequence, and the weights of tokens, documents and attention in choosing one.

    Without ``documents`` or ``attention`` these never bind: ``tokens`` pieces of one token fill a
    sequence, and squared lengths that add up to ``tokens`` have no larger sum than its square.
    """

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)

    @property
    def capacities(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


class Plan(NamedTuple):
    """Runs of pieces of one length: those of rank ``rank`` to ``rank`` + ``count`` lie ``each`` to a sequence from
    ``sequence`` on, from ``offset`` within it. In order of length and rank. ``sequences``: how many there are."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(counts: dict[int, int], limits: Limits = Limits(), rule: str = "norm") -> Plan:
    """Sequences for ``counts`` pieces per length, by the least ``norm`` left or the largest ``dot`` product."""
    capacity = limits.capacities
    weights = np.array(limits.weights)
    left = np.empty((64, 3), np.int64)
    runs = np.empty((64, 2), np.int64)
    n = total = 0
    made = []

    def scores(rest: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Small for sequences that suit; not finite where ``need`` does not fit."""
        if rule == "norm":
            value = (weights * ((rest - need) / capacity) ** 2).sum(axis=1)
        elif rule == "dot":
            value = -(weights * (rest / capacity) * (need / capacity)).sum(axis=1)
        else:
            raise ValueError(f"unknown rule {rule}")
        return np.where((rest >= need).all(axis=1), value, np.inf)

    def add(first: int, size: int, rest: np.ndarray) -> None:
        nonlocal left, runs, n
        if n == len(left):
            left, runs = np.concatenate([left, np.empty_like(left)]), np.concatenate([runs, np.empty_like(runs)])
        runs[n], left[n] = (first, size), rest
        n += 1

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length**2])
        if (need > capacity).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        todo, rank = counts[length], 0
        value = scores(left[:n], need)
        while todo:
            at = int(np.argmin(value)) if n and value.min() < np.inf else None
            if at is None:
                rest, first, size, others = capacity, total, todo, np.inf
            else:
                rest, (first, size) = left[at].copy(), runs[at].tolist()
                others = value.min() if size > 1 else np.delete(value, at).min(initial=np.inf)
            # A sequence takes more of this length as long as it suits no worse than any other.
            each, after = 1, rest - need
            while each < todo and (again := scores(after[None], need)[0]) < np.inf and again <= others:
                each, after = each + 1, after - need
            whole = min(size, todo // each)
            made.append((length, rank, whole * each, first, each, capacity[0] - rest[0]))
            todo, rank = todo - whole * each, rank + whole * each
            if at is not None and whole == size:
                left[at] = after
                value[at] = scores(after[None], need)[0]
                continue
            if at is None:
                total += whole
            else:
                runs[at] = first + whole, size - whole
            add(first, whole, after)
            value = np.append(value, scores(after[None], need))
    columns = np.array(sorted(made), np.int64).reshape(-1, 6).T
    return Plan(*columns, total)


class Encoder(bpe.ByteBpe):
    """``bpe.ByteBpe`` whose new chunks are encoded by a compiled library, many in one call.

    A chunk of one space and letters always begins a piece, and only its first token
    begins with a space, so such chunks are joined and their ids parted again. The library
    merges the pair of the smallest id first: vocabularies that number merged tokens in
    another order than they merge them keep the merges of ``bpe.ByteBpe``.
    """

    def __init__(self, description: str):
        super().__init__(description)
        known = json.loads(description)
        if known.get("normalizer") or (known.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or known["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without normalisation and prefix are supported")
        self.library = None
        if (np.diff(self.merger.merged) > 0).all():
            special = set(self.special.values())
            ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
            self.library = tiktoken.Encoding("pieces", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.array([b[:1] == b" " for b in self.bytes])

    def learn(self, chunks: list[str]) -> list[bytes]:
        if self.library is None:
            return super().learn(chunks)
        encode = self.library.encode_ordinary
        found = {c: np.array([i], "<i4").tobytes() for c, i in self.special.items()}
        words = [c for c in chunks if c[:1] == " " and c[1:].isalpha()]
        for at in range(0, len(words), ASKED_AT_ONCE):
            part = words[at : at + ASKED_AT_ONCE]
            ids = np.array(encode("".join(part)), "<i4")
            starts = (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(starts) == len(part):
                data = ids.tobytes()
                found.update((c, data[a:b]) for c, a, b in zip(part, starts, [*starts[1:], len(data)], strict=True))
        return [found[c] if c in found else np.array(encode(c), "<i4").tobytes() for c in chunks]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(description: str) -> Encoder:
    """The encoder of a vocabulary, made once per Python worker."""
    key = hash(description)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(description)
    return _ENCODERS[key]


def cut(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``, and by ``part``
    and ``place`` the number of each among the pieces of its length that one task made."""
    inner, (i, t) = shield(docs, id_col, text_col)
    plain = inner.select(F.col(i).alias("doc_id"), F.col(t).alias("text"))
    sent = bpe._description(docs, path)
    schema = T.StructType([plain.schema["doc_id"], *T.StructType.fromDDL(PIECE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _encoder(sent.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, "text", TEXT_BYTES):
                ids, counts = coder.encode(some.column("text"))
                sizes = counts + 1
                ends = np.cumsum(sizes)
                flat = np.full(sizes.sum(), end_id, "<u4")
                flat[spread(ends - sizes, counts)] = ids
                pieces = -(-sizes // capacity)
                which = np.repeat(np.arange(len(sizes)), pieces)
                number = spread(np.zeros(len(sizes), np.int64), pieces)
                over = (sizes - (pieces - 1) * capacity)[which]
                start = np.where(number == 0, 0, over + (number - 1) * capacity)
                length = np.where(number == 0, over, capacity)
                stops = np.concatenate(([0], np.cumsum(length)))
                data = flat.tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
                by = np.argsort(length, kind="stable")
                lengths, firsts, many = np.unique(length[by], return_index=True, return_counts=True)
                place = np.empty(len(by), np.int64)
                place[by] = np.arange(len(by)) - np.repeat(firsts, many) + np.repeat(seen[lengths], many)
                seen[lengths] += many
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id").take(pa.array(which)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(np.full(len(by), part, np.int32)), pa.array(place), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(flat.astype(np.int32))),
                ], names=schema.names)
            pa.default_memory_pool().release_unused()

    return plain.mapInArrow(run, schema)


def placed(pieces: DataFrame, limits: Limits, rules: tuple[str, ...] = ("norm", "dot")) -> DataFrame:
    """``pieces`` (stored, of ``cut``) with ``sequence_id`` and ``offset``, by the rule that needs the fewest sequences."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    best = min((plan(lengths, limits, rule) for rule in rules), key=lambda p: p.sequences)
    if sum(c.nbytes for c in best[:-1]) > MAX_PLAN_BYTES:
        raise ValueError("the plan of packing is too large to send; take a smaller capacity")
    sent = spark.sparkContext.broadcast(best)
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(F.col("part").alias("of"), F.col("length").alias("size"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = sent.value
        # Lengths, then ranks below 2^44, as one number.
        key = length.to_numpy() << 44 | rank.to_numpy()
        at = np.searchsorted(p.length << 44 | p.rank, key, "right") - 1
        along = rank.to_numpy() - p.rank[at]
        return pd.DataFrame({"sequence_id": p.sequence[at] + along // p.each[at], "offset": p.offset[at] + along % p.each[at] * length.to_numpy()})

    met = pieces.join(before, (F.col("part") == F.col("of")) & (F.col("length") == F.col("size")))
    found = met.withColumn("found", find("length", F.col("place") + F.col("before")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("found.sequence_id").alias("sequence_id"), F.col("found.offset").alias("offset"), "ids")


def pack(docs: DataFrame, path: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their place in the sequences: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset`` and ``ids`` (``end_id`` after each document's)."""
    return placed(stored(cut(docs, path, end_id, limits.tokens, id_col, text_col), "pieces"), limits)


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence its ``ids`` and the ``offsets`` at which its pieces begin. A sequence is bounded by the capacity."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))
