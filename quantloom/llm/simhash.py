"""SimHash near-dedup with Golay-code keys.

Fingerprints are 64 bits over word shingles. Two fingerprints are linked if at
most four bits differ. Finding all links:

1. A fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word
   of the binary Golay code of length 23. Decoding gives the codeword indices
   near the segment: the nearest one, and the five at distance four if the
   nearest is at distance three. Two segments that differ in at most two bits
   always share an index (``tests/llm`` checks all cases).
2. Four errors over three segments leave two segments with at most two errors
   together, so two linked fingerprints share the indices of two segments. Each
   pair of segments and of their indices is one key.
3. Distinct fingerprints meet by key; the distance is then checked on all 64 bits.
   A task emits edges that connect what is linked, not all pairs: a group of any
   size gives fewer edges than members for each key.

Exact copies share a fingerprint and count once. Components follow from the edges.

Defined cases: no words (null, empty or blank text) gives fingerprint zero,
linked like any other; fewer words than a shingle give one shingle of all words;
rows may repeat; a component of rows without an id has a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import map_texts, shield
from quantloom.llm.components import components
from quantloom.session import stored

RADIUS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the Golay code of length 23.
GENERATOR = 0b101011100011
#: Runs of one key up to this length are compared at once, longer ones member by member.
SHORT_RUN = 24


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's word shingles in order, repeats included; empty without words."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not data:
        return np.empty(0, np.uint64)
    if len(data) < words:
        words = len(data)
    joined = b" ".join(data)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hash_ = xxhash.xxh64_intdigest
    n = len(data) - words + 1
    return np.fromiter((hash_(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, words: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included."""
    return simhash(shingles(text, words))


def simhash(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of hashes."""
    n = len(h)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, id_as: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id and ``fingerprint`` as a signed long."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def start():
        return lambda texts: [[fingerprint(t, words) for t in texts]]

    return map_texts(plain, "text", ["id"], [("fingerprint", T.LongType())], start).withColumnRenamed("id", id_as)


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a 23-bit word (3 x 256), and per syndrome the error patterns
    that lead to a nearby codeword: the nearest, then those of weight four; -1 where none."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    by_byte = np.array([[syndrome(b << (8 * k) & 0x7FFFFF) for b in range(256)] for k in range(3)], np.int64)
    single = [syndrome(1 << b) for b in range(23)]
    errors = np.full((2048, 6), -1, np.int64)
    held = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            if weight < 4 or held[s] and int(errors[s, 0]).bit_count() == 3:
                errors[s, held[s]] = sum(1 << b for b in bits)
                held[s] += 1
    return by_byte, errors


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """The indices (first 12 bits) of the codewords near 23-bit words; six columns, -1 where none."""
    by_byte, errors = golay_tables()
    s = by_byte[0][segment & 255] ^ by_byte[1][segment >> 8 & 255] ^ by_byte[2][segment >> 16]
    e = errors[s]
    return np.where(e < 0, -1, (segment[:, None] ^ e) >> 11)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of signed fingerprints, and the row each key belongs to."""
    u = fps.view(np.uint64)
    found = [codeword_indices((u >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.int64)) for at, size in SEGMENTS]
    keys, rows = [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = found[i][:, :, None], found[j][:, None, :]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        keys.append(pair << 24 | found[i][row, x] << 12 | found[j][row, y])
        rows.append(row)
    return np.concatenate(keys).astype(np.int32), np.concatenate(rows)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least connected member of each of ``n`` members under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def linked_in_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each run of equal keys, what is linked directly or in steps."""
    n = len(keys)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if n else np.empty(0, np.int64)
    sizes = np.diff(np.concatenate((starts, [n])))
    u = fps.view(np.uint64)
    left, right = [], []
    run_end = np.repeat(starts + sizes, sizes)
    inside = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes))
    for step in range(1, SHORT_RUN):
        inside = inside[inside + step < run_end[inside]]
        if not len(inside):
            break
        near = inside[np.bitwise_count(u[inside] ^ u[inside + step]) <= radius]
        left.append(near)
        right.append(near + step)
    for k in np.flatnonzero(sizes > SHORT_RUN):
        todo = np.arange(starts[k], starts[k] + sizes[k])
        while len(todo):
            head, todo, front = todo[0], todo[1:], [todo[0]]
            while front and len(todo):
                near = np.bitwise_count(u[todo] ^ u[front.pop()]) <= radius
                found, todo = todo[near], todo[~near]
                front += found.tolist()
                left.append(np.full(len(found), head))
                right.append(found)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    if not len(a):
        return a.astype(np.int64), b.astype(np.int64)
    # One star for what this batch connects: fewer edges than fingerprints.
    nodes, at = np.unique(fps[np.concatenate((a, b))], return_inverse=True)
    root = _roots(len(nodes), at[: len(a)], at[len(a) :])
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[member]], nodes[member]


def near_edges(distinct: DataFrame, fp: str = "fingerprint", radius: int = RADIUS) -> DataFrame:
    """Edges ``a``-``b`` that connect all distinct fingerprints with links of ``radius`` bits or less."""
    if radius > RADIUS:
        raise ValueError("the keys cover at most four differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 2048):
                part = fps[at : at + 2048]
                keys, rows = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int32), np.empty(0, np.int64)

        def edges(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = linked_in_runs(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count < 1 << 18:
                continue
            k = np.concatenate([held_k, *(x for x, _ in waiting)])
            f = np.concatenate([held_f, *(x for _, x in waiting)])
            waiting, count = [], 0
            whole = int(np.searchsorted(k, k[-1], "left"))  # the last key may go on
            held_k, held_f = k[whole:], f[whole:]
            yield edges(k[:whole], f[:whole])
        yield edges(np.concatenate([held_k, *(x for x, _ in waiting)]), np.concatenate([held_f, *(x for _, x in waiting)]))

    keyed = distinct.select(F.col(fp).cast("long").alias("fp")).mapInArrow(spread, "key int, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (signed long) and ``component_id``, the
    smallest id reachable over links of ``radius`` bits or less."""
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(near_edges(distinct, radius=radius), "a", "b")
    named = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "label").select("fingerprint", "component_id")
    return marked.join(ids, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = RADIUS) -> DataFrame:
    """``docs`` with the document of smallest id of each near-duplicate component.

    Rows that repeat an id are one document and stay or go together; rows without an id stay.
    """
    plain, (id_, text) = shield(docs, id_col, text_col)
    groups = near_components(plain, id_, text, words, radius)
    lost = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_)).distinct()
    return plain.join(lost, id_, "left_anti").select(*plain.columns).toDF(*docs.columns)
