"""Near-dedup by exact shingle similarity: the near-dedup stage of the pipeline.

Two texts are linked if their sets of five-word shingles (fewer words make one
shingle), as 64-bit hashes, have a Jaccard similarity of 0.8 or more:

1. Texts with equal sets share a 64-bit hash of the set and count once.
2. SimHash: each set has a 64-bit fingerprint of its shingles. Sets whose fingerprints are
   equal or differ in four bits or less (``simhash.near_edges``: Golay keys) are candidates,
   compared by the shingles themselves like those of the next step.
3. Four bits alone miss most pairs at 0.8, so the bands add the others. Each set gives one key for each of 40 bands of six minima. Sets with similarity 0.8
   share no key in 5 of a million cases, more similar ones less often. 64 SimHash bits
   would have to be met at 14 to 19 differing bits for this, where keys are so short
   that all documents share them.
4. The first set of a key is compared with all others of it, by the shingles
   themselves, and what is linked joined to components.
5. Where the sets of a key are still in different components, they meet in the task of that
   key, and each is compared with all that it is not connected with by then. No rows of
   pairs are formed: a key gives fewer links than it has sets.

The first comparison leaves out pairs whose sizes alone rule the similarity out. Components
follow from the verified links.

Defined cases: texts without words (null, empty or blank) are copies of each other;
rows may repeat; rows without an id stay, and link like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import LAST_ID, map_texts, shield, spread
from quantloom.llm.components import components
from quantloom.llm.simhash import near_edges, shingles, simhash
from quantloom.session import stored

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 6


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text in order of their hashes."""
    return np.unique(shingles(text, words))


def set_hash(own: np.ndarray) -> int:
    """A signed 64-bit hash of a shingle set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


@lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and terms of the orders of shingles, and factors that mix minima to keys."""
    a, b, c = np.random.default_rng(42).integers(0, 2**64, (3, BANDS * ROWS), np.uint64)
    return a | np.uint64(1), b, c | np.uint64(1)


def band_keys(own: np.ndarray) -> np.ndarray:
    """One signed key per band of a shingle set; none for the empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    factor, term, mix = _orders()
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 128):
        np.minimum(low, (own[at : at + 128, None] * factor + term).min(axis=0), out=low)
    return ((low ^ (low >> np.uint64(29))) * mix).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar_enough(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two shingle sets is ``similarity`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: each but the first of its key, with that first one."""
    last: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, size = (np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate(last))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rest = np.flatnonzero(~new)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[rest], node[head[rest]], size[head[rest]], node[rest], size[rest])], names=["key", "head", "head_size", "node", "size"])
        last = tuple(x[head[-1] : head[-1] + 1] for x in (key, node, size))


def links_of(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different labels that connect all that is linked directly or in steps."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    counts = np.bincount(ids)
    begins, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    todo, out = np.ones(len(sets), bool), []
    while todo.any():
        front = np.flatnonzero(todo & (labels == labels[np.argmax(todo)])).tolist()
        todo[front] = False
        while front and todo.any():
            k = front.pop()
            own = ids[ends[k] - sizes[k] : ends[k]]
            both = np.bincount(owners[spread(begins[own], counts[own])], minlength=len(sets))
            near = np.flatnonzero(todo & (both >= similarity * (sizes[k] + sizes - both) - 1e-9))
            out += [(int(nodes[k]), int(nodes[x])) for x in near]
            if len(near):
                met = np.flatnonzero(todo & np.isin(labels, labels[near]))
                todo[met] = False
                front += met.tolist()
    return out


def _linked(similarity: float):
    """Of rows sorted by key: the links of ``links_of`` for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        key = None

        def links() -> list[tuple[int, int]]:
            nodes, labels, sets = zip(*held, strict=True)
            return links_of(np.array(nodes), np.array(labels), list(sets), similarity)

        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            found = []
            for k, node, label, own in zip(*(batch.column(x).to_pylist() for x in ("key", "node", "label", "own")), strict=True):
                if held and k != key:
                    found += links()
                    held.clear()
                key = k
                held.append((node, label, np.frombuffer(own, np.uint64)))
            yield made(found)
        if held:
            yield made(links())

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``-``b`` whose sets are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a, first, second = batch.column(0).to_numpy(), batch.column(2), batch.column(3)
            good = np.zeros(batch.num_rows, bool)
            for k, node in enumerate(a.tolist()):
                if node != last:
                    last, own = node, np.frombuffer(first[k].as_py(), np.uint64)
                good[k] = similar_enough(own, np.frombuffer(second[k].as_py(), np.uint64), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(batch.column(1).to_numpy()[good])], names=["a", "b"])

    # The second ones travel to the first: one of many pairs is the first in all of them.
    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("second")), "b")
    met = second.join(sets.select(F.col("node").alias("a"), F.col("own").alias("first")), "a")
    return met.select("a", "b", "first", "second").mapInArrow(check, "a long, b long")


def _simhash_pairs(distinct: DataFrame) -> DataFrame:
    """Candidates by SimHash: of each fingerprint the least set with the others, and the least
    sets of fingerprints that ``near_edges`` links. At most one row a set and an edge."""
    marks = distinct.filter("size > 0").select("fingerprint", "node", "size")
    heads = marks.groupBy("fingerprint").agg(F.min(F.struct("node", "size")).alias("head")).select("fingerprint", F.col("head.node").alias("head"), F.col("head.size").alias("head_size"))
    heads = stored(heads, "heads")
    same = marks.join(heads, "fingerprint").filter(F.col("node") != F.col("head"))
    edges = near_edges(heads.select("fingerprint")).join(heads.withColumnRenamed("fingerprint", "a"), "a")
    near = edges.join(heads.select(F.col("fingerprint").alias("b"), F.col("head").alias("node"), F.col("head_size").alias("size")), "b")
    columns = ["head", "head_size", "node", "size"]
    return same.select(*columns).unionByName(near.select(*columns))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``component_id``, the smallest id reachable over links of ``similarity`` or more."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))

    def mark():
        def run(texts: list[str | None]) -> list[list]:
            sets = [shingle_set(t, words) for t in texts]
            return [[set_hash(x) for x in sets], [len(x) for x in sets], [band_keys(x) for x in sets], [simhash(x) for x in sets]]

        return run

    def keep_set():
        def run(texts: list[str | None]) -> list[list]:
            sets = [shingle_set(t, words) for t in texts]
            return [[set_hash(x) for x in sets], [x.tobytes() for x in sets]]

        return run

    new = [("node", T.LongType()), ("size", T.IntegerType()), ("keys", T.ArrayType(T.LongType())), ("fingerprint", T.LongType())]
    marked = stored(map_texts(plain, "text", ["id", "th"], new, mark), "marked")
    of = F.struct(F.coalesce("id", F.lit(LAST_ID)).alias("id"), "th").alias("of")
    distinct = stored(marked.groupBy("node").agg(F.min("id").alias("least"), F.min(of).alias("of"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.any_value("fingerprint").alias("fingerprint")), "distinct")
    keyed = distinct.select(F.explode("keys").alias("key"), "node", "size").repartition("key").sortWithinPartitions("key", "node")
    runs = stored(keyed.mapInArrow(_heads, "key long, head long, head_size int, node long, size int"), "runs")
    close = stored(_simhash_pairs(distinct), "close")
    nodes = runs.select(F.explode(F.array("head", "node")).alias("node")).unionByName(close.select(F.explode(F.array("head", "node")).alias("node"))).distinct()
    wanted = distinct.join(nodes, "node").select(F.col("of.id").alias("own_id"), F.col("of.th").alias("th"))
    texts = plain.withColumn("own_id", F.coalesce("id", F.lit(LAST_ID))).join(wanted, ["own_id", "th"], "left_semi")
    sets = stored(map_texts(texts, "text", [], [("node", T.LongType()), ("own", T.BinaryType())], keep_set).dropDuplicates(["node"]), "sets")

    small, large = F.least("head_size", "size"), F.greatest("head_size", "size")
    first = runs.drop("key").unionByName(close).filter(small >= similarity * large - 1e-9).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    found = stored(components(_verified(first, sets, similarity), "a", "b"), "found")
    members = runs.select("key", "node", "size").unionByName(runs.select("key", F.col("head").alias("node"), F.col("head_size").alias("size")).distinct())
    named = members.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    open_ = named.join(mixed, "key", "left_semi").join(sets, "node").select("key", "node", "label", "own")
    more = open_.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(similarity), "a long, b long").distinct()
    more = stored(more, "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more), "a", "b")
    grouped = distinct.select("node", "least").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "label").select("node", "component_id")
    return marked.select("id", "node").join(ids, "node").select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the document of smallest id of each component of similar texts.

    Rows that repeat an id are one document and stay or go together; rows without an id stay.
    """
    plain, (id_, text) = shield(docs, id_col, text_col)
    groups = similar_components(plain, id_, text, words, similarity)
    lost = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_)).distinct()
    return plain.join(lost, id_, "left_anti").select(*plain.columns).toDF(*docs.columns)
