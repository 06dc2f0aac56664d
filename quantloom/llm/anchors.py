"""Where strings of a fixed length may recur: windows grouped by a common anchor.

A window is ``length`` consecutive symbols of one document. Its anchor is the gram
of ``gram`` symbols in it with the least hash (the first of equal ones), so equal
windows have equal anchors at the same place. Consecutive windows with the same
anchor form a region; no two windows of a region are equal, as their anchors lie
at different places in them. Every window is in one region, and all windows
equal to it are in regions with the same anchor hash. So only regions whose anchor
recurs need comparing, and they meet by anchor.

Regions that are equal as a whole are reduced to the first of them before any text
moves, in each task and then over all: their other members hold nothing new, and every
window of theirs recurs.

Anchors whose regions lie in the same documents are compared together, and regions that
follow one another in a document then travel as one segment instead of overlapping.

An anchor that very many different regions share (the edge of a passage that a large part of
all documents hold) is refined: its regions are cut into single windows that meet by
a 128-bit hash of the window, with nothing to compare and combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import LAST_ID, slices
from quantloom.session import stored

#: Regions with one anchor that a task compares; more are refined.
HEAVY = 50_000
#: Text of the regions that one index is built of; an anchor's regions stay together.
SHARD_BYTES = 16 << 10
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_BLOCK = 1 << 23


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD[3])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD[4])
    return x ^ (x >> np.uint64(32))


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` symbols: sums with growing powers, made by doubling."""
    done, size, out, held = symbols.astype(np.uint64) + np.uint64(1), 1, None, 0
    if len(done) < gram:
        return np.empty(0, np.uint64)
    power = lambda n: np.uint64(pow(_ODD[0], n, 1 << 64))
    while True:
        if gram & size:
            if out is None:
                out, held = done, size
            else:
                n = len(symbols) - held - size + 1
                out, held = out[:n] * power(size) + done[held : held + n], held + size
        if held == gram:
            return _mixed(out[: len(symbols) - gram + 1])
        done = done[:-size] * power(size) + done[size:]
        size *= 2


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number from 0 on, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_ODD[1], pow(_ODD[1], -1, 1 << 64)):
            factors = np.full(n, base, np.uint64)
            factors[:1] = 1
            _POWERS.append(np.multiply.accumulate(factors))
    return _POWERS[0][:n], _POWERS[1][:n]


def regions_of(symbols: np.ndarray, counts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts one after another with so many symbols each: the text, first window, number of
    windows, anchor hash and content hash of each region."""
    hashes = gram_hashes(symbols, gram)
    width = length - gram + 1
    total = len(symbols) - length + 1
    if total <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    anchor = np.empty(total, np.int64)
    for at in range(0, total, _BLOCK):
        n = min(_BLOCK, total - at)
        # 40 bits of the hash, then the place: the least is the first of equal ones.
        key = hashes[at : at + n + width - 1] >> np.uint64(24) << np.uint64(24)
        key |= np.arange(len(key), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        key = np.minimum(key[:n], key[width - size : width - size + n])
        anchor[at : at + n] = (key & np.uint64((1 << 24) - 1)).astype(np.int64) + at
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)[:total]
    start = np.arange(total)
    inside = np.flatnonzero(start + length <= ends[text])
    if not len(inside):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    a, t = anchor[inside], text[inside]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (t[1:] != t[:-1]))))
    n = np.diff(np.concatenate((first, [len(inside)])))
    place = inside[first]
    # The hashes of a region's grams times growing powers, from sums up to each place.
    up, down = _powers(len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))
    content = _mixed((sums[place + n + width - 1] - sums[place]) * down[place] + n.astype(np.uint64))
    return t[first], place - (ends - counts)[t[first]], n, hashes[a[first]], content


@dataclass(frozen=True)
class Kind:
    """Symbols of texts. ``symbols``: numbers of all texts one after another and how many each has;
    ``cut``: the bytes of ``n`` symbols of a text's own form, which ``form`` makes."""

    length: int
    gram: int
    symbols: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    form: Callable[[bytes], Sequence]
    cut: Callable[[Sequence, int, int], bytes]
    piece: int = 4 << 20  # text bytes whose symbols are looked at together


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` of all rows, with ``id`` and ``th``, which say what is the same document."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), "th": F.hash(F.coalesce("text", F.lit("")))})


def _batch(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names.split())


REGION = "copy boolean, h long, c long, id long, th int, s int, n int, again boolean"
#: Regions as ``reduced`` gives them: ``first`` of its content, ``again`` if the content occurs again.
REDUCED = "h long, id long, th int, s int, n int, first boolean, again boolean"


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From regions sorted by all columns, those a task has found to be copies first: the
    copies, and of the others those whose anchor has another content or whose content comes again.

    One region is held from batch to batch, however many share an anchor.
    """
    empty = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)]
    last = lead = empty  # the last row, and the first row of its content
    lead_again = lead_met = False

    def out(rows: list[np.ndarray], first: bool, again: np.ndarray) -> pa.RecordBatch:
        return _batch("h id th s n first again", rows[0], *rows[2:], np.full(len(rows[0]), first), again)

    for batch in batches:
        early = batch.column("copy").to_numpy(zero_copy_only=False)
        marks = batch.column("again").to_numpy(zero_copy_only=False)
        rows = [batch.column(i).to_numpy() for i in range(1, 7)]
        if early.any():
            yield out([x[early] for x in rows], False, np.ones(early.sum(), bool))
            rows, marks = [x[~early] for x in rows], marks[~early]
        if not len(rows[0]):
            continue
        joined = [np.concatenate(x) for x in zip(last, rows, strict=True)]
        held = len(last[0])
        differs = [x[1:] != x[:-1] for x in joined]
        new_row = np.concatenate(([True], np.logical_or.reduce(differs[:5])))[held:]
        new_content = np.concatenate(([True], differs[0] | differs[1]))[held:]
        if not len(new_row):
            continue
        copy = new_row & ~new_content
        yield out([x[copy] for x in rows], False, np.ones(copy.sum(), bool))
        at = np.flatnonzero(new_content)
        copies = np.concatenate(([0], np.cumsum(copy)))
        begins = np.concatenate(([0], at)) if len(lead[0]) else at
        leads = [np.concatenate((x, y[at])) for x, y in zip(lead, rows, strict=True)]
        # A content comes again if a copy follows, or if any task has seen a copy of it.
        ends = np.concatenate((begins, [len(copy)]))
        noted = np.concatenate(([0], np.cumsum(marks)))
        again = (np.diff(copies[ends]) > 0) | (np.diff(noted[ends]) > 0)
        if len(lead[0]):
            again[0] |= lead_again
        same = leads[0][1:] == leads[0][:-1]
        before = np.concatenate(([lead_met if len(lead[0]) else False], same))
        keep = (before[:-1] | same | again[:-1])
        yield out([x[:-1][keep] for x in leads], True, again[:-1][keep])
        lead, lead_again, lead_met = [x[-1:] for x in leads], bool(again[-1]), bool(before[-1])
        last = [x[-1:] for x in rows]
    if len(lead[0]) and (lead_again or lead_met):
        yield out(lead, True, np.array([lead_again]))


def regions(docs: DataFrame, kind: Kind) -> DataFrame:
    """Regions of ``keyed`` documents that may hold a recurring window, as in ``REDUCED``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", kind.piece):
                t, s, n, h, c = regions_of(*kind.symbols(piece.column("text")), kind.length, kind.gram)
                ids, ths = (piece.column(x).to_numpy()[t] for x in ("id", "th"))
                rows = [h.view(np.int64), c.view(np.int64), ids, ths, s.astype(np.int32), n.astype(np.int32)]
                order = np.lexsort(rows[4::-1])
                rows = [x[order] for x in rows]
                if not len(order):
                    continue
                differs = [x[1:] != x[:-1] for x in rows]
                new = np.concatenate(([True], np.logical_or.reduce(differs[:5])))
                rows, same = [x[new] for x in rows], ~np.concatenate(([True], differs[0] | differs[1]))[new]
                yield _batch("copy h c id th s n again", same, *rows, np.concatenate((same[1:], [False])))
            pa.default_memory_pool().release_unused()

    found = docs.select("id", "th", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(find, REGION)
    # A copy needs no meeting point: it lies anywhere.
    place = F.when(F.col("copy"), F.xxhash64("id", "s")).otherwise(F.col("h"))
    order = [F.col("copy").desc(), "h", "c", "id", "th", "s"]
    return found.repartition(place).sortWithinPartitions(*order).mapInArrow(_reduced, REDUCED)


def recurring_windows(
    docs: DataFrame, kind: Kind, judge: Callable[[list[tuple[int, int, int, int, int, list[int], bytes]]], list[tuple[int, int, int, int]]],
    earlier_only: bool, heavy: int = HEAVY,
) -> DataFrame:
    """Per document with recurring windows: ``id``, ``th`` and ``spans``, a list of first window and number.

    ``docs`` come from ``keyed``. ``judge`` gets all segments of one or more groups, in order: group,
    id, th, first window, number of windows, marks and bytes. Marks are twice the windows of each
    of its regions, plus one if the region as a whole occurs again. It gives the windows that
    recur as (id, th, s, n).
    With ``earlier_only`` the first of equal windows does not count as recurring.
    """
    rows = stored(regions(docs, kind), "regions")
    # Whole regions that recur: the copies, and if any of equals counts, the first as well.
    whole = rows.filter(~F.col("first") if earlier_only else F.col("again")).select("id", "th", "s", "n")
    leads = rows.filter("first")
    document = F.xxhash64("id", "th")
    documents = F.xxhash64(F.min(document), F.max(document), F.bit_xor(document)).alias("group")
    groups = leads.groupBy("h").agg(F.count("*").alias("different"), documents, F.min("again").alias("known")).filter("different > 1")
    if not earlier_only:
        groups = groups.filter("not known")  # else every window is known to recur
    marked = leads.join(groups, "h").withColumn("many", F.col("different") > heavy)
    lists = marked.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("s", "n", "group", "again", "many"))).alias("regions"))
    joined = docs.join(lists, ["id", "th"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                out: list[list] = [[] for _ in range(9)]
                for i, th, text, found in zip(*(piece.column(x).to_pylist() for x in ("id", "th", "text", "regions")), strict=True):
                    form = kind.form((text or "").encode("utf-8", "surrogatepass"))
                    segments: list[list] = []
                    for r in found:
                        mark = 2 * r["n"] + r["again"]
                        last = segments[-1] if segments else None
                        if r["many"]:
                            for k in range(r["n"]):
                                two = xxhash.xxh128_intdigest(kind.cut(form, r["s"] + k, kind.length))
                                made = (two >> 64, two & (2**64 - 1), i, th, r["s"] + k, 1, [2 + r["again"]], True, b"")
                                for column, v in zip(out, made, strict=True):
                                    column.append(v)
                        elif last and last[0] == r["group"] and last[1] + last[2] == r["s"]:
                            last[2] += r["n"]
                            last[3].append(mark)
                        else:
                            segments.append([r["group"], r["s"], r["n"], [mark]])
                    for group, s, n, marks in segments:
                        made = (group & (2**64 - 1), 0, i, th, s, n, marks, False, kind.cut(form, s, n + kind.length - 1))
                        for column, v in zip(out, made, strict=True):
                            column.append(v)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[:2]]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.binary())
                yield _batch("h h2 id th s n marks many data", *signed, *(pa.array(x, k) for x, k in zip(out[2:], kinds, strict=True)))

    pieces = stored(joined.mapInArrow(extract, "h long, h2 long, id long, th int, s int, n int, marks array<int>, many boolean, data binary"), "pieces")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def judged() -> pa.RecordBatch:
            found = judge(held)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return _batch("id th s n", *(pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)))

        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("h", "id", "th", "s", "n", "marks", "data")), strict=True):
                if held and row[:4] == held[-1][:4]:
                    continue  # a repeated row
                if size > SHARD_BYTES and row[0] != held[-1][0]:
                    yield judged()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield judged()

    light = pieces.filter("not many").select("h", "id", "th", "s", "n", "marks", "data")
    found = light.repartition("h").sortWithinPartitions("h", "id", "th", "s").mapInArrow(compare, "id long, th int, s int, n int")
    # Single windows: equal ones by hash alone, a copied region's windows count as met again.
    single = pieces.filter("many").select("h", "h2", "id", "th", "s", (F.col("marks")[0] == 3).alias("again")).distinct()
    first = single.groupBy("h", "h2").agg(F.min(F.struct("id", "th", "s")).alias("first"), F.count("*").alias("c"), F.max("again").alias("any")).filter("c > 1 or any")
    met = single.join(first, ["h", "h2"])
    lost = met.filter(F.struct("id", "th", "s") != F.col("first")) if earlier_only else met
    everything = whole.unionByName(found).unionByName(lost.select("id", "th", "s", F.lit(1).alias("n")))
    return everything.groupBy("id", "th").agg(F.collect_list(F.struct("s", "n")).alias("spans"))


def covered(spans: list[dict] | None, n: int, length: int) -> np.ndarray:
    """Which of ``n`` symbols the windows of the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for x in spans or ():
        edge[x["s"]] += 1
        edge[x["s"] + x["n"] + length - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``spans`` (null where nothing recurs) of all rows of ``keyed`` documents."""
    return docs.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans")
