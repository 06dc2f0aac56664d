"""Substring dedup by bytes, with suffix arrays made by induced sorting.

Bytes that a string of ``length`` bytes covers go if the string also starts anywhere
else, in the same document or another. Strings that may recur meet by anchor
(``anchors``). The segments of a shard are written one after another and get
a suffix array: suffixes are classified, the leftmost-smaller substrings sorted by
induction and named, recursively if names repeat, and their order induces that of all
suffixes in linear time. Common prefixes are computed in text order (permuted), where
each is at most one shorter than the one before. Neighbours in the array with a common
prefix of ``length`` bytes start equal strings; a string recurs if two windows start
it or if its region as a whole occurs again.

Defined cases: null texts are empty; matches never cross documents; rows that repeat
an id and text are one document; the kept bytes of a text need not be valid UTF-8,
so they are binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quantloom.llm.anchors import HEAVY, Kind, covered, keyed, recurring_windows, with_spans
from quantloom.llm.common import slices

LENGTH = 200
GRAM = 32
#: Ends a region, and stands for the character 0, which ends all; no bytes of UTF-8 text.
END, ZERO = 0xFF, 0xFE


def suffix_array(s: bytes | list[int], alphabet: int) -> list[int]:
    """The suffixes of ``s`` in order; its last number is 0 and occurs nowhere else."""
    n = len(s)
    if n < 3:
        return [n - 1, 0][:n]
    # 1: the suffix is smaller than the one after it; equal characters take the next one's class.
    chars = np.array(list(s))
    rise = np.append(np.sign(np.diff(chars)), 1)
    decided = np.where(rise != 0, np.arange(n), n)
    classes = rise[np.minimum.accumulate(decided[::-1])[::-1]] > 0
    leftmost = (np.flatnonzero(classes[1:] & ~classes[:-1]) + 1).tolist()
    upto = np.cumsum(np.bincount(chars, minlength=alphabet))
    heads, tails = [0, *upto[:-1].tolist()], upto.tolist()
    # The character before each place, by its class, else -1; the last entry is for empty cells.
    ahead = np.concatenate(([-1], chars[:-1], [-1]))
    falls = np.concatenate(([True], classes[:-1], [True]))
    larger_before = np.where(falls, -1, ahead).tolist()
    smaller_before = np.where(falls, ahead, -1).tolist()

    def induce(order: list[int]) -> list[int]:
        out = [-1] * n
        end = tails.copy()
        for i in reversed(order):
            c = s[i]
            end[c] = k = end[c] - 1
            out[k] = i
        begin = heads.copy()
        for i in out:
            c = larger_before[i]
            if c >= 0:
                k = begin[c]
                out[k] = i - 1
                begin[c] = k + 1
        end = tails.copy()
        for i in reversed(out):
            c = smaller_before[i]
            if c >= 0:
                end[c] = k = end[c] - 1
                out[k] = i - 1
        return out

    after = dict(zip(leftmost, [*leftmost[1:], n - 1]))
    name, names, before = -1, {}, None
    for i in induce(leftmost):
        if i in after:
            substring = s[i : after[i] + 1]
            if substring != before:
                name += 1
            names[i], before = name, substring
    reduced = [names[i] for i in leftmost]
    if name + 1 < len(leftmost):
        order = [leftmost[j] for j in suffix_array(reduced, name + 1)]
    else:
        order = [0] * len(leftmost)
        for i, k in zip(leftmost, reduced):
            order[k] = i
    return induce(order)


def permuted_common_prefixes(s: bytes, order: list[int], limit: int) -> np.ndarray:
    """Per place of ``s`` the common prefix with the suffix before it in ``order``, up to ``limit``.

    Where both suffixes have the same character before them, the prefix is that of the
    place before less one; only the other places are compared.
    """
    n = len(s)
    text = np.frombuffer(s, np.uint8)
    previous = np.full(n, -1)
    previous[order[1:]] = order[:-1]
    i = np.flatnonzero(previous >= 0)
    j = previous[i]
    edge = np.minimum(i, j) == 0
    own = edge | (text[i - 1] != text[j - 1])
    i, j = i[own], j[own]
    size = np.zeros(n, np.int64)
    live, step = np.arange(len(i)), 0
    while len(live):
        live = live[np.maximum(i[live], j[live]) + step < n]
        live = live[text[i[live] + step] == text[j[live] + step]]
        step += 1
        size[i[live]] = step
    reach = np.full(n, -1)
    reach[i] = i + size[i]
    reach[previous < 0] = np.flatnonzero(previous < 0)
    return np.clip(np.maximum.accumulate(reach) - np.arange(n), 0, limit) if n else size


def recurring(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """The windows of segments (group, id, th, s, n, marks, bytes) that recur."""
    text = b"".join(row[6] + bytes([END]) for row in rows).replace(b"\0", bytes([ZERO]))
    starts = np.cumsum([0, *(len(row[6]) + 1 for row in rows)])
    listed = suffix_array(text + b"\0", 256)[1:]
    common = permuted_common_prefixes(text, listed, length)
    order = np.array(listed)
    region = np.searchsorted(starts, order, "right") - 1
    offset = order - starts[region]
    is_window = offset < np.array([row[4] for row in rows])[region]
    # Suffixes with the same first bytes lie next to each other.
    group = np.cumsum(common[order] < length)
    again = np.zeros(len(text), np.int64)
    for at, row in zip(starts.tolist(), rows, strict=False):
        marks = np.array(row[5])
        again[at : at + row[4]] = np.repeat(marks & 1, marks >> 1)
    weight = np.where(is_window, 1 + again[order], 0)
    recurs = is_window & (np.bincount(group, weight)[group] > 1)
    marked = np.zeros(len(text) + 1, np.int8)
    marked[order[recurs]] = 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked)))).reshape(-1, 2)
    out = []
    for a, b in edges.tolist():
        k = int(np.searchsorted(starts, a, "right")) - 1
        out.append((rows[k][1], rows[k][2], rows[k][3] + a - int(starts[k]), b - a))
    return out


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = pc.binary_length(texts).to_numpy().astype(np.int64)
    joined = b"".join(x.encode("utf-8", "surrogatepass") for x in texts.to_pylist())
    return np.frombuffer(joined, np.uint8), counts


def byte_kind(length: int = LENGTH, gram: int = GRAM) -> Kind:
    return Kind(length, min(gram, length), _symbols, bytes, lambda data, s, n: data[s : s + n], piece=1 << 20)


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``n_removed``, ``kept`` (binary) and the removed ``spans`` as
    lists of first byte and number."""
    kind = byte_kind(length)
    plain = keyed(docs, id_col, text_col)
    spans = recurring_windows(plain, kind, lambda rows: recurring(rows, length), False, heavy)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                made = []
                for text, found in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    lost = covered(found, len(data), length) if found else np.zeros(len(data), bool)
                    kept = np.frombuffer(data, np.uint8)[~lost].tobytes() if found else data
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0])))).reshape(-1, 2)
                    made.append((len(data), len(data) - len(kept), kept, [[int(a), int(b - a)] for a, b in edges]))
                columns = list(zip(*made, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    joined = with_spans(plain, spans)
    return joined.mapInArrow(apply, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, kept binary, spans array<array<long>>")
