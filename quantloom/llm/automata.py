"""Substring dedup by words, with suffix automata.

Words that a window of ``length`` words covers go if the same words already start at an
earlier place (a smaller id, or earlier in the document). Windows that may recur
meet by anchor (``anchors``). A shard of reference regions becomes a suffix
automaton whose states know where they ended first. Streaming the regions through
it gives the longest match at each word; where it reaches the window length, the
state of the last ``length`` words tells whether they ended earlier. Shards are bounded,
and each goes only to the task that holds the documents' regions with its anchors:
sent to all tasks, every document would meet every shard.

Regions with the same words enter an automaton once: a later copy would match the
first from end to end, so all its windows start earlier.

Defined cases: null and blank texts have no words; rows that repeat an id and
text are one document; other rows that repeat an id are ordered by a hash of their
text; rows without an id come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quantloom.llm.anchors import HEAVY, Kind, covered, keyed, recurring_windows, with_spans
from quantloom.llm.common import slices

LENGTH = 20
GRAM = 5


class SuffixAutomaton:
    """Automaton of all substrings of the sequences added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0

    def start(self) -> None:
        """The next word begins a sequence of its own."""
        self.last = 0

    def add(self, word: bytes, place: int) -> None:
        """Append ``word``, which lies at ``place``; places must grow."""
        following, link, length, first = self.next, self.link, self.length, self.first
        p = self.last
        if word in following[p]:
            q = following[p][word]
            if length[q] == length[p] + 1:
                self.last = q
                return
            self.last = self._clone(p, word, q)
            return
        new = len(following)
        following.append({})
        length.append(length[p] + 1)
        first.append(place)
        link.append(0)
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        self.last = new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        following, link, length = self.next, self.link, self.length
        copy = len(following)
        following.append(dict(following[q]))
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        link.append(link[q])
        link[q] = copy
        while p >= 0 and following[p].get(word) == q:
            following[p][word] = copy
            p = link[p]
        return copy

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Per word the length of the longest match that ends there, and its state."""
        following, link, length = self.next, self.link, self.length
        state = size = 0
        for w in words:
            while state and w not in following[state]:
                state = link[state]
                size = length[state]
            if w in following[state]:
                state = following[state][w]
                size += 1
            yield size, state

    def first_end(self, state: int, size: int) -> int:
        """Where the last ``size`` words of a match in ``state`` ended first."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return self.first[state]


def earlier(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """The windows of segments (group, id, th, s, n, marks, bytes) that start earlier among them."""
    automaton = SuffixAutomaton()
    places = []
    place = 0
    for row in rows:
        places.append(place)
        automaton.start()
        for w in row[6].split():
            automaton.add(w, place)
            place += 1
    out: list[tuple[int, int, int, int]] = []
    for at, (_, i, th, s, n, _, data) in zip(places, rows, strict=True):
        begin = None
        for k, (size, state) in enumerate(automaton.matches(data.split())):
            again = size >= length and automaton.first_end(state, length) < at + k
            window = k - length + 1
            if again and begin is None:
                begin = window
            elif not again and begin is not None:
                out.append((i, th, s + begin, window - begin))
                begin = None
        if begin is not None:
            out.append((i, th, s + begin, n - begin))
    return out


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    import xxhash

    words = pc.ascii_split_whitespace(texts)
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    index = coded.indices.to_numpy()
    real = np.fromiter((len(w) > 0 for w in distinct), bool, len(distinct))[index]
    upto = np.concatenate(([0], np.cumsum(real)))
    return hashes[index[real]], np.diff(upto[offsets])


def word_kind(length: int = LENGTH, gram: int = GRAM) -> Kind:
    return Kind(length, min(gram, length), _symbols, bytes.split, lambda words, s, n: b" ".join(words[s : s + n]))


def drop_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, heavy: int = HEAVY) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the kept words joined by spaces) and the
    removed ``spans`` as lists of first word and number."""
    kind = word_kind(length)
    plain = keyed(docs, id_col, text_col)
    spans = recurring_windows(plain, kind, lambda rows: earlier(rows, length), True, heavy)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                made = []
                for text, found in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    lost = covered(found, len(words), length) if found else np.zeros(len(words), bool)
                    kept = words if not found else [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0])))).reshape(-1, 2)
                    made.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass"), [[int(a), int(b - a)] for a, b in edges]))
                columns = list(zip(*made, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    joined = with_spans(plain, spans)
    return joined.mapInArrow(apply, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string, spans array<array<long>>")
