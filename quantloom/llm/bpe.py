"""Byte-level BPE encoding and decoding with a public vocabulary file.

A piece of text is a sequence of byte symbols. A segment tree holds the rank of
every adjacent pair; its root gives the leftmost pair of lowest rank. Merging it
changes at most three leaves, each written with a logarithmic walk to the root,
until no pair is left that can be merged. Short pieces are merged many at once,
one tree per row of an array; long pieces have a tree of their own.

Texts are encoded chunk by chunk (white space and what follows it), with the ids
of recent chunks kept in memory up to a limit. That changes nothing: the split
pattern never joins text across the start of a run of white space.

Defined cases: a null text gives no ids and decodes to an empty text; special
tokens that stand in a text are encoded as such; ids outside the vocabulary are
skipped in decoding; bytes that are no valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import IdStore, map_texts

#: The pattern that splits text before merging, and Unicode's white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A character that marks cuts, and two places where a piece always ends: before white space, and
#: after the last of some letters. Texts that hold the character are cut in Python.
MARK = "\x01"
BEFORE_WHITE = f"([^{WHITE}])([{WHITE}])"
AFTER_LETTER = rf"(\p{{L}})([^\p{{L}}{MARK}])"

#: Rank of a pair that cannot be merged.
NO_RANK = 1 << 30
#: Pieces up to this many bytes are merged many at once.
SHORT = 32
MERGED_AT_ONCE = 8192
#: Chunks, and pieces, whose ids a task keeps.
KEPT_CHUNKS = 600_000
#: Size limit of a vocabulary file, which every executor holds.
MAX_VOCABULARY_BYTES = 64 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class Merger:
    """Merges symbol ids by pair ranks."""

    def __init__(self, pairs: Iterable[tuple[int, int, int]], size: int):
        """``pairs``: left id, right id and merged id in order of rank; ``size``: ids of the vocabulary."""
        table = np.array(list(pairs), np.int64).reshape(-1, 3)
        self.size = size
        self.ranks = {(a, b): k for k, (a, b, _) in enumerate(table.tolist())}
        self.merged = table[:, 2]
        keys = table[:, 0] * size + table[:, 1]
        # Open addressing: a pair lies in the first free place from its hash on.
        self.bits = max(8, int(len(table) * 3).bit_length())
        self.place_key = np.full(1 << self.bits, -1, np.int64)
        self.place_rank = np.full(1 << self.bits, NO_RANK, np.int64)
        todo, place = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.place_key[place[todo]] < 0
            took, first = np.unique(place[todo][free], return_index=True)
            winners = todo[free][first]
            self.place_key[took], self.place_rank[took] = keys[winners], winners
            todo = np.setdiff1d(todo, winners)
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``NO_RANK`` for negative ids and unknown pairs."""
        keys = left * self.size + right
        place = self._home(keys)
        out = np.full(len(keys), NO_RANK, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            found = self.place_key[place[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.place_rank[place[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, symbols: Sequence[int]) -> list[int]:
        """The ids left of one piece of any length."""
        n = len(symbols)
        if n < 2:
            return list(symbols)
        width = 1 << (n - 1).bit_length()
        ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        tree = [NO_RANK] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = rank((ids[i], ids[i + 1]), NO_RANK)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < NO_RANK:
            node, lowest = 1, tree[1]
            while node < width:
                node *= 2
                if tree[node] != lowest:
                    node += 1
            i = node - width
            gone = after[i]
            ids[i], ids[gone] = int(self.merged[lowest]), -1
            after[i] = after[gone]
            put(gone, NO_RANK)
            if after[i] < n:
                before[after[i]] = i
                put(i, rank((ids[i], ids[after[i]]), NO_RANK))
            else:
                put(i, NO_RANK)
            if before[i] >= 0:
                put(before[i], rank((ids[before[i]], ids[i]), NO_RANK))
        return [x for x in ids if x >= 0]

    def merge_many(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, padded with -1 on the right to a power of two, merged in place."""
        rows, width = ids.shape
        place = np.arange(width)
        real = ids >= 0
        lengths = real.sum(axis=1)
        after = np.broadcast_to(place + 1, ids.shape).copy()
        before = np.broadcast_to(place - 1, ids.shape).copy()
        tree = np.full((rows, 2 * width), NO_RANK, np.int64)
        if width > 1:
            tree[:, width : 2 * width - 1] = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, width - 1)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        steps = width.bit_length() - 1

        def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
            node = width + i
            tree[r, node] = value
            for _ in range(steps):
                node >>= 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < NO_RANK)
        while len(live):
            lowest = tree[live, 1]
            node = np.ones(len(live), np.int64)
            for _ in range(steps):
                node *= 2
                node += tree[live, node] != lowest
            i = node - width
            gone = after[live, i]
            ids[live, i] = self.merged[lowest]
            ids[live, gone] = -1
            follow = after[live, gone]
            after[live, i] = follow
            put(live, gone, NO_RANK)
            last = follow >= lengths[live]
            safe = np.where(last, i, follow)
            inner = ~last
            before[live[inner], follow[inner]] = i[inner]
            put(live, i, self.rank_of(ids[live, i], np.where(last, -1, ids[live, safe])))
            lead = before[live, i]
            has = lead >= 0
            r, left, right = live[has], lead[has], i[has]
            put(r, left, self.rank_of(ids[r, left], ids[r, right]))
            live = live[tree[live, 1] < NO_RANK]
        return ids


class ByteBpe:
    """Encoder and decoder of a byte-level BPE vocabulary in the JSON of the tokenizers library."""

    def __init__(self, description: str):
        import re

        import regex

        known = json.loads(description)
        model = known["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in known.get("added_tokens") or []}
        size = 1 + max([*vocab.values(), *self.special.values()])
        symbols = byte_symbols()
        of_symbol = {s: b for b, s in enumerate(symbols)}
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.merger = Merger(((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), size)
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile(PATTERN).findall
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known = IdStore(self.learn, KEPT_CHUNKS)

    def pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the split pattern has made."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for k, b in enumerate(data):
            if len(b) > SHORT:
                out[k] = np.array(self.merger.merge(self.first[np.frombuffer(b, np.uint8)].tolist()), "<i4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            for at in range(0, len(members), MERGED_AT_ONCE):
                part = members[at : at + MERGED_AT_ONCE]
                raw = np.frombuffer(b"".join(data[k].ljust(width, b"\0") for k in part), np.uint8).reshape(-1, width)
                lengths = np.array([len(data[k]) for k in part])
                ids = self.merger.merge_many(np.where(np.arange(width) < lengths[:, None], self.first[raw], -1))
                kept = ids >= 0
                flat = ids[kept].astype("<i4").tobytes()
                ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
                for k, a, b in zip(part, [0, *ends], ends):
                    out[k] = flat[a:b]
        return out

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian 32-bit numbers."""
        split = [[c] if c in self.special else self.split(c) for c in chunks]
        pieces = list(set().union(*split).difference(self.special))
        found = dict(zip(pieces, self.pieces_ids(pieces), strict=True))
        found.update((x, np.array([i], "<i4").tobytes()) for x, i in self.special.items())
        return [b"".join(map(found.__getitem__, p)) for p in split]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number per text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = pc.invert(pc.match_substring(texts, MARK))
        for x in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, x))
        if pc.all(plain).as_py() is not False:
            marked = pc.replace_substring_regex(texts, BEFORE_WHITE, f"\\1{MARK}\\2")
            return self.known.encode(pc.split_pattern(pc.replace_substring_regex(marked, AFTER_LETTER, f"\\1{MARK}\\2"), MARK))
        cut = []
        for t in texts.to_pylist():
            parts = self.parts(t) if self.parts else [t]
            cut.append([c for part in parts for c in ([part] if part in self.special else self.chunks(part))])
        return self.known.encode(pa.array(cut, pa.list_(pa.string())))

    def decode(self, ids: Iterable[int]) -> str:
        n = len(self.bytes)
        known = self.bytes
        return b"".join([known[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")

    def decode_known(self, ids: np.ndarray) -> str:
        """``decode`` of ids that the vocabulary has."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODERS: dict[int, ByteBpe] = {}


def coder(description: str) -> ByteBpe:
    """The coder of a vocabulary, made once per Python worker."""
    key = hash(description)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = ByteBpe(description)
    return _CODERS[key]


def _description(docs: DataFrame, path: str):
    """The vocabulary file, read on the driver and sent to the executors once."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return docs.sparkSession.sparkContext.broadcast(text)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, keep_text: str | None = None) -> DataFrame:
    """Per row ``doc_id`` and ``ids`` (array of int), with ``decoded`` the text that the ids decode
    to, and the text itself under the name ``keep_text`` if given."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = _description(docs, path)

    def start():
        bpe = coder(sent.value)

        def run(texts: pa.Array):
            ids, counts = bpe.encode(texts)
            ends = np.concatenate(([0], np.cumsum(counts)))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            return [lists, [bpe.decode_known(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]] if decoded else [lists]

        return run

    more = [("ids", T.ArrayType(T.IntegerType())), *([("decoded", T.StringType())] if decoded else [])]
    out = map_texts(plain, "text", ["doc_id", *(["text"] if keep_text else [])], more, start, limit=4 << 20, arrow=True)
    return out.withColumnRenamed("text", keep_text) if keep_text else out


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_as: str = "text") -> DataFrame:
    """``tokens`` with the text its ids stand for; null ids give an empty text."""
    sent = _description(tokens, path)

    @F.pandas_udf(T.StringType())
    def texts(ids: pd.Series) -> pd.Series:
        bpe = coder(sent.value)
        return ids.map(lambda x: bpe.decode([] if x is None else [int(i) for i in x if i is not None]))

    return tokens.withColumn(text_as, texts(F.col(ids_col)))
