"""Token-id files: fixed-width bit packing with block offsets.

Every id takes the bits of the largest id of the vocabulary. A document begins at a
whole group of eight ids, so its bytes start at ``width`` times the groups before
it, and a block of documents unpacks in one vectorised step. Files are Parquet with
one row per block: the ids of the first and last document, the documents' ids,
lengths and group offsets, and the packed bytes. Documents lie in ascending id
order over files (``shard``) and blocks, so a range of ids reads only the blocks
whose statistics meet it, and one document is cut out of its block by its offset.

Boundaries between shards are quantiles of the ids; writing is one shuffle of packed
documents. Spark commits whole files, so a lost executor's work is done again.

Defined cases: null texts are empty; rows without an id come first, in one order
with each other by their packed bytes, as do rows that repeat an id; an empty
table gives no blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantloom.llm.common import IdStore, map_texts, partitions, spread

#: Blocks hold about this many packed bytes, one document at least.
BLOCK_BYTES = 1 << 20
#: Runs whose ids a task keeps, and for which the library is asked at once.
KEPT_CHUNKS = 400_000
ASKED_AT_ONCE = 4000
MAX_VOCABULARY_BYTES = 64 << 20
BLOCKS = "shard int, block int, first_id long, last_id long, width int, before long, n_ids long, ids array<long>, lengths array<long>, groups array<long>, payload binary"


def width_of(vocabulary: int) -> int:
    """Bits that hold any of ``vocabulary`` ids."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, low bits first, padded with zeros to a group of eight ids."""
    n = -(-len(ids) // 8) * 8
    padded = np.zeros(n, np.uint64)
    padded[: len(ids)] = ids
    if width == 16:
        return padded.astype("<u2").tobytes()
    bits = padded[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, first: int = 0, n: int | None = None) -> np.ndarray:
    """``n`` ids from the group of eight number ``first`` on; all to the end if not given."""
    raw = np.frombuffer(payload, np.uint8)[first * width :]
    if n is not None:
        raw = raw[: -(-n // 8) * width]
    rows = np.zeros((len(raw) // width, width + 8), np.uint64)
    rows[:, :width] = raw.reshape(-1, width)
    out = np.empty((len(rows), 8), np.uint64)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = rows[:, byte].copy()
        for k in range(1, (shift + width + 7) // 8):
            value |= rows[:, byte + k] << np.uint64(8 * k)
        out[:, j] = value >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out.ravel()[:n].astype(np.uint32)


#: Characters of texts that may be cut where a run of letters ends, and that place.
#: These letters have no other composed form, and the split pattern of the vocabulary ends
#: a piece there if no apostrophe is near.
PLAIN_TEXT = r"\A[ -&(-~\nÀ-ÖØ-öø-ÿ]*\z"
RUN_END = r"([a-zß-öø-ÿ])([^a-zß-öø-ÿ ])"


class ChunkEncoder:
    """The tokenizers library, asked once per chunk of text between spaces, line ends and, in
    plain texts, ends of runs of letters.

    Only for vocabularies that lower-case, drop white space and split at the ends
    of words. Special tokens must hold no white space.
    """

    def __init__(self, description: str, special: list[str], last: bytes):
        """``last``: one byte per id, not zero if the token ends a word."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = special
        self.last = np.frombuffer(last, bool)
        self.plain_chunks = IdStore(self._learn_plain, KEPT_CHUNKS)
        self.other_chunks = IdStore(self._ask, KEPT_CHUNKS)

    def _ask(self, chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), ASKED_AT_ONCE):
            found = self.tokenizer.encode_batch_fast(chunks[at : at + ASKED_AT_ONCE], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in found]
        return out

    def _learn_plain(self, chunks: list[str]) -> list[bytes]:
        """One call for many words: a word ends with the token that says so."""
        words = [c for c in chunks if c.isascii() and c.isalpha()]
        found: dict[str, bytes] = {}
        for at in range(0, len(words), ASKED_AT_ONCE):
            part = words[at : at + ASKED_AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                found.update((c, data[a:b]) for c, a, b in zip(part, [0, *ends], ends))
        rest = [c for c in chunks if c not in found]
        found.update(zip(rest, self._ask(rest), strict=True))
        return [found[c] for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number per text."""
        texts = pc.fill_null(texts, "")
        plain = pc.match_substring_regex(texts, PLAIN_TEXT)
        for x in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, x))
        plain = plain.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        made = []
        for kind, store in ((True, self.plain_chunks), (False, self.other_chunks)):
            members = np.flatnonzero(plain == kind)
            if len(members):
                part = pc.replace_substring(texts.take(pa.array(members)), "\n", " ")
                if kind:
                    part = pc.replace_substring_regex(pc.utf8_lower(part), RUN_END, r"\1 \2")
                ids, counts[members] = store.encode(pc.split_pattern(part, " "))
                made.append((members, ids))
        starts = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), "<u4")
        for members, ids in made:
            out[spread(starts[members], counts[members])] = ids
        return out, counts


_ENCODERS: dict[int, ChunkEncoder] = {}


def _encoder(description: str, special: list[str], last: bytes) -> ChunkEncoder:
    key = hash(description)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(description, special, last)
    return _ENCODERS[key]


def vocabulary_facts(path: str) -> tuple[str, list[str], bytes]:
    """What ``ChunkEncoder`` takes, from a vocabulary file read on the driver."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        description = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(description) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    described = json.loads(description)
    suffix = described["model"].get("end_of_word_suffix")
    vocab = Tokenizer.from_str(description).get_vocab()
    last = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        last[i] = bool(suffix) and token.endswith(suffix)
    return description, [t["content"] for t in described.get("added_tokens") or []], last.tobytes()


def packed_documents(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per row ``id``, the number of ids ``n``, their ``packed`` bytes and the ``width``."""
    facts = vocabulary_facts(path)
    width = width_of(max(len(facts[2]), end_id + 1))
    sent = docs.sparkSession.sparkContext.broadcast(facts)

    def start():
        encoder = _encoder(*sent.value)

        def run(texts: pa.Array):
            ids, counts = encoder.encode(texts)
            groups = -(-(counts + 1) // 8)
            ends = np.cumsum(groups)
            padded = np.zeros(8 * (ends[-1] if len(ends) else 0), np.uint32)
            starts = 8 * (ends - groups)
            padded[spread(starts, counts)] = ids
            padded[starts + counts] = end_id
            offsets = pa.array(np.concatenate(([0], ends * width)).astype(np.int32))
            bits = pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets.buffers()[1], pa.py_buffer(pack(padded, width))])
            return [pa.array(counts + 1, pa.int64()), bits]

        return run

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = map_texts(plain, "text", ["id"], [("n", T.LongType()), ("packed", T.BinaryType())], start, limit=2 << 20, arrow=True)
    return out.withColumn("width", F.lit(width))


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """Encode ``docs`` with the vocabulary at ``path``, ``end_id`` after each, into files in ``folder``."""
    n = partitions(docs.sparkSession)
    edges = docs.select(F.col(id_col).cast("long").alias("id")).approxQuantile("id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    edges = sorted(set(int(e) for e in edges))
    packed = packed_documents(docs, path, end_id, id_col, text_col)
    at = F.coalesce(F.aggregate(F.array(*map(F.lit, edges)).cast("array<long>"), F.lit(0), lambda a, e: a + (F.col("id") > e).cast("int")), F.lit(0))
    ordered = packed.withColumn("shard", at).repartitionById(n, F.col("shard")).sortWithinPartitions("id", "packed")

    schema = to_arrow_schema(T.StructType.fromDDL(BLOCKS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = before = number = 0

        def row() -> pa.RecordBatch:
            ids, lengths, parts, widths, shards = zip(*held, strict=True)
            ends = np.cumsum([0, *(len(p) // widths[0] for p in parts)])
            real = [i for i in ids if i is not None]
            values = [shards[0], number, min(real, default=None), max(real, default=None), widths[0], before, sum(lengths), list(ids), list(lengths), ends[:-1].tolist(), b"".join(parts)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, length, bits, width, shard in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "packed", "width", "shard")), strict=True):
                if held and size + len(bits) > block_bytes:
                    yield row()
                    before, number, held, size = before + sum(h[1] for h in held), number + 1, [], 0
                held.append((i, length, bits, width, shard))
                size += len(bits)
        if held:
            yield row()

    ordered.mapInArrow(blocks, BLOCKS).write.mode("error").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document ``id``, ``start`` (ids of all documents before it) and ``tokens``, from files of ``write``."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                lengths, groups = np.array(b["lengths"], np.int64), np.array(b["groups"], np.int64)
                ids = unpack(b["payload"], b["width"])
                first = groups * 8
                pick = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                ends = np.concatenate(([0], np.cumsum(lengths)))
                tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[pick].astype(np.int32)))
                starts = b["ahead"] + b["before"] + ends[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(b["ids"], pa.int64()), pa.array(starts), pa.array(lengths), tokens], names=["id", "start", "n", "tokens"])

    return _placed(spark, folder).mapInArrow(documents, "id long, start long, n long, tokens array<int>")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with ``ahead``, the ids of all shards before theirs. There are as many shards as shuffle partitions at writing."""
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids_of_shard"))
    earlier = F.coalesce(F.sum("ids_of_shard").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.join(F.broadcast(shards.select("shard", earlier.alias("ahead"))), "shard")


def document(spark: SparkSession, folder: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document by random access: its block is found by statistics, its bytes by offset."""
    blocks = spark.read.schema(BLOCKS).parquet(folder).filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.array_position("ids", F.lit(doc_id)).cast("int")
    cut = blocks.withColumn("at", at).filter(F.col("at") > 0).select(
        "width", F.col("lengths")[F.col("at") - 1].alias("n"), F.expr("substring(payload, int(groups[at - 1] * width + 1), int(ceil(lengths[at - 1] / 8.0) * width))").alias("bits")
    )
    row = cut.first()
    return None if row is None else unpack(bytes(row.bits), row.width, 0, row.n)


def checksums(documents: DataFrame) -> DataFrame:
    """Per row of ``read``: ``id``, ``start``, ``n`` and ``crc``, the CRC-32 of its ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            values, ends = tokens.values.to_numpy().astype("<u4"), tokens.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n"), pa.array(crc, pa.int64())], names=["id", "start", "n", "crc"])

    return documents.mapInArrow(run, "id long, start long, n long, crc long")
