"""Line dedup: repeated lines stay only in the document with the smallest id.

Line keys are hashed to 128 bits. The hashes are dealt out by their range and
sorted by document and position, and a running first value over each sorted
range tells the first document of a key. This happens in two rounds: the first
looks at slices of the documents, so a line that a third of all documents hold
is spread over all tasks, and at most one document per slice reaches the second
round. What comes back per document is a bitmap of its lines, in 64-line words
of which only those with a dropped line are stored. Everything is built-in
functions.

Defined cases: a null text has one empty line and stays null; rows without an
id count as one document after all others; rows that repeat an id count as the
same document, and each of them is judged by its own text; extra columns, with
any names, are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import LAST_ID, SPACES, ascii_lower, partitions, range_of, shield, unshield

MIN_CHARS = 10


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id`` and ``__row`` say which rows are the same document and text."""
    return docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), "__row": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def line_hashes(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """One row per line with a key of ``min_chars`` code points or more."""
    lines = docs.select("__id", "__row", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("__id", "__row", "pos", ascii_lower(F.btrim("line", F.lit(SPACES))).alias("key"))
    kept = keyed.filter(F.length("key") >= min_chars)
    return kept.select("__id", "__row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(hashes: DataFrame) -> DataFrame:
    """Rows of ``line_hashes`` whose key occurs in a document with a smaller id."""
    n = partitions(hashes.sparkSession)
    slice_ = F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int")
    spread = F.pmod(range_of(F.col("h1"), n) + F.col("slice"), F.lit(n)).cast("int")
    first = (
        hashes.withColumn("slice", slice_).withColumn("part", spread)
        .repartitionById(n, F.col("part"))
        .withColumn("first", F.first("__id").over(W.partitionBy("part", "h1", "h2", "slice").orderBy("__id", "pos")))
        .withColumn("later", F.col("__id") > F.col("first"))
    )
    # Rows that have lost already need no meeting point: they stay spread by slice.
    home = F.when(F.col("later"), spread).otherwise(range_of(F.col("h1"), n))
    second = (
        first.select("__id", "__row", "pos", "h1", "h2", "later", home.alias("part"))
        .repartitionById(n, F.col("part"))
        .withColumn("first", F.first("__id").over(W.partitionBy("part", "h1", "h2", "later").orderBy("__id", "pos")))
    )
    return second.filter(F.col("later") | (F.col("__id") > F.col("first"))).select("__id", "__row", "pos")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document with a dropped line: ``__id``, ``__row`` and ``bitmap``, a map from the
    number of a 64-line word to its keep bits. A word that is absent keeps all its lines."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lost = dropped_lines(line_hashes(_identified(plain, "id", "text"), "text", min_chars)).distinct()
    bits = F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)")))
    words = lost.groupBy("__id", "__row", F.expr("pos div 64").cast("int").alias("word")).agg(bits.alias("keep"))
    return words.groupBy("__id", "__row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "keep")))).alias("bitmap"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    n_lines: str | None = None, n_dropped: str | None = None,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``; counts of lines before and of
    lines dropped under the names ``n_lines`` and ``n_dropped`` if given."""
    bitmaps = line_bitmaps(docs, id_col, text_col, min_chars)
    plain, (id_, text) = shield(docs, id_col, text_col)
    joined = _identified(plain, id_, text).join(bitmaps, ["__id", "__row"], "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")

    def stays(_, i):
        word = F.element_at("bitmap", F.floor(i / 64).cast("int"))
        return F.bit_get(F.coalesce(word, F.lit(-1).cast("long")), i % 64) == 1

    lost = F.aggregate(F.map_values("bitmap"), F.lit(0).cast("long"), lambda a, b: a + 64 - F.bit_count(b))
    out = joined.withColumns({
        "__lines": F.size(lines).cast("long"),
        "__dropped": F.coalesce(lost, F.lit(0)).cast("long"),
        text: F.when(F.col("bitmap").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, stays), "\n")),
    })
    return unshield(out, docs.columns, **{n: c for n, c in ((n_lines, "__lines"), (n_dropped, "__dropped")) if n})
