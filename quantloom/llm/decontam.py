"""Benchmark decontamination: documents that hold a benchmark item, exactly or nearly.

Texts are lower-cased and split at white space; shingles are five words (fewer
words make one shingle), as 64-bit hashes. An item is compared with windows of
its own number of shingles:

1. A window can only be similar enough if enough of its shingles belong to items of
   its size, so windows start where that many shingles lie close together. Nothing
   that the last step would accept is lost by this.
2. Each window gets a 64-bit SimHash. It is cut into blocks; on the side of the items,
   every value within the errors that the fullest block can be spared is a key.
   By the pigeonhole principle all fingerprints within the radius meet in a block.
3. Pairs within the radius are verified by exact weighted-shingle similarity: the
   part of the item's shingles, weighted by how often the item repeats them, that
   the window contains.

An item that repeats shingles can be held by a window with fewer distinct ones and with another
fingerprint: its windows start where the fewest that suffice lie close together, and all of them
go to the third step.

Everything is built-in functions. The table of items is broadcast only below a
checked number of shingles; above, Spark joins it as it would any table.

Defined cases: null or blank texts and items have no shingles and match nothing;
rows without a document or item id are left out of the matches and their documents stay;
rows that repeat an id are matched each, and the best match per document and item is returned.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE_CLASS, shield

WORDS = 5
SIMILARITY = 0.8
RADIUS = 19
#: Blocks of a fingerprint: first bit and width.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows up to which a table made of the items is broadcast, at most 64 bytes each but for
#: shingle arrays; larger ones are sorted and merged, whatever Spark's estimate says.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: Column, words: int) -> Column:
    """The hashes of a text's word shingles in order; empty without words."""
    all_words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS), lambda w: w != "")
    hashed = F.transform(all_words, lambda w: F.xxhash64(w))

    def over(h: Column) -> Column:
        n = F.size(h)
        long_ = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
        return F.when(n >= words, long_).when(n > 0, F.array(F.xxhash64(F.concat_ws(",", h.cast("array<string>"))))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(F.array(hashed), over), 1)


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of hashes: bits set in over half of them."""
    n = F.size(hashes)

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda c, h: c + F.bit_get(h, b).cast("int"))
        return acc + F.when(2 * ones > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)


def items_of(benchmark: DataFrame, item_col: str, text_col: str, words: int) -> DataFrame:
    """``item``, ``shingles``, their number ``size`` and whether it ``repeats`` any; items without words are left out."""
    named = benchmark.select(F.col(item_col).alias("item"), shingle_hashes(F.col(text_col), words).alias("shingles"))
    sized_ = named.withColumn("size", F.size("shingles")).withColumn("repeats", F.size(F.array_distinct("shingles")) < F.col("size"))
    return sized_.filter((F.col("size") > 0) & F.col("item").isNotNull())


def least_held(size: Column, similarity: float) -> Column:
    """The shingles of an item, repeats included, that a similar window holds at least."""
    return F.ceil(size * similarity - 1e-9).cast("int")


def least_distinct(shingles: Column, need: Column) -> Column:
    """The fewest distinct shingles that make up ``need`` of an item's shingles: those it repeats most."""
    often = F.sort_array(F.transform(F.array_distinct(shingles), lambda s: F.size(F.filter(shingles, lambda x: x == s))), False)
    first = lambda n: F.aggregate(F.slice(often, 1, n), F.lit(0), lambda a, c: a + c)
    return F.size(F.filter(F.sequence(F.lit(0), F.size(often) - 1), lambda n: first(n) < need))


def item_keys(items: DataFrame, radius: int) -> DataFrame:
    """``item``, ``size``, ``item_print`` and one row per ``block`` and ``value`` that a fingerprint
    within the radius can have in the block that it differs in least."""
    spare = radius // len(BLOCKS)
    printed = items.select("item", "size", simhash(F.col("shingles")).alias("item_print"))

    def values(k: int, at: int, width: int) -> Column:
        own = _block(F.col("item_print"), at, width)
        masks = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= spare)
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(m.cast("long")).alias("value")))

    blocks = F.concat(*(values(k, at, width) for k, (at, width) in enumerate(BLOCKS)))
    return printed.select("item", "size", "item_print", F.explode(blocks).alias("x")).select("item", "size", "item_print", "x.block", "x.value")


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has few ``rows``, else for a merge join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def window_starts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``doc``, ``text_hash``, the columns of ``wanted`` but ``h`` and ``need``, and ``starts``: where windows of ``size``
    begin in which ``need`` or more positions have a shingle ``h``."""
    keys = ["doc", "text_hash", *(c for c in wanted.columns if c != "h")]
    each = docs.select("doc", "text_hash", F.posexplode(shingle_hashes(F.col("text"), words)).alias("pos", "h"))
    hits = each.join(sized(wanted, wanted.count()), "h").groupBy(*keys).agg(F.array_sort(F.collect_set("pos")).alias("at"))

    def first_to_last(i: Column) -> Column:
        first, last = F.get("at", i), F.get("at", i + F.col("need") - 1)
        return F.when(last - first < F.col("size"), F.sequence(F.greatest(F.lit(0), last - F.col("size") + 1), first)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), first_to_last)))
    return hits.filter(F.size("at") >= F.col("need")).select(*(c for c in keys if c != "need"), starts.alias("starts"))


def windows_at(docs: DataFrame, starts: DataFrame, words: int) -> DataFrame:
    """The columns of ``starts`` but ``text_hash``, and per start the shingles of its ``window``."""
    more = [c for c in starts.columns if c not in ("doc", "text_hash", "starts")]
    shingled = docs.join(starts, ["doc", "text_hash"]).select("doc", *more, "starts", shingle_hashes(F.col("text"), words).alias("all"))
    # Windows at the end of a text are shorter than the item; they keep what is there.
    return shingled.select("doc", *more, "all", F.explode("starts").alias("start")).withColumn("window", F.slice("all", F.col("start") + 1, F.col("size"))).drop("all")


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """One row per document and item it holds: ``doc_id``, ``item_id``, ``similarity``, and the best
    window's first word ``start`` and number of shingles ``n_shingles``."""
    items = items_of(benchmark, item_col, item_text_col, words)
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter(F.col("doc").isNotNull())
    plain = plain.withColumn("text_hash", F.xxhash64("text"))
    once, repeating = items.filter("not repeats"), items.filter("repeats")
    n, total, n_repeating = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if("repeats")).first()
    sizes = once.select(F.explode("shingles").alias("h"), "size").distinct().withColumn("need", least_held(F.col("size"), similarity))
    windows = windows_at(plain, window_starts(plain, sizes, words), words)
    keys = sized(item_keys(once, radius), n * sum(comb(w, e) for _, w in BLOCKS for e in range(radius // len(BLOCKS) + 1)))
    printed = windows.withColumn("print", simhash(F.col("window")))
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("print"), at, width).alias("value")) for k, (at, width) in enumerate(BLOCKS)))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius
    met = printed.withColumn("b", F.explode(blocks)).select("*", "b.block", "b.value").join(keys, ["size", "block", "value"]).filter(near)
    pairs = met.select("doc", "item", "start", "size", "window")
    if n_repeating:
        need = least_distinct(F.col("shingles"), least_held(F.col("size"), similarity))
        own = repeating.select("item", "size", need.alias("need"), F.explode(F.array_distinct("shingles")).alias("h"))
        pairs = pairs.unionByName(windows_at(plain, window_starts(plain, own, words), words).select(*pairs.columns))
    pairs = pairs.distinct()
    weights = sized(items.select(F.col("item").alias("of"), "shingles"), total)
    found = pairs.join(weights, F.col("item") == F.col("of"))
    held = F.size(F.filter("shingles", lambda s: F.array_contains("window", s)))
    scored = found.withColumn("similarity", held / F.col("size")).filter(F.col("similarity") >= similarity)
    best = scored.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("minus"), "size")).alias("best"))
    return best.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("best.similarity").alias("similarity"),
        (-F.col("best.minus")).cast("long").alias("start"), F.col("best.size").cast("long").alias("n_shingles"),
    )


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    plain, (id_, text) = shield(docs, id_col, text_col)
    found = leaks(plain, benchmark, id_, text, **options).select(F.col("doc_id").alias(id_)).distinct()
    return plain.join(found, id_, "left_anti").select(*plain.columns).toDF(*docs.columns)
