"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Counts are taken once over each whole text. Rates made of them go into one
quantile sketch per rate, language and source: document counts per logarithmic
bucket. Such sketches add up in any order to the same sketch, so partial sums
are combined before each shuffle and the thresholds do not depend on the layout;
those of a language are the sum of its sources'. A threshold is a fence beyond
the quartiles in units of their distance. A source's quartiles are weighed
against its language's by its number of documents, so small sources have no
thresholds of their own making and there is no cutoff on their size. Documents
that fail the base rules stay out of the sketches.

Defined cases: null texts have no words and fail the base rules; a null language
or source is a group like any other; repeated rows count each; a rate over
nothing is zero.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import LAST_ID, SPACES, map_texts, shield
from quantloom.session import stored

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines")

#: Buckets per factor e of one plus a thousand times the rate: about 5 % relative error.
RESOLUTION = 20


@dataclass(frozen=True)
class Rate:
    """``over / under`` must lie within ``width`` quartile distances of the quartiles, where the
    distance is taken as ``least`` at least; below only if ``both``."""

    name: str
    over: str
    under: str
    least: float
    both: bool = False


RATES = (
    Rate("symbols", "n_symbols", "n_words", 0.05),
    Rate("dup_lines", "n_dup_lines", "n_text_lines", 0.15),
    Rate("repeats", "n_repeat_words", "n_words", 0.15),
    Rate("word_length", "word_chars", "n_words", 0.5, both=True),
)
WIDTH = 3.0
#: Documents that a language's quartiles weigh against those of a source.
PRIOR = 100.0


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The values of ``COUNTS`` for one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        found, end = Counter(triples), 0
        for i, t in enumerate(triples):
            if found[t] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: ``id``, ``row`` (a hash of text, language and source), ``lang``, ``source``, the
    counts and ``base_failed``."""
    names = dict(id=id_col, text=text_col, lang=lang_col, source=source_col)
    plain = docs.select(*(F.col(c).alias(n) for n, c in names.items())).withColumn("row", F.xxhash64("text", "lang", "source"))

    def start():
        return lambda texts: list(zip(*map(counts_of, texts), strict=True)) or [[] for _ in COUNTS]

    out = map_texts(plain, "text", ["id", "row", "lang", "source"], [(c, T.LongType()) for c in COUNTS], start)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rate_value(r: Rate) -> Column:
    return F.when(F.col(r.under) > 0, F.col(r.over) / F.col(r.under)).otherwise(F.lit(0.0))


def sketches(counts: DataFrame) -> DataFrame:
    """``rate``, ``lang``, ``source``, ``bucket`` and ``n``: the sketches of the base-passing rows."""
    bucket = lambda r: F.floor(RESOLUTION * F.log(1 + 1000 * rate_value(r))).cast("int")
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rate"), bucket(r).alias("bucket")) for r in RATES)))
    rows = counts.filter(~F.col("base_failed")).select("lang", "source", each.alias("x"))
    return rows.groupBy(F.col("x.rate").alias("rate"), "lang", "source", F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Per rate and ``keys``: documents ``total`` and the quartiles ``q1`` and ``q3`` of the sketch."""
    merged = sketch.groupBy("rate", *keys, "bucket").agg(F.sum("n").alias("n"))
    group = W.partitionBy("rate", *keys)
    ranked = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    at = lambda share: (F.exp((F.min(F.when(F.col("upto") >= share * F.col("total"), F.col("bucket"))) + 0.5) / RESOLUTION) - 1) / 1000
    return ranked.groupBy("rate", *keys).agg(F.max("total").alias("total"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(sketch: DataFrame) -> DataFrame:
    """Per ``lang`` and ``source`` the columns ``<rate>_low`` and ``<rate>_high``."""
    own = quartiles(sketch, ["lang", "source"])
    whole = quartiles(sketch, ["lang"]).select("rate", F.col("lang").alias("of"), F.col("q1").alias("w1"), F.col("q3").alias("w3"))
    same = (F.col("rate") == F.col("of_rate")) & F.col("lang").eqNullSafe(F.col("of"))
    both = own.join(whole.withColumnRenamed("rate", "of_rate"), same)
    blend = lambda a, b: (F.col("total") * F.col(a) + PRIOR * F.col(b)) / (F.col("total") + PRIOR)
    least = F.coalesce(*(F.when(F.col("rate") == r.name, F.lit(r.least)) for r in RATES))
    low_too = F.col("rate").isin(*(r.name for r in RATES if r.both))
    spread = F.greatest(F.col("b3") - F.col("b1"), least)
    limits = both.select("lang", "source", "rate", blend("q1", "w1").alias("b1"), blend("q3", "w3").alias("b3")).select(
        "lang", "source", "rate", F.when(low_too, F.col("b1") - WIDTH * spread).alias("low"), (F.col("b3") + WIDTH * spread).alias("high")
    )
    entry = lambda r, side: F.max(F.when(F.col("rate") == r.name, F.col(side))).alias(f"{r.name}_{side}")
    return limits.groupBy("lang", "source").agg(*(entry(r, s) for r in RATES for s in ("low", "high")))


def judged(counts: DataFrame) -> DataFrame:
    """``counts`` with ``kept``: passes the base rules and lies within all fences of its group."""
    limits = fences(sketches(counts)).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    met = counts.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    inside = F.lit(True)
    for r in RATES:
        inside = inside & (rate_value(r) <= F.col(f"{r.name}_high"))
        if r.both:
            inside = inside & (rate_value(r) >= F.col(f"{r.name}_low"))
    return met.select(*counts.columns, F.when(F.col("base_failed"), F.lit(False)).otherwise(inside).alias("kept"))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: ``id``, the counts, ``base_failed`` and ``kept``. The counts are stored once."""
    return judged(stored(measured(docs, id_col, text_col, lang_col, source_col), "quality"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rows that fail; each row is judged by its own text, also if its id is null or repeated."""
    plain, (id_, text, lang, source) = shield(docs, id_col, text_col, lang_col, source_col)
    failed = assess(plain, id_, text, lang, source).filter(~F.col("kept")).select(F.coalesce("id", F.lit(LAST_ID)).alias("__id"), F.col("row").alias("__row")).distinct()
    keyed = plain.withColumns({"__id": F.coalesce(F.col(id_), F.lit(LAST_ID)), "__row": F.xxhash64(text, lang, source)})
    return keyed.join(failed, ["__id", "__row"], "left_anti").select(*plain.columns).toDF(*docs.columns)
