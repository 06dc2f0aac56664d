"""The registered queries of the text operators, and their SQL where SQL can say them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import automata, bestfit, bpe, decontam, langid, lines, packing, quality, repair, simhash, suffix, urls, whitening
from quantloom.session import scratch_folder

QUERIES = {}
SQL = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(f):
    QUERIES[f.__name__] = f
    return f


#: The rules of the query.
URL_RULES = (
    urls.UrlRule("block", "com", "/en/"),
    urls.UrlRule("allow", "example.com", "/en/7"),
    urls.UrlRule("allow", "net", "/de/"),
    urls.UrlRule("block", "example.net", "/de/8"),
    urls.UrlRule("block", "org", "/es/"),
)


@register
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).drop("url")


@register
def op2_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    coded = bpe.encode(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document, by a network that never saw the held-out third."""
    docs = table(spark, folder, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.withColumn("held_out", langid.is_held_out("doc_id"))


@register
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict for every document."""
    judged = quality.assess(table(spark, folder, "documents"))
    return judged.select(F.col("id").alias("doc_id"), *quality.COUNTS[:5], "base_failed", "kept")


@register
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document, how many lie in strings of 200 bytes that recur, and the digest of the rest."""
    found = suffix.drop_repeated_bytes(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of lines and the digest of the kept lines of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register
def op8_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_components(table(spark, folder, "documents"), words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, from the files written for all documents."""
    files = f"{scratch_folder(spark)}/tokens-{uuid.uuid4().hex}"
    packing.write(table(spark, folder, "documents"), files, vocabulary("word_bpe_49k.json"), end_id=2)
    read = packing.checksums(packing.read(spark, files))
    return read.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


@register
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document, how many start earlier in windows of twenty, and the digest of the rest."""
    found = automata.drop_repeated_words(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector on the four leading components, scaled to unit variance."""
    rows = whitening.vectors(table(spark, folder, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows, wanted=4))


@register
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and the digest of what they leave of every damaged conversation."""
    found = repair.repair(repair.damaged(table(spark, folder, "conversations")))
    digests = repair.digests(found.messages).withColumnRenamed("conv_id", "of")
    return found.reports.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


@register
def op13_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 1024 tokens."""
    packed = bestfit.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, limits=bestfit.Limits(tokens=1024))
    return packed.drop("ids")


SQL["op10_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS t,
    count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n, word FROM each
),
ranked AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY t, n ORDER BY doc_id, i) > 1 AS again FROM windows),
judged AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lost FROM ranked),
kept AS (SELECT doc_id, sum(CASE WHEN lost THEN 1 ELSE 0 END) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT lost) AS kept FROM judged GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""

SQL["op1_url_filter"] = r"""
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
),
rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN fits USING (page_id)
"""

SQL["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
),
judged AS (
  SELECT doc_id, i, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS lost FROM lines
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _quality_sql() -> str:
    rates = " UNION ALL ".join(
        f"SELECT doc_id, lang, source, '{r.name}' AS rate, CASE WHEN {r.under} > 0 THEN {r.over} / {r.under}::DOUBLE ELSE 0.0::DOUBLE END AS v, {r.least}::DOUBLE AS least, {str(r.both).lower()} AS two_sided FROM good"
        for r in quality.RATES
    )
    res, width, prior = quality.RESOLUTION, quality.WIDTH, quality.PRIOR
    quartile = lambda q: f"(exp((min(CASE WHEN upto >= {q}::DOUBLE * total THEN bucket END) + 0.5::DOUBLE) / {res}) - 1) / 1000"
    level = lambda keys: (
        f"SELECT rate, {keys}, max(total) AS total, {quartile(0.25)} AS q1, {quartile(0.75)} AS q3 FROM ("
        f"SELECT rate, {keys}, bucket, sum(sum(n)) OVER (PARTITION BY rate, {keys} ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY rate, {keys}) AS total FROM sketch GROUP BY rate, {keys}, bucket) GROUP BY rate, {keys}"
    )
    return rf"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
triples AS (SELECT doc_id, i, word || ' ' || lead(word) OVER d || ' ' || lead(word, 2) OVER d AS t FROM each WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i, CASE WHEN t IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, t) > 1 THEN 1 ELSE 0 END AS twice FROM triples),
covered AS (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM again),
repeats AS (SELECT doc_id, sum(c) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, w.lang, w.source, len(w.w) AS n_words, CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n_text_lines, 0) AS BIGINT) AS n_text_lines
  FROM words w LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id)
),
base AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
good AS (SELECT * FROM base WHERE NOT base_failed),
rates AS ({rates}),
sketch AS (SELECT rate, lang, source, CAST(floor({res} * ln(1 + 1000 * v)) AS INT) AS bucket, count(*) AS n FROM rates GROUP BY ALL),
own AS ({level("lang, source")}),
whole AS ({level("lang")}),
blended AS (
  SELECT o.rate, o.lang, o.source, (o.total * o.q1 + {prior}::DOUBLE * w.q1) / (o.total + {prior}::DOUBLE) AS b1, (o.total * o.q3 + {prior}::DOUBLE * w.q3) / (o.total + {prior}::DOUBLE) AS b3
  FROM own o JOIN whole w ON o.rate = w.rate AND o.lang IS NOT DISTINCT FROM w.lang
),
outside AS (
  SELECT r.doc_id, max(CASE WHEN r.v > b.b3 + {width}::DOUBLE * greatest(b.b3 - b.b1, r.least) OR r.two_sided AND r.v < b.b1 - {width}::DOUBLE * greatest(b.b3 - b.b1, r.least) THEN 1 ELSE 0 END) AS bad
  FROM rates r JOIN blended b ON r.rate = b.rate AND r.lang IS NOT DISTINCT FROM b.lang AND r.source IS NOT DISTINCT FROM b.source GROUP BY r.doc_id
)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(o.bad, 1) = 0 AS kept
FROM base b LEFT JOIN outside o USING (doc_id)
"""


SQL["op4_quality_rules"] = _quality_sql()
