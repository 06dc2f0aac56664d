"""The text operators on small tables with hard rows, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quantloom.llm import automata, bpe, components, decontam, langid, lines, packing, quality, simhash, suffix, urls
from quantloom.llm.queries import QUERIES, SQL, URL_RULES, vocabulary
from quantloom.session import scratch_folder

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, size=500):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


def hard_rows():
    base = words(120, 1)
    passage = words(60, 2)
    texts = [
        None, "", "   \n\t", "a", "é ß", " ".join(base), " ".join(base), " ".join([*base[:50], "other", *base[51:]]),
        " ".join([*words(30, 3), *passage, *words(30, 4)]), " ".join([*words(9, 5), *passage, *passage]),
        "A repeated LINE here\nown line of five\na repeated line here  \nx", "  a repeated line here\n\ny", "x" * 70000, " ".join(words(20000, 6)),
    ]
    rows = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None, 0) for k, t in enumerate(texts)]
    return [*rows, rows[6], rows[8], (None, texts[8], "en", "s", 0), (3, "same id " + texts[8], "en", "s", 0)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def distinct_documents():
    """(id, text) once each, rows without an id last, as the span operators count them."""
    return sorted({(10**18 if r[0] is None else r[0], r[1] or "") for r in hard_rows()})


@pytest.mark.parametrize("heavy", [50_000, 0])
def test_repeated_words(hard, heavy):
    docs = distinct_documents()
    ids = [i for i, _ in docs]
    seen, lost = set(), {}
    for at, (i, text) in enumerate(docs):
        w = text.split()
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = True
            seen.add(key)
        lost[at] = (len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    # Which of two texts with one id comes first is the operator's choice; such ids are compared as sums.
    got = automata.drop_repeated_words(hard, heavy=heavy).collect()
    assert len(got) == len(hard_rows())
    once = {i for i in ids if ids.count(i) == 1}
    expected = {i: lost[at] for at, i in enumerate(ids) if i in once}
    for r in got:
        i = 10**18 if r.doc_id is None else r.doc_id
        if i in once:
            assert (r.n_words, r.n_removed, r.kept) == expected[i], i
            assert sum(n for _, n in r.spans) == r.n_removed


@pytest.mark.parametrize("heavy", [50_000, 0])
def test_repeated_bytes(hard, heavy):
    docs = distinct_documents()
    seen = {}
    for _, text in docs:
        data = text.encode()
        for k in range(len(data) - 199):
            key = hash(data[k : k + 200])
            seen[key] = seen.get(key, 0) + 1
    got = suffix.drop_repeated_bytes(hard, heavy=heavy).collect()
    assert len(got) == len(hard_rows())
    expected = set()
    for i, text in docs:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 199):
            if seen[hash(data[k : k + 200])] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        expected.add((i, len(data), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), kept))
    assert {(10**18 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == expected


def test_lines(spark, hard):
    out = {r.doc_id: r for r in lines.drop_repeated_lines(hard.withColumnRenamed("source", "bitmap"), n_lines="a", n_dropped="b").collect()}
    assert out[10].text == "A repeated LINE here\nown line of five\na repeated line here  \nx" and out[10].b == 0
    assert out[11].text == "\ny" and (out[11].a, out[11].b) == (3, 1)
    assert out[0].text is None and (out[0].a, out[0].b) == (1, 0) and (out[1].text, out[1].a) == ("", 1)
    assert out[6].text == "" and out[7].text is not None and out[None].text == ""
    many = spark.createDataFrame([(k, "\n".join(["the same long line"] * 200 + [f"own line number {k}"])) for k in range(30)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.drop_repeated_lines(many).collect()}
    assert kept[0].count("same") == 200 and all(kept[k] == f"own line number {k}" for k in range(1, 30))


def test_near_components(hard):
    rows = hard_rows()
    fps = [simhash.fingerprint(r[1], 4) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[b] for b in range(len(rows)) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4) for a in range(len(rows))]
    group = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            group[label[k]] = min(group.get(label[k], 10**18), r[0])
    expected = sorted((r[0] is None, r[0] or 0, fps[k], group.get(label[k])) for k, r in enumerate(rows))
    got = simhash.near_components(hard, words=4).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in got) == expected
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.collect()} >= {None, 0, 3, 5, 13} and 6 not in {r.doc_id for r in kept.collect()}


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 160)}}


def test_leaks_against_brute_force(spark):
    item = words(40, 11)
    near = [*item[:20], "changed", *item[21:]]
    texts = ["", None, " ".join([*words(50, 12), *item, *words(5, 13)]), " ".join([*words(9, 14), *near, *words(50, 15)]), " ".join(words(300, 16)), " ".join(item[:25]).upper(), "one two three", " ".join(item * 3)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[2]), (2, texts[2])], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item).title()), (2, "one  two\nthree"), (3, ""), (4, None), (None, texts[2])], "item_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    expected = {}
    for k, t in enumerate(texts):
        for i, b in ((1, " ".join(item)), (2, "one two three")):
            own, all_ = shingles(b), shingles(t)
            best = max((sum(s in all_[a : a + len(own)] for s in own) / len(own) for a in range(len(all_))), default=0)
            if best >= decontam.SIMILARITY:
                expected[k, i] = best
    got = decontam.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == expected and (3, 1) in expected and (6, 2) in expected
    assert sorted(r.doc_id for r in decontam.drop_leaked(docs, benchmark).filter("doc_id is not null").collect()) == [0, 1, 4, 5]


def test_hamming_blocks_meet_all_within_radius(spark):
    rnd = random.Random(9)
    spare = decontam.RADIUS // len(decontam.BLOCKS)
    assert sum(w for _, w in decontam.BLOCKS) == 64
    for _ in range(200):
        error = sum(1 << b for b in rnd.sample(range(64), decontam.RADIUS))
        assert min((error >> at & ((1 << w) - 1)).bit_count() for at, w in decontam.BLOCKS) <= spare


def test_urls(spark):
    rules = [urls.UrlRule("block", "com", "/en/"), urls.UrlRule("allow", "example.com", "/en/7"), urls.UrlRule("block", "a.org"), urls.UrlRule("block", "b.net", "/x*z/q")]
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://EXAMPLE.com/en/71?x": ("example.com", "/en/71", "example.com/en/7", "allow"),
        "http://notexample.com/en/7#a": ("notexample.com", "/en/7", "com/en/", "block"), "https://x.a.org": ("x.a.org", "", "a.org", "block"), "x://aa.org/": ("aa.org", "/", None, "allow"),
        "http://example.com?/en/7": ("example.com", "", None, "allow"), "http://b.net/x/y/z/q": ("b.net", "/x/y/z/q", "b.net/x*z/q", "block"), "http://com/EN/": ("com", "/EN/", None, "allow"), "://": ("", "", None, "allow"),
    }
    table = spark.createDataFrame([(u, "kept") for u in cases] * 2, "url string, rule string")
    got = urls.judge(table, rules).collect()
    assert len(got) == 2 * len(cases) and all((r.host, r.path, r.rule, r.verdict) == cases[r.url] for r in got)
    shards, urls.SHARD_RULES = urls.SHARD_RULES, 1
    try:
        assert sorted(map(str, urls.judge(table, rules).collect())) == sorted(map(str, got))
    finally:
        urls.SHARD_RULES = shards


def test_token_files(spark, hard):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    files = f"{scratch_folder(spark)}/test-tokens"
    packing.write(hard, files, path, end_id=2, block_bytes=3000)
    library = Tokenizer.from_file(path)
    ids = {k: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for k, r in enumerate(hard_rows())}
    got = sorted(packing.checksums(packing.read(spark, files)).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted((r[0] for r in hard_rows()), key=lambda x: -1 if x is None else x)
    assert [r.start for r in got] == np.cumsum([0, *(r.n for r in got)])[:-1].tolist()
    expected = sorted((-1 if r[0] is None else r[0], len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k, r in enumerate(hard_rows()))
    assert sorted((-1 if r.id is None else r.id, r.n, r.crc) for r in got) == expected
    assert packing.document(spark, files, 13).tolist() == ids[13] and packing.document(spark, files, 999) is None


def test_bpe_frames(hard):
    coded = bpe.encode(hard, vocabulary("byte_bpe_50k.json"), decoded=True, keep_text="own")
    rows = coded.collect()
    assert all(r.decoded == (r.own or "") for r in rows) and len(rows) == len(hard_rows())
    again = bpe.decode(coded.select("doc_id", "ids"), vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(r.text for r in again) == sorted(r.decoded for r in rows)


def test_quality_fences(spark):
    clean = [(k, " ".join(words(100, k)), "en", f"s{k % 2}", 0) for k in range(60)]
    odd = [(100, " ".join(w + "&&" for w in words(100, 77)), "en", "s0", 0), (101, "short", "en", "s1", 0), (102, " ".join(["a b c"] * 40), None, None, 0)]
    table = spark.createDataFrame(clean + odd, COLUMNS)
    judged = {r.id: r for r in quality.assess(table).collect()}
    assert all(judged[k].kept for k in range(60)) and not any(judged[k].kept for k in (100, 101, 102))
    assert judged[101].base_failed and judged[102].base_failed and not judged[100].base_failed
    kept = quality.keep_good(table.withColumnRenamed("n_chars", "lang_high"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60)) and "lang_high" in kept.columns


def test_language_frames(spark, hard, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = langid.fit(docs)
    found = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").withColumn("out", langid.is_held_out("doc_id")).collect()
    held = [r.lang == r.lang_pred for r in found if r.out]
    assert len(held) > 40 and np.mean(held) > 0.9
    rows = {r.doc_id: r for r in langid.predict(hard, net).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0 and 0 <= rows[13].score <= 1
    assert langid.fit(empty) is None and langid.predict(hard, None).filter("lang_pred != 'und'").count() == 0


def test_many_languages_are_learned_from_a_bounded_sample(spark, monkeypatch):
    rows = [(k, " ".join(words(40, k)), f"l{k % 450:03d}", "s", 0) for k in range(1400)]
    docs = spark.createDataFrame(rows, COLUMNS)
    monkeypatch.setattr(langid, "EPOCHS", 1)
    assert len(langid.fit(docs).languages) > 400
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 100)
    monkeypatch.setattr(langid, "SENT_LANGUAGES", 1)
    net = langid.fit(docs)
    assert 1 <= len(net.languages) <= 250
    assert {r.lang_pred for r in langid.predict(docs, net).collect()} <= {*net.languages, "und"}


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    assert lines.drop_repeated_lines(empty).count() == quality.assess(empty).count() == quality.keep_good(empty).count() == 0
    assert simhash.near_components(empty).count() == decontam.leaks(empty, items).count() == bpe.encode(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert automata.drop_repeated_words(empty).count() == suffix.drop_repeated_bytes(empty).count() == 0
    assert urls.judge(spark.createDataFrame([], "url string"), [urls.UrlRule("block", "com")]).count() == 0
    files = f"{scratch_folder(spark)}/no-tokens"
    packing.write(empty, files, vocabulary("word_bpe_49k.json"), end_id=2)
    assert packing.read(spark, files).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    from quantloom.catalog.compare import compare

    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert compare(QUERIES[name](spark, SMALL).toArrow().to_pandas(), db.sql(SQL[name]).to_arrow_table().to_pandas()) == ""


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_on_hard_rows(spark, hard, tmp_path):
    """Null, empty, repeated and very long rows through all stages; tables without rows."""
    items = spark.createDataFrame([(1, " ".join(words(60, 2))), (2, None), (3, "")], "item_id long, text string")
    given = hard.union(spark.createDataFrame([(100 + k, " ".join(words(80, 50 + k)) + ".", "en", "s", 0) for k in range(6)], COLUMNS))
    for name, docs, bench in (("rows", given, items), ("no-items", given, items.limit(0)), ("none", hard.limit(0), items)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert all(r.round_trip for r in got) and (name != "none" or not got)
        ids = [r.doc_id for r in got]
        if name != "none":
            # Six unlike texts stay, of the exact copies 5, 6 and 6 one text (their only line goes elsewhere), and of what has under fifty words none.
            texts = [r.doc_id for r in got if r.n_tokens]
            assert set(range(100, 106)) <= set(texts) and texts.count(5) + texts.count(6) == 1 and not {0, 1, 2, 4} & set(ids)
        if name == "rows":
            assert not {8, 9} & set(ids), "documents that hold an item go"


def test_decontamination_of_long_and_clashing_rows(spark):
    item = words(30, 11)
    long_text = " ".join([*words(20000, 12), *item, *words(20000, 13)])
    rows = [(1, long_text, "a", 1), (2, " ".join(words(20000, 14)), "b", 2), (3, None, None, 3), (None, " ".join(item), "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, fingerprint long")
    bench = spark.createDataFrame([(7, " ".join(item), "x")], "item_id long, text string, doc_id string")
    left = decontam.drop_leaked(docs, bench)
    # Documents without an id are not looked up, and stay.
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {2, 3, None}
    assert decontam.drop_leaked(docs, bench.limit(0)).count() == 4
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_near_dedup_of_empty_long_and_clashing_rows(spark, empty):
    from quantloom.llm import similar

    assert similar.keep_one(empty).count() == 0
    base = words(30000, 21, 10**6)
    rows = [(1, " ".join(base), 5, "a"), (2, " ".join(["other", *base[1:]]), 6, "b"), (3, " ".join(words(30000, 22, 10**6)), 7, "c"), (4, None, 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, component_id string")
    left = similar.keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_very_long_urls(spark):
    rows = [(1, "http://a.example.com/en/" + "x/" * 50_000), (2, "http://" + "y." * 20_000 + "example.net/de/8" + "z" * 10_000)]
    found = {r.page_id: (r.verdict, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert found == {1: ("block", "com/en/"), 2: ("block", "example.net/de/8")}


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.id for r in quality.assess(docs).collect() if r.kept}
    first, left = {}, {}
    for i in sorted(good):
        own = []
        for line in rows[i].text.split("\n"):
            key = line.strip(" \t\n\x0b\f\r").translate(LOWER)
            if len(key) < 10 or first.setdefault(key, i) == i:
                own.append(line)
        left[i] = "\n".join(own)
    sets = {}
    for i, text in left.items():
        w = text.translate(LOWER).split(None)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    label = {i: i for i in left}
    while True:
        # Similarity of 0.8 or more; chains of such links are one group.
        new = {i: min(label[j] for j in left if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in left}
        if new == label:
            break
        label = new
    ones = [i for i in left if label[i] == i]
    items = [r.text.lower().split() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaked(text):
        w = text.lower().split()
        own = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for item in items:
            parts = [tuple(item[k : k + 5]) for k in range(len(item) - 4)]
            hits = [k for k, s in enumerate(own) if s in set(parts)]
            if any(sum(s in own[a : a + len(parts)] for s in parts) >= 0.8 * len(parts) for a in {max(0, h - j) for h in hits for j in range(len(parts))}):
                return True
        return False

    clean = [i for i in ones if not leaked(left[i])]
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(clean) and all(r.round_trip for r in got)
    coder = bpe.ByteBpe(open(vocabulary("byte_bpe_50k.json")).read())
    assert all(hashlib.sha256(coder.decode(r.ids).encode()).digest() == hashlib.sha256(left[r.doc_id].encode()).digest() for r in got)
