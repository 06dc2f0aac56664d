"""The near-dedup stage against exact Jaccard similarity."""

import random

import corpus_pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_dedup_finds_planted_copies(spark):
    rnd = random.Random(4)
    texts = [None, "", "two words", "Two  words", "two other words"]
    for base in range(60):
        own = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice((30, 100, 400, 1500)))]
        texts.append(" ".join(own))
        for copy in range(4):
            edits = rnd.sample(range(len(own)), rnd.randrange(1, 1 + max(1, len(own) // 40)))
            # Half of the copies are of the copy before: chains whose ends are not similar.
            own = [f"x{base}y{copy}z{k}" if k in edits else w for k, w in enumerate(texts[-1].split())] if copy % 2 else [f"x{base}y{copy}z{k}" if k in edits else w for k, w in enumerate(own)]
            texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    close = [(a, b) for b in range(len(texts)) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8]
    assert sum(0.8 <= jaccard(sets[a], sets[b]) < 0.95 for a, b in close) > 50
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[5]), (9, texts[9])], "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    # A row that repeats an id goes or stays with it, a row without an id stays.
    assert sorted(x for x in got if x is not None and x != 9) == [k for k, x in enumerate(label) if x == k and k != 9]
    assert got.count(9) == 2 * (label[9] == 9) and got.count(None) == 1


def test_near_dedup_links_what_the_first_of_a_key_does_not(spark):
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join("e%d" % rnd.randrange(10**9) if rnd.random() < 0.026 else w for w in base) for _ in range(60)]
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[b] for b in range(len(texts)) if jaccard(sets[a], sets[b]) >= 0.8) for a in range(len(texts))]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == [k for k, x in enumerate(label) if x == k]
    assert 1 < len(got) < len(texts)


def test_near_dedup_meets_by_simhash(spark, monkeypatch):
    from quantloom.llm import similar

    seen = []
    found = similar._simhash_pairs
    monkeypatch.setattr(similar, "_simhash_pairs", lambda distinct: seen.append(found(distinct)) or seen[-1])
    rows = [(10, 5, 0b0), (11, 6, 0b0), (12, 7, 0b1111), (13, 8, -1), (14, 9, -2), (15, 0, 0b11)]
    distinct = spark.createDataFrame(rows, "node long, size int, fingerprint long")
    # Equal fingerprints, and four bits or fewer apart; the empty set meets no other.
    got = {frozenset((r["head"], r["node"])): (r["head_size"], r["size"]) for r in found(distinct).collect()}
    assert set(got) == {frozenset(x) for x in ((10, 11), (10, 12), (13, 14))}
    assert sorted(got[frozenset((13, 14))]) == [8, 9]
    texts = [" ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(201)), "another text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
    assert len(seen) == 1 and seen[0].count() <= 1
