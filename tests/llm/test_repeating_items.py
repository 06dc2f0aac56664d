"""Benchmark items that repeat shingles, against brute force."""

import random

import pytest

from quantloom.llm import decontam


def words(n, seed):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def test_items_that_repeat_a_passage(spark):
    items, texts = {}, []
    for k in range(12):
        passage = words(30, k)
        items[k] = passage * (2 + k % 3) + words(k % 4, 100 + k)
        texts += [[*words(60, 200 + k), *passage, passage[0], passage[1], passage[2], passage[3], *words(60, 300 + k)], [*words(9, 400 + k), *items[k]], [*words(60, 500 + k), *passage[:15], *words(60, 600 + k)]]
    items[50] = words(40, 50)
    texts.append([*words(20, 700), *items[50], *words(20, 701)])
    expected = {}
    for d, text in enumerate(texts):
        all_ = shingles(text)
        for i, item in items.items():
            own = shingles(item)
            best = max(sum(s in all_[a : a + len(own)] for s in own) / len(own) for a in range(len(all_)))
            if best >= decontam.SIMILARITY:
                expected[d, i] = best
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = decontam.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == expected
    assert sum((3 * k, k) in expected for k in range(12)) >= 8 and (36, 50) in expected
