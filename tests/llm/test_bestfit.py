"""Best-fit packing: the ids of the library, whole sequences, and the plan of a piece-by-piece packer."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quantloom.llm import bestfit
from quantloom.llm.queries import QUERIES, vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")


def one_by_one(lengths, limits, rule):
    """What is left in every sequence when pieces are placed singly, longest first."""
    capacity, weights = limits.capacities, np.array(limits.weights)
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [k for k, rest in enumerate(bins) if (rest >= need).all()]
        if rule == "norm":
            score = {k: (weights * ((bins[k] - need) / capacity) ** 2).sum() for k in fits}
        else:
            score = {k: -(weights * (bins[k] / capacity) * (need / capacity)).sum() for k in fits}
        if not fits:
            bins.append(capacity - need)
        else:
            k = min(fits, key=lambda k: score[k])
            bins[k] = bins[k] - need
    return Counter(tuple(b.tolist()) for b in bins)


def filled(plan, limits):
    """What the plan leaves in every sequence; checks that pieces lie without gaps."""
    bins = [[] for _ in range(plan.sequences)]
    for length, _, count, first, each, offset in zip(*(c.tolist() for c in plan[:-1])):
        for k in range(count):
            bins[first + k // each].append((offset + k % each * length, length))
    left = Counter()
    for b in bins:
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        left[tuple((limits.capacities - np.array([at, len(b), sum(n * n for _, n in b)])).tolist())] += 1
    return left


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [bestfit.Limits(64), bestfit.Limits(64, 3), bestfit.Limits(64, 5, 1500), bestfit.Limits(64, None, 64 * 64, (0.2, 1.0, 0.5))])
def test_plan_equals_single_placement(rule, limits):
    rnd = random.Random(7)
    for size in (0, 1, 5, 60, 400):
        lengths = [min(38 if limits.attention == 1500 else 64, 1 + int(rnd.expovariate(0.06))) for _ in range(size)]
        plan = bestfit.plan(Counter(lengths), limits, rule)
        ranks = {}
        for length, rank, count, *_ in zip(*(c.tolist() for c in plan[:-1])):
            assert rank == ranks.get(length, 0)
            ranks[length] = rank + count
        assert ranks == Counter(lengths)
        left = filled(plan, limits)
        assert all(x >= 0 for b in left for x in b)
        assert left == one_by_one(lengths, limits, rule)


def least(counts, capacity):
    """A number of sequences that no packing can undercut: large pieces exclude each other, small ones fill the rest."""
    best = 0
    for k in range(capacity // 2 + 1):
        large = sum(c for n, c in counts.items() if n > capacity - k)
        half = sum(c for n, c in counts.items() if capacity / 2 < n <= capacity - k)
        room = sum(c * (capacity - n) for n, c in counts.items() if capacity / 2 < n <= capacity - k)
        small = sum(c * n for n, c in counts.items() if k <= n <= capacity / 2)
        best = max(best, large + half + max(0, -(-(small - room) // capacity)))
    return best


def test_plan_grows_with_lengths_not_with_pieces():
    rnd = random.Random(1)
    counts = {n: rnd.randrange(1, 50) for n in range(1, 1025)}
    small = bestfit.plan(counts)
    large = bestfit.plan({n: c * 10**6 for n, c in counts.items()})
    assert len(large.length) < 4 * len(small.length)
    bound = least(counts, 1024)
    assert bound <= small.sequences <= 1.01 * bound + 1 and bound <= large.sequences / 10**6 <= 1.01 * bound


def test_refused():
    with pytest.raises(ValueError):
        bestfit.plan({10: 1}, bestfit.Limits(64, None, 50))


def check(rows, documents, capacity):
    library = Tokenizer.from_file(VOCABULARY)
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for i, text in documents:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        over = (len(ids) - 1) % capacity + 1
        for k, start in enumerate([0, *range(over, len(ids), capacity)]):
            part = np.array(ids[start : over if k == 0 else start + capacity], "<u4")
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(n for _, n in sum(by.values(), []))


def test_hard_rows(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(f"w{rnd.randrange(99)}" for _ in range(n))
    documents = [(1, None), (2, ""), (3, "<|endoftext|>"), (4, text(3000)), (5, "x" * 20000), (None, text(5)), (None, text(5)), (7, "é\n\t ß")]
    documents += [(8, text(40))] * 50 + [(k, text(rnd.randrange(90))) for k in range(20, 80)]
    frame = spark.createDataFrame([(*d, "z", 1) for d in documents], "doc_id long, text string, TEXT string, piece int").repartition(3)
    packed = bestfit.pack(frame, VOCABULARY, 2, bestfit.Limits(64)).collect()
    sequences, tokens = check(packed, documents, 64)
    assert sequences <= 1.02 * tokens / 64 + 1
    for r in bestfit.sequences(bestfit.pack(frame, VOCABULARY, 2, bestfit.Limits(64, 4))).collect():
        assert len(r.ids) <= 64 and len(r.offsets) <= 4 and r.offsets[0] == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bestfit.pack(empty, VOCABULARY, 2).collect() == []


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(VOCABULARY)
    encoder = bestfit.Encoder(open(VOCABULARY, encoding="utf-8").read())
    rnd = random.Random(9)
    parts = ["a", "Été", " ", "  ", "\n", "\t ", "\u3000", "don't", "x²", "中文", "ª", "١٢", "😀", "<|endoftext|>", ".", "e\u0301", "\x01", "Ǆ", "ⅷ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(500)] + [None, ""]
    ids, counts = encoder.encode(bestfit.pa.array(texts))
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_other_vocabularies_are_refused_or_merged_in_their_order():
    import json

    known = json.loads(open(VOCABULARY, encoding="utf-8").read())
    with pytest.raises(ValueError):
        bestfit.Encoder(json.dumps(known | {"normalizer": {"type": "Lowercase"}}))
    merges = known["model"]["merges"][:400]
    turned = [*merges[:300], merges[301], merges[300], *merges[302:]]
    symbols = sorted(known["model"]["vocab"], key=known["model"]["vocab"].get)[:656]
    small = known | {"added_tokens": [], "model": known["model"] | {"merges": turned, "vocab": {t: i for i, t in enumerate(symbols)}}}
    encoder, library = bestfit.Encoder(json.dumps(small)), Tokenizer.from_str(json.dumps(small))
    assert encoder.library is None
    text = "The thing that was there, and then some other things in this place."
    assert encoder.encode(bestfit.pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    sequences, tokens = check(QUERIES["op13_bestfit_packing"](spark, folder).collect(), documents, 1024)
    assert sequences <= 1.01 * tokens / 1024 + 1
