"""Codecs, codes, arrays and automata against brute force, without Spark."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import anchors, automata, bpe, langid, packing, quality, simhash, suffix
from quantloom.llm.queries import vocabulary

ODD = " \n\t  \xa0 \x1c\x85'sdlrevtm!?.#09éßñÄabcxyzTHÉ你😀​　\x00ªµΣςé"


def made_up(n, alphabet=ODD, size=50, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def cut(flat, counts):
    ends = np.concatenate(([0], np.cumsum(counts)))
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_bpe_equals_library_and_decodes():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.ByteBpe(open(path).read())
    texts = made_up(2000) + ["<|endoftext|>a <|endoftext|>", "a" * 3000, "ab" * 300 + " " * 700, "\x01 \x01a", "", "it's we'll"]
    for part in (texts, [t for t in texts if "\x01" not in t and "<|" not in t]):
        ids = cut(*own.encode(pa.array(part)))
        assert ids == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [own.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]
    assert cut(*own.encode(pa.array([None, "a"], pa.string())))[0] == []
    assert own.decode([10**6, -1]) == ""


def test_merging_one_or_many_is_the_same():
    merger = bpe.Merger([(0, 1, 3), (1, 2, 4), (3, 3, 5), (0, 0, 6), (6, 0, 7)], 8)
    rnd = random.Random(4)
    rows = [[rnd.randrange(3) for _ in range(rnd.randint(1, 16))] for _ in range(500)]
    many = merger.merge_many(np.array([r + [-1] * (16 - len(r)) for r in rows]))

    def plain(ids):
        while True:
            found = [(merger.ranks[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merger.ranks]
            if not found:
                return ids
            rank, k = min(found)
            ids = [*ids[:k], int(merger.merged[rank]), *ids[k + 2 :]]

    for row, out in zip(rows, many.tolist(), strict=True):
        assert [x for x in out if x >= 0] == merger.merge(row) == plain(row)


@pytest.mark.parametrize("alphabet", [ODD, " \n.,!?;:09abcdefghTHEÉéßñÄÖ#&|<>$", " \n'sdtabc.,"])
def test_chunked_library_ids(alphabet):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = made_up(3000, alphabet) + ["<|endoftext|>a <|startoftext|>x"]
    ids = cut(*packing.ChunkEncoder(*packing.vocabulary_facts(path)).encode(pa.array(texts)))
    assert ids == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bit_packing(width):
    rnd = random.Random(width)
    ids = np.array([rnd.randrange(2**width) for _ in range(45)], np.uint32)
    bits = packing.pack(ids, width)
    assert len(bits) == 6 * width
    assert (packing.unpack(bits, width)[:45] == ids).all()
    assert (packing.unpack(bits, width, 2, 20) == ids[16:36]).all()
    assert packing.unpack(b"", width).size == 0


def test_golay_indices_are_shared_within_two_bits():
    vectors = np.array([0, *random.Random(2).sample(range(1 << 23), 400)])
    assert (codes := simhash.codeword_indices(vectors)).min() >= -1
    near = simhash.codeword_indices
    for weight in (1, 2):
        for bits in ([(a,) for a in range(23)] if weight == 1 else [(a, b) for a in range(23) for b in range(a)]):
            other = near(vectors ^ sum(1 << b for b in bits))
            shared = ((codes[:, :, None] == other[:, None, :]) & (codes[:, :, None] >= 0)).any(axis=(1, 2))
            assert shared.all(), bits
    # All error patterns around one codeword, so by linearity all cases.
    by_byte, errors = simhash.golay_tables()
    leaders = errors[:, 0]
    own = near(leaders)
    for bits in [(a, b) for a in range(23) for b in range(a)]:
        other = near(leaders ^ (1 << bits[0] | 1 << bits[1]))
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_every_pair_within_four_bits_shares_a_key():
    rnd = random.Random(5)
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 4):
            b ^= 1 << bit
        keys, rows = simhash.golay_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_runs_of_any_length_are_connected():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 62, 6)
    fps = np.unique(np.concatenate([b ^ (1 << rnd.integers(0, 62, 40)) for b in base]))
    a, b = simhash.linked_in_runs(np.zeros(len(fps), np.int32), fps, 4)
    small = simhash.SHORT_RUN
    assert len(fps) > small and len(a) < len(fps)
    root = {int(f): int(f) for f in fps}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[y] = root[x]
    near = np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= 4
    labels = np.arange(len(fps))
    for _ in fps:
        labels = np.where(near, labels[None, :], len(fps)).min(axis=1)
    groups = {}
    for f, label in zip(fps.tolist(), labels.tolist(), strict=True):
        groups.setdefault(label, set()).add(root[f])
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(3)
    for _ in range(200):
        s = bytes(rnd.randrange(1, rnd.choice([2, 3, 5, 200]) + 1) for _ in range(rnd.randrange(60)))
        order = suffix.suffix_array([x + 1 for x in s] + [0], 257)[1:]
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        common = suffix.permuted_common_prefixes(s, order, 9)
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while k < 9 and s[a + k : a + k + 1] == s[b + k : b + k + 1] != b"":
                k += 1
            assert common[b] == k


def test_suffix_array_of_bytes_is_that_of_a_list():
    rnd = random.Random(5)
    for _ in range(200):
        s = bytes(rnd.randrange(1, rnd.choice([2, 3, 255]) + 1) for _ in range(rnd.randrange(60))) + b"\0"
        assert suffix.suffix_array(s, 256) == suffix.suffix_array(list(s), 256) == sorted(range(len(s)), key=lambda i: s[i:])


def test_recurring_windows_of_texts_with_character_zero():
    rnd = random.Random(6)
    for _ in range(60):
        texts = [bytes(rnd.choice(b"\0\x01a") for _ in range(rnd.randrange(8, 40))) for _ in range(4)]
        rows = [(1, k, 0, 0, len(t) - 5, [2 * (len(t) - 5)], t) for k, t in enumerate(texts)]
        counts = Counter(t[i : i + 6] for t in texts for i in range(len(t) - 5))
        want = {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 5) if counts[t[i : i + 6]] > 1}
        assert {(k, s + j) for k, _, s, n in suffix.recurring(rows, 6) for j in range(n)} == want


def test_automaton_knows_first_ends():
    rnd = random.Random(8)
    words = [bytes([rnd.choice(b"abc")]) for _ in range(300)]
    automaton = automata.SuffixAutomaton()
    for k, w in enumerate(words):
        automaton.add(w, k)
    text = b"".join(words)
    query = [bytes([rnd.choice(b"abc")]) for _ in range(200)]
    for k, (size, state) in enumerate(automaton.matches(query)):
        best = max(n for n in range(k + 2) if b"".join(query[k + 1 - n : k + 1]) in text)
        assert size == best
        for n in range(1, size + 1):
            assert automaton.first_end(state, n) == text.find(b"".join(query[k + 1 - n : k + 1])) + n - 1


def test_regions_hold_each_window_once_and_equal_windows_share_anchors():
    rnd = np.random.default_rng(0)
    counts = np.array([0, 3, 40, 90, 5, 70])
    symbols = rnd.integers(0, 3, counts.sum()).astype(np.uint64)
    ends = np.cumsum(counts)
    t, s, n, h, c = anchors.regions_of(symbols, counts, 8, 3)
    by_window, contents, seen = {}, {}, Counter()
    for k in range(len(t)):
        at = ends[t[k]] - counts[t[k]] + s[k]
        for j in range(n[k]):
            by_window.setdefault(symbols[at + j : at + j + 8].tobytes(), set()).add(int(h[k]))
            seen[t[k], s[k] + j] += 1
        contents.setdefault(int(c[k]), set()).add(symbols[at : at + n[k] + 7].tobytes())
    assert all(len(x) == 1 for x in by_window.values()) and all(len(x) == 1 for x in contents.values())
    assert seen == Counter({(t, s): 1 for t, m in enumerate(counts) for s in range(m - 7)})


def test_quality_counts():
    rnd = random.Random(6)
    for text in [None, "", " \n", "a b c a b c", *("".join(rnd.choice("ab \n#é\x1f") for _ in range(80)) for _ in range(300))]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        triples = list(zip(words, words[1:], words[2:], strict=False))
        hit = {i + k for i, x in enumerate(triples) if triples.count(x) > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(lines))
        assert quality.counts_of(text) == expected


def test_language_network_learns_and_folds():
    rnd = random.Random(1)
    data = [" ".join(rnd.choice(("lo", "la", "li") if k % 2 else ("zu", "ze", "za")) for _ in range(200)).encode() for k in range(200)]
    rows, text, _ = langid.windows_of(data)
    net = langid.train(rows[:300], text[:300] % 2, ["z", "l"])
    predictor = langid.Predictor(net)
    shares = predictor.texts(data[150:] + [b""])
    assert shares.shape == (51, 2) and np.allclose(shares.sum(axis=1), 1)
    assert (shares[:50].argmax(axis=1) == np.arange(150, 200) % 2).mean() > 0.95
    tables = [np.einsum("be,wef->wbf", net.embedding, f) for f in net.filters]
    best = [sum(t[j][rows[:2, j : langid.WINDOW - w + 1 + j]] for j in range(w)).max(axis=1) + b for w, t, b in zip(langid.WIDTHS, tables, net.bias, strict=True)]
    plain = np.maximum(np.concatenate(best, axis=1), 0) @ net.out + net.out_bias
    assert np.allclose(np.log(predictor.windows(rows[:2])), plain - np.log(np.exp(plain).sum(axis=1, keepdims=True)), atol=1e-4)
