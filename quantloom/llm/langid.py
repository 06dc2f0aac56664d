"""Language ID by a byte convolutional network.

Texts are lower-cased and cut into windows of a fixed number of bytes, all of
them, the last one padded. A byte has an embedding; filters of several widths run
over it, each takes its maximum over the window, and a softmax over the maxima
gives the languages. A text's probabilities are the mean over its windows, weighted
by their bytes.

Training is numpy on the driver, on windows of a bounded sample of labelled rows:
``docs_per_language`` documents expected for each language, chosen by a hash of
their id, and ``windows_per_doc`` windows spread evenly over each text. After it,
embedding and filters fold into tables: the response of a filter is the sum of
one table row for each byte or pair of bytes, so prediction is lookups, additions
and a maximum, in one Arrow pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so
is every text if there is nothing to learn from; repeated rows are predicted each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import map_texts

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: Bounds of the training sample: documents of a language, documents in all, windows of a document.
DOCS_PER_LANGUAGE = 500
SAMPLE_DOCS = 200_000
WINDOWS_PER_DOC = 6
#: Languages whose counts are sent to all tasks; more are joined by a shuffle.
SENT_LANGUAGES = 100_000
EPOCHS = 12
BATCH = 64
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # per width: width x EMBEDDING x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # features x languages
    out_bias: np.ndarray


def windows_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts as rows of bytes, the text of each, and how many bytes it holds."""
    sizes = np.array([len(d) for d in data], np.int64)
    per = np.maximum(1, -(-sizes // WINDOW))
    rows = np.frombuffer(b"".join(d.ljust(int(n) * WINDOW, b"\0") for d, n in zip(data, per, strict=True)), np.uint8).reshape(-1, WINDOW)
    text = np.repeat(np.arange(len(data)), per)
    first = np.repeat(np.cumsum(per) - per, per)
    held = np.minimum(WINDOW, np.maximum(sizes[text] - WINDOW * (np.arange(len(text)) - first), 0))
    return rows, text, held


def lowered(texts: pa.Array) -> list[bytes]:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")).cast(pa.binary()).to_pylist()


def _tables(net: Network) -> list[np.ndarray]:
    """Per width, the contribution of each byte at each place: width x 256 x FILTERS."""
    return [np.einsum("be,wef->wbf", net.embedding, f) for f in net.filters]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit by Adam on windows ``rows`` (n x WINDOW bytes) with label numbers."""
    rng = np.random.default_rng(seed)
    shape = [rng.normal(0, 0.5, (256, EMBEDDING)), *(rng.normal(0, (1 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS)]
    shape += [np.zeros(FILTERS) for _ in WIDTHS] + [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    params = [p.astype(np.float32) for p in shape]
    k = len(WIDTHS)
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            x, y = rows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
            net = Network(languages, params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1])
            best, peaks = [], []
            for w, table, bias in zip(WIDTHS, _tables(net), net.bias, strict=True):
                response = sum(table[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                peak = response.argmax(axis=1)
                peaks.append(peak)
                best.append(np.take_along_axis(response, peak[:, None, :], axis=1)[:, 0, :] + bias)
            raw = np.concatenate(best, axis=1)
            features = np.maximum(raw, 0)
            d_out = _softmax(features @ net.out + net.out_bias)
            d_out[np.arange(len(y)), y] -= 1
            d_out /= len(y)
            d_raw = (d_out @ net.out.T) * (raw > 0)
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = features.T @ d_out, d_out.sum(axis=0)
            row = np.arange(len(x))[:, None]
            for i, (w, peak) in enumerate(zip(WIDTHS, peaks, strict=True)):
                d = d_raw[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + k + i] = d.sum(axis=0)
                for j in range(w):
                    seen = x[row, peak + j]
                    grads[1 + i][j] = np.einsum("nfe,nf->ef", net.embedding[seen], d)
                    np.add.at(grads[0], seen, d[:, :, None] * net.filters[i][j].T[None])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1])


class Predictor:
    """A network folded into lookup tables of bytes and pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        self.parts: list[list[tuple[int, np.ndarray]]] = []
        for table in _tables(net):
            parts = []
            for j in range(0, len(table) - 1, 2):
                pairs = table[j][None, :, :] + table[j + 1][:, None, :]  # low byte first
                parts.append((j, np.ascontiguousarray(pairs.reshape(65536, -1), np.float32)))
            if len(table) % 2:
                parts.append((len(table) - 1, np.ascontiguousarray(table[-1], np.float32)))
            self.parts.append(parts)

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each window."""
        out = []
        for at in range(0, len(rows), 32):
            x = rows[at : at + 32].astype(np.int64)
            pairs = x[:, :-1] | x[:, 1:] << 8
            best = []
            for w, parts, bias in zip(WIDTHS, self.parts, self.net.bias, strict=True):
                end = WINDOW - w + 1
                response = None
                for j, table in parts:
                    part = table[pairs[:, j : j + end] if len(table) > 256 else x[:, j : j + end]]
                    response = part if response is None else np.add(response, part, out=response)
                best.append(response.max(axis=1) + bias)
            out.append(_softmax(np.maximum(np.concatenate(best, axis=1), 0) @ self.net.out + self.net.out_bias))
        return np.concatenate(out) if out else np.empty((0, len(self.net.languages)))

    def texts(self, data: list[bytes]) -> np.ndarray:
        """Probabilities of the languages for each text."""
        rows, text, held = windows_of(data)
        weight = np.maximum(held, 1)
        total = np.zeros((len(data), len(self.net.languages)))
        np.add.at(total, text, self.windows(rows) * weight[:, None])
        return total / np.bincount(text, weight, len(data))[:, None]


def is_held_out(id_col: str) -> Column:
    """One third of the documents, by a checksum of their id; never learned from. False without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC) -> Network | None:
    """A network trained on a bounded sample of labelled rows that are not held out; null without any."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = plain.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("id"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    n_languages = counts.count()
    if not n_languages:
        return None
    # Many languages share the sample; none is a reason to stop.
    each = min(docs_per_language, SAMPLE_DOCS / n_languages)
    draw = (F.xxhash64("id", F.lit(1)).cast("double") + 2.0**63) / 2.0**64
    met = labelled.join(F.broadcast(counts) if n_languages <= SENT_LANGUAGES else counts, "lang")
    sample = met.withColumn("draw", draw / (F.lit(float(each)) / F.col("n"))).filter(F.col("draw") < 1)

    def start():
        def pick(texts: pa.Array):
            out = []
            for data in lowered(texts):
                rows, _, held = windows_of([data])
                chosen = np.unique(np.linspace(0, len(rows) - 1, min(windows_per_doc, len(rows))).astype(int))
                out.append([rows[i].tobytes() for i in chosen if held[i] >= min(64, len(data))])
            return [out]

        return pick

    cut = map_texts(sample, "text", ["id", "lang", "draw"], [("windows", T.ArrayType(T.BinaryType()))], start, arrow=True)
    bound = math.ceil(each * n_languages * 2)
    taken = cut.orderBy("draw", "id").limit(bound).select("lang", "windows").toArrow().to_pylist()
    place = {name: k for k, name in enumerate(sorted({r["lang"] for r in taken}))}
    languages = list(place)
    pairs = [(w, place[r["lang"]]) for r in taken for w in r["windows"]]
    if not pairs:
        return None
    rows = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, WINDOW)
    return train(rows, np.array([y for _, y in pairs], np.int64), languages)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``lang_pred`` and ``score``."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if net is None:
        return plain.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def start():
        predictor = Predictor(sent.value)
        names = np.array(sent.value.languages, object)

        def run(texts: pa.Array):
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            shares = predictor.texts(lowered(texts))
            best = shares.argmax(axis=1)
            score = np.clip(shares[np.arange(len(best)), best], 0, 1)
            return [pa.array(np.where(letters, names[best], UNKNOWN).tolist(), pa.string()), pa.array(np.where(letters, score, 0.0))]

        return run

    return map_texts(plain, "text", ["doc_id"], [("lang_pred", T.StringType()), ("score", T.DoubleType())], start, limit=2 << 20, arrow=True)
