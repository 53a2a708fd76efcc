"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its hashed words; a document's is the
noisy-or of its sentences, 1 - prod(1 - p). The sentence model is trained from document labels alone through the
noisy-or, so it learns which sentences are to blame, and those are what ``locate`` returns.

Words: the ASCII-lower-cased runs of letters, digits and non-ASCII bytes. A word's features are the word and its
prefixes of 4 to 8 bytes, hashed. Sentences end at ``.``, ``!``, ``?`` and line ends.

Cases: a null or empty text, or one without words, has no sentence and scores 0. Without labels (or with one class
only) the model is flat: the score is the noisy-or of equal priors. Labels that are null are not learned from; repeated
rows count as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import id_remainder, map_pieces, materialize, utf8

DIMS = 1 << 20
#: The fit's bound: labelled documents, an expected number of a hash sample.
SAMPLE = 12000
#: A feature has a weight if this many of the sample's documents have it and its likelihood ratio against the label (chi-squared, one degree of freedom) is so large.
MIN_DOCS, MIN_RATIO = 4, 15.0
THRESHOLD = 0.7
#: A sentence is named as offending from this score on.
SENTENCE_THRESHOLD = 0.5

#: Letters are lower-cased; letters, digits and bytes of longer characters stay; sentence ends become line feeds; the rest is blank.
_FOLD = bytes(10 if chr(b) in ".!?\n\r" else b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def sentences(text: bytes) -> list[list[bytes]]:
    """The words of each sentence, sentences without words included."""
    return [s.split() for s in text.translate(_FOLD).split(b"\n")]


def buckets(word: bytes) -> list[int]:
    """The word's hashed features."""
    return [zlib.crc32(b"\n" + word) & (DIMS - 1), *(zlib.crc32(word[:n]) & (DIMS - 1) for n in range(4, min(len(word), 8) + 1))]


class _Lookup(dict):
    """Weights by word; frequent words stay, the number kept is bounded."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __missing__(self, word: bytes) -> float:
        value = float(self.table[buckets(word)].sum())
        if len(self) < 200_000:
            self[word] = value
        return value


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, words: list[list[bytes]], lookup: _Lookup) -> np.ndarray:
        """Of the sentences that have words."""
        sizes = [len(s) for s in words if s]
        if not sizes:
            return np.zeros(0)
        values = np.fromiter(map(lookup.__getitem__, chain.from_iterable(words)), np.float64, sum(sizes))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return _sigmoid(np.add.reduceat(values, starts) + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def likelihood_ratio(hit: np.ndarray, n: np.ndarray, hits: float, total: float) -> np.ndarray:
    """G-squared of each word's occurrence in documents against their label."""
    g = np.zeros(len(n))
    for seen, row, column in ((hit, n, hits), (n - hit, n, total - hits), (hits - hit, total - n, hits), (total - n - hits + hit, total - n, total - hits)):
        expected = row * column / total
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(seen > 0, 2 * seen * np.log(seen / expected), 0)
    return g


def train(bags: list[list[np.ndarray]], labels: np.ndarray, rounds: int = 200, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the noisy-or likelihood. bags: for each document the chosen features of each sentence with words."""
    bags, labels = [b for b in bags if b], np.array([y for b, y in zip(bags, labels, strict=True) if b], dtype=float)
    if not len(bags) or labels.min() == labels.max():
        return Model(np.zeros(DIMS, np.float32), -4.0)
    known, ids = np.unique(np.concatenate([s for b in bags for s in b]), return_inverse=True)
    sizes = np.array([len(s) for b in bags for s in b])
    sentence_of = np.repeat(np.arange(len(sizes)), sizes)
    per_doc = np.array([len(b) for b in bags])
    doc_starts, doc_of = np.concatenate(([0], np.cumsum(per_doc)[:-1])), np.repeat(np.arange(len(bags)), per_doc)
    w, bias = np.zeros(len(known)), float(np.log(max(labels.mean(), 1e-6) / per_doc.mean()))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = _sigmoid(np.bincount(sentence_of, weights=w[ids], minlength=len(sizes)) + bias)
        whole = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), doc_starts))
        blame = np.where(labels == 1, -(1 - whole) / np.maximum(whole, 1e-9), 1.0)[doc_of] * p
        g = np.bincount(ids, weights=blame[sentence_of], minlength=len(known)) / len(bags) + decay * w
        gb = blame.sum() / len(bags)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-4)
        bias -= 0.5 * rate * (mb / a) / (np.sqrt(vb / b) + 1e-4)
    weights = np.zeros(DIMS, np.float32)
    weights[known] = w
    return Model(weights, float(bias))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, the documents and toxic documents that have it; feature -1 counts the documents with words."""
    n = np.zeros((2, DIMS + 1), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w for s in sentences(text or b"") for w in s}
            if words:
                own = np.unique(np.array([i for w in words for i in buckets(w)] + [DIMS]))
                n[0, own] += 1
                n[1, own] += toxic
    found = np.flatnonzero(n[0])
    for part in np.array_split(found, max(1, len(found) // 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(np.where(part == DIMS, -1, part), pa.int32()), pa.array(n[0, part]), pa.array(n[1, part])], ["feature", "n", "hit"])


def _bags(chosen: np.ndarray):
    """Per document the number of chosen features in each sentence with words, and the features."""

    class Known(dict):
        def __missing__(self, word: bytes) -> list[int]:
            self[word] = own = [i for i in buckets(word) if chosen[i]]
            return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            sizes, features = [], []
            for text in batch.column("text").to_pylist():
                own = [[i for w in s for i in known[w]] for s in sentences(text or b"") if s]
                sizes.append(np.array([len(s) for s in own], np.int32).tobytes())
                features.append(np.array([i for s in own for i in s], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sizes, pa.binary()), pa.array(features, pa.binary())], ["toxic", "sizes", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs``, from a hash sample of about ``sample`` labels."""
    labels = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = labels.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labels.where(draw < min(1.0, sample / max(n, 1)))  # about `sample` rows: the bound of what is broadcast
    texts = materialize(docs.select("doc_id", utf8()).join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxicity-sample")
    seen = map_pieces(texts, _occurrences, "feature int, n long, hit long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    counts = seen.where((F.col("n") >= MIN_DOCS) | (F.col("feature") < 0)).toArrow()  # a row for each bucket at most
    feature, n, hit = (counts[x].to_numpy() for x in ("feature", "n", "hit"))
    usable = np.zeros(DIMS, bool)
    if (all_docs := feature < 0).any():
        usable[feature[~all_docs & (likelihood_ratio(hit, n, hit[all_docs][0], n[all_docs][0]) >= MIN_RATIO)]] = True
    rows = map_pieces(texts, _bags(usable), "toxic int, sizes binary, features binary").toArrow()
    order = sorted(zip(rows["sizes"].to_pylist(), rows["features"].to_pylist(), rows["toxic"].to_pylist(), strict=True))
    bags = [np.split(np.frombuffer(w, np.int32), np.cumsum(np.frombuffer(s, np.int32))[:-1]) if s else [] for s, w, _ in order]
    return train(bags, np.array([y for *_, y in order]))


def locate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and other columns of ``docs`` but text; score, and the offending sentences with their byte spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ("text", "score", "n_sentences", "offending")
    kept = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in own], utf8())
    rest = [f for f in kept.schema if f.name != "text"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = _Lookup(model.weights)
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or b""
                folded = text.translate(_FOLD).split(b"\n")
                words = [s.split() for s in folded]
                p = model.sentence_scores(words, lookup)
                scores.append(noisy_or(p))
                counts.append(len(p))
                found = []
                if len(p) and p.max() >= SENTENCE_THRESHOLD:
                    ends = np.cumsum([len(s) + 1 for s in folded]) - 1
                    full = [i for i, s in enumerate(words) if s]
                    for j in np.flatnonzero(p >= SENTENCE_THRESHOLD):
                        i = full[j]
                        start, end = int(ends[i]) - len(folded[i]), int(ends[i])
                        found.append({"start": start, "end": end, "score": float(p[j]), "sentence": text[start:end].decode("utf-8", "replace")})
                spans.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(spans, pa.list_(span))], [*(f.name for f in rest), "score", "n_sentences", "offending"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "score double, n_sentences int, offending array<struct<start: bigint, end: bigint, score: double, sentence: string>>"])
    return map_pieces(kept, run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row; learn labels only of rows that are not held out."""
    held_out = id_remainder(3) == 1
    model = fit(docs, labels.where(~held_out))
    scored = locate(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select("doc_id", "held_out", "score", "predicted", "n_sentences", "offending")
