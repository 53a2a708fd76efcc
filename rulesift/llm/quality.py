"""Quality by Bradley-Terry pairwise ranking.

A document has a latent score, a linear function of surface features and their squares. The weights are learned from
preference pairs (a document labelled 1 beats one labelled 0) by logistic loss on feature differences. Scores are then
cut at the quantile that leaves the labelled share of bad documents below; the reported score is a logistic function
of the distance to that cut that is ``THRESHOLD`` right at it.

Cases: a null text counts as empty; empty texts have features of their own and get a score. Without labels, or with one
class only, every weight is 0 and the score is ``THRESHOLD``. Null labels are not learned from. Ties and repeated rows
get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import id_remainder, map_pieces, utf8

#: The fit's bounds: labelled documents (expected number of a hash sample), and pairs made of them.
SAMPLE, PAIRS = 12000, 40000
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "symbols", "stops", "commas", "bangs", "bars", "non_ascii", "blank",
    "distinct_words", "repeated_neighbours", "distinct_lines", "log_line_length", "symbol_endings", "top_byte", "entropy", "upper_words",
)

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"?-()" for b in range(256)])
_ENDINGS = frozenset(b for b in range(33, 127) if _SYMBOL[b])


def features(text: bytes) -> np.ndarray:
    """The document's features, all finite, most of them shares from 0 to 1."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(len(text), 1)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x]
    share = counts[counts > 0] / size
    letters = max(counts[_UPPER].sum() + counts[_LOWER].sum(), 1)
    return np.array([
        np.log1p(len(words)), min(sum(map(len, words)) / n, 40) / 10, sum(len(w) > 20 for w in words) / n, counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / size, counts[_SYMBOL].sum() / size, counts[46] / n, counts[44] / n, counts[33] / n, counts[124] / n,
        counts[128:].sum() / size, (counts[32] + counts[10] + counts[9]) / size, len(set(words)) / n,
        sum(map(bytes.__eq__, words, islice(words, 1, None))) / n, len(set(lines)) / max(len(lines), 1), np.log1p(size / max(len(lines), 1)),
        sum(w[-1] in _ENDINGS for w in words) / n, counts.max() / size, float(-(share * np.log(share)).sum()) if len(share) else 0.0, sum(map(bytes.isupper, words)) / n,
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return (_expand(x, self.mean, self.scale) * self.weights).sum(axis=1)  # row by row: equal texts get equal scores in any company

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.latent(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, z * z])


def train(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 3, ridge: float = 1e-3) -> Model:
    """Newton steps on the mean logistic loss of preference pairs."""
    width = len(FEATURES)
    if not len(x) or good.min() == good.max():
        return Model(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = _expand(x, mean, scale)
    rng = np.random.default_rng(seed)
    winners, losers = rng.choice(np.flatnonzero(good == 1), pairs), rng.choice(np.flatnonzero(good == 0), pairs)
    d = z[winners] - z[losers]
    w = np.zeros(2 * width)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (p - 1) / pairs + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(2 * width)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, float(np.quantile(z @ w, (good == 0).mean())))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t or b"").tolist() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """Learn from ``labels`` (doc_id, quality) and the texts of ``docs``, from a hash sample of about ``sample`` labels."""
    labels = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = labels.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labels.where(draw < min(1.0, sample / max(n, 1)))  # about `sample` rows: the bound of what is broadcast
    rows = map_pieces(docs.select("doc_id", utf8()).join(F.broadcast(chosen), "doc_id").select("quality", "text"), _features, "quality int, x array<double>").toArrow()
    order = sorted(zip(rows["x"].to_pylist(), rows["quality"].to_pylist(), strict=True))
    return train(np.array([x for x, _ in order]).reshape(-1, len(FEATURES)), np.array([y for _, y in order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but text; latent, score, and the features by name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = ("text", "latent", "score")
    kept = docs.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in own], utf8())
    rest = [f for f in kept.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or b"") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(shared.value.latent(x)), pa.array(shared.value.score(x))], [*(f.name for f in rest), "latent", "score"])

    return map_pieces(kept, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "latent double, score double"]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row; learn labels only of rows that are not held out."""
    held_out = id_remainder(4) == 2
    model = fit(docs, labels.where(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select("doc_id", "held_out", "score", "predicted", "latent")
