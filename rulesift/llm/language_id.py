"""Language ID by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character 3-grams (bytes of the lower-cased text; anything but
letters is one blank). Every language has several centroids, found by spherical k-means over its sample. A text takes
the language of the centroid with the highest cosine. It is rejected when that cosine is under a threshold that
depends on the number of its n-grams, as short texts are far from everything.

Cases: a null text, or one without a letter, gives ``und`` with score 0, rejected. With no labelled row at all every
text gives ``und``. Equal texts get equal results; ties go to the language that sorts first. Very long texts are
counted in slices. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import id_remainder, map_pieces, utf8

#: Hashed n-gram space.
DIMS = 1 << 14
#: Centroids of a language.
CENTROIDS = 4
#: The fit's bounds: languages (the most frequent ones), labelled texts of one language, and of all together (expected numbers of a hash sample).
LANGUAGES, SAMPLE_PER_LANG, SAMPLE_ALL = 300, 300, 6000
#: A text is rejected under this share of the lowest hundredth of its size class's cosines.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.01
#: Bytes counted at once.
SLICE = 1 << 20

UND = "und"

#: ASCII letters stay, all other ASCII is blank, bytes of longer characters stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed 3-grams of the folded text with one blank at either end."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace")
    counts = np.zeros(DIMS, dtype=np.int64)
    for start in range(0, max(len(raw) - 2, 1), SLICE):
        b = _FOLD[np.frombuffer(raw[start : start + SLICE + 2], dtype=np.uint8)]
        if len(b) > 1:
            blank = b == 32
            b = b[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
        if len(b) < 3:
            continue
        b = b.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        counts += np.bincount(((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), minlength=DIMS)
    return counts


def _unit(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf[index]
    n = np.sqrt(v @ v)
    return (v / n if n else v).astype(np.float32)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # DIMS x centroids
    idf: np.ndarray
    floor: np.ndarray  # lowest accepted cosine by floor(log2(n-grams))

    def nearest(self, counts: np.ndarray) -> tuple[str, float, bool]:
        index = np.flatnonzero(counts)
        if not len(index) or not self.langs:
            return UND, 0.0, True
        cosines = _unit(index, counts[index], self.idf) @ self.centroids[index]
        best = int(np.argmax(cosines))
        size = min(int(np.log2(counts.sum())), len(self.floor) - 1)
        score = float(min(max(cosines[best], 0.0), 1.0))
        return self.langs[best], score, score < self.floor[size]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIMS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            total += ngram_counts(text.decode("utf-8", "replace")) > 0
            docs += 1
    index = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1), pa.int32()), pa.array(np.append(total[index], docs), pa.int64())], ["gram", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        index, counts = [], []
        for text in batch.column("text").to_pylist():
            c = ngram_counts(text.decode("utf-8", "replace"))
            i = np.flatnonzero(c)
            index.append(i.astype(np.uint16).tobytes())
            counts.append(c[i].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(index, pa.binary()), pa.array(counts, pa.binary())], ["lang", "index", "counts"])


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means with farthest-point seeds."""
    seeds = [int(rng.integers(len(x)))]
    nearest = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[seeds[-1]])
    centers = x[seeds].copy()
    for _ in range(12):
        own = np.argmax(x @ centers.T, axis=1)
        for j in range(len(centers)):
            if (own == j).any():
                mean = x[own == j].sum(axis=0)
                centers[j] = mean / (np.linalg.norm(mean) or 1)
    return centers


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, sample_all: int = SAMPLE_ALL, seed: int = 7) -> Model:
    """Learn from every row of ``docs`` with a lang and a text.

    The ``LANGUAGES`` most frequent values of lang (those that sort first on ties) get centroids, at least 20 texts each
    if there are so many. Document frequencies come from all rows. The centroids and thresholds come from a hash sample of at most about
    ``sample_per_lang`` texts a language and ``sample_all`` in all (expected numbers).
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", utf8())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(DIMS), np.zeros(1))
    frequencies = map_pieces(labelled.select("text"), _document_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(frequencies["gram"].to_pylist(), frequencies["n"].to_pylist(), strict=True))
    idf = np.array([np.log((1 + n[-1]) / (1 + n.get(i, 0))) + 1 for i in range(DIMS)])

    each = max(20, min(sample_per_lang, sample_all // len(sizes)))
    rate = F.create_map(*[F.lit(x) for lang, m in sizes.items() for x in (lang, min(1.0, each / m))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = map_pieces(labelled.where(draw < F.element_at(rate, F.col("lang"))).select("lang", "text"), _vectors, "lang string, index binary, counts binary").toArrow().to_pylist()

    rng = np.random.default_rng(seed)
    by_lang: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["index"], r["counts"])):
        index = np.frombuffer(r["index"], np.uint16).astype(np.int64)
        if len(index):
            by_lang.setdefault(r["lang"], []).append((index, np.frombuffer(r["counts"], np.uint32).astype(np.int64)))
    langs, centers = [], []
    for lang, rows in sorted(by_lang.items()):
        x = np.zeros((len(rows), DIMS), np.float32)
        for i, (index, counts) in enumerate(rows):
            x[i, index] = _unit(index, counts, idf)
        found = _cluster(x, CENTROIDS, rng)
        langs += [lang] * len(found)
        centers.append(found)
    model = Model(langs, np.ascontiguousarray(np.vstack(centers).T) if centers else np.zeros((DIMS, 0), np.float32), idf, np.zeros(24))
    model.floor = _floors(model, [r for rows in by_lang.values() for r in rows], rng)
    return model


def _floors(model: Model, rows: list, rng: np.random.Generator) -> np.ndarray:
    """Rejection thresholds: the sample's texts are thinned to each size class and their cosines' low quantile is taken."""
    floors, known = np.zeros(24), 0.0
    for size in range(24):
        got = []
        for index, counts in rows:
            if counts.sum() >= 2**size:
                thin = rng.multivariate_hypergeometric(counts, 2**size, method="marginals")
                keep = thin > 0
                got.append(float((_unit(index[keep], thin[keep], model.idf) @ model.centroids[index[keep]]).max()))
        if len(got) >= 20:
            known = REJECT_SHARE * float(np.quantile(got, REJECT_QUANTILE))
        floors[size] = known
    return floors


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine of the nearest centroid), rejected: one row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for raw in batch.column("text").to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                out.append(own.nearest(ngram_counts(text)) if has_letter(text) else (UND, 0.0, True))
            lang, score, rejected = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*(c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "text"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*(x for x in batch.schema.names if x != "text"), "lang_pred", "score", "rejected"])

    rest = [x for x in docs.columns if x.lower() not in ("text", "lang_pred", "score", "rejected")]
    kept = docs.select(*[F.col(f"`{x}`") for x in rest], utf8())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"), "lang_pred string, score double, rejected boolean"])
    return map_pieces(kept, label, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Predict every row; learn from the labelled rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    held_out = id_remainder(4) == 2
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rows whose language is recognised, with their columns as they were.

    The decision for a text is made where the text is read: no join, so repeated ids do no harm.
    """
    model = fit(docs.where(id_remainder(4) != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = []
            for raw in batch.column("text").to_pylist():
                text = raw or ""
                keep.append(has_letter(text) and not own.nearest(ngram_counts(text))[2])
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_pieces(docs, accept, docs.schema).select(*[f"`{x}`" for x in names])
