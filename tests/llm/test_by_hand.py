"""The trained operators, step by step, against the same worked out by hand; SQL; columns with the names of results."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulesift.llm import brown, language_id, media, quality, queries, toxicity
from tests.llm.test_models import SCHEMA, WORDS, texts


def grams(text):
    """Counts of the 3-grams of the folded text, by their bucket."""
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode())
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    code = [(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 & 0xFFFFFFFF for i in range(len(raw) - 2)]
    return Counter(c >> 18 for c in code)


def test_language_is_the_nearest_centroids(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit(df)
    n = Counter(g for r in rows for g in grams(r[1]))
    docs = Counter(g for r in rows for g in set(grams(r[1])))
    assert sum(n.values()) and all(math.isclose(model.idf[g], math.log((1 + len(rows)) / (1 + k)) + 1) for g, k in docs.items())
    for r in rows[:30]:
        v = {g: math.log1p(k) * model.idf[g] for g, k in grams(r[1]).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x / size * float(model.centroids[g, j]) for g, x in v.items()) for j in range(len(model.langs))]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        lang, score, _ = model.nearest(language_id.ngram_counts(r[1]))
        assert lang == model.langs[best] == r[2] and math.isclose(score, cosines[best], abs_tol=1e-5)
    assert all(math.isclose(float(c @ c), 1, abs_tol=1e-4) for c in model.centroids.T) and Counter(model.langs) == dict.fromkeys("en de fr".split(), language_id.CENTROIDS)


def test_texts_far_from_every_centroid_are_rejected(spark):
    odd = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "いろはにほへとちりぬるを" * 8, "xqzk vwxj qqzx kkvj zxqv " * 12]
    rows = texts() + [(2000 + i, t, None, "x", 1) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[2000 + i]["rejected"] for i in range(len(odd))) and not any(got[i]["rejected"] for i in range(240))
    kept = {r["doc_id"] for r in language_id.keep_accepted(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(240))


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [r for r in texts() if r[2] != "fr"] + texts()[:3]
    assert set(language_id.fit(spark.createDataFrame(rows, SCHEMA)).langs) == {"en", "de"}


def test_toxicity_is_the_noisy_or_of_its_sentences(spark):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=toxicity.DIMS).astype(np.float32)
    model = toxicity.Model(weights, -1.5)
    rows = [(1, "One vile line. And another! A third?\nlast"), (2, "..."), (3, None), (4, "Single words only")]
    got = {r["doc_id"]: r for r in toxicity.locate(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        p, words = [], [[w for w in "".join(c.lower() if c.isalnum() else " " for c in s).split()] for s in (t or "").replace("!", ".").replace("?", ".").replace("\n", ".").split(".")]
        for own in words:
            if own:
                z = sum(float(weights[b]) for w in own for b in toxicity.buckets(w.encode())) - 1.5
                p.append(1 / (1 + math.exp(-z)))
        whole = 1 - math.prod(1 - x for x in p)
        assert math.isclose(got[i]["score"], whole, abs_tol=1e-6) and got[i]["n_sentences"] == len(p)
        assert [round(s["score"], 5) for s in got[i]["offending"]] == [round(x, 5) for x in p if x >= toxicity.SENTENCE_THRESHOLD]


def test_toxicity_training_lowers_the_likelihoods_loss():
    rng = random.Random(4)
    bags, labels = [], []
    for i in range(200):
        y = i % 2
        bags.append([np.array([rng.randrange(20) for _ in range(5)] + ([30 + rng.randrange(3)] if y and k == 1 else [])) for k in range(3)])
        labels.append(y)

    def loss(w, bias):
        out = 0.0
        for bag, y in zip(bags, labels, strict=True):
            whole = 1 - math.prod(1 - 1 / (1 + math.exp(-(sum(float(w[i]) for i in s) + bias))) for s in bag)
            out -= math.log(max(whole if y else 1 - whole, 1e-12))
        return out / len(bags)

    m = toxicity.train(bags, np.array(labels))
    assert loss(m.weights, m.bias) < 0.3 * loss(np.zeros(toxicity.DIMS), math.log(0.5 / 3))
    assert min(m.weights[30:33]) > 2 > max(abs(m.weights[:20]))


def test_quality_solves_the_pairwise_loss():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, len(quality.FEATURES)))
    good = (x[:, 2] - x[:, 5] + 0.7 * rng.normal(size=120) > 0.3).astype(int)
    pairs, seed, ridge = 3000, 3, 1e-3
    m = quality.train(x, good, pairs, seed, ridge)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)
    z = np.hstack([z, z * z])
    draw = np.random.default_rng(seed)
    win, lose = draw.choice(np.flatnonzero(good == 1), pairs), draw.choice(np.flatnonzero(good == 0), pairs)

    def loss(w):
        return np.mean([math.log1p(math.exp(-float(w @ (z[a] - z[b])))) for a, b in zip(win, lose, strict=True)]) + ridge / 2 * float(w @ w)

    for k in range(0, len(m.weights), 7):  # the gradient, by differences, is nought
        step = np.zeros(len(m.weights))
        step[k] = 1e-4
        assert abs(loss(m.weights + step) - loss(m.weights - step)) / 2e-4 < 1e-3
    latent = z @ m.weights
    assert np.allclose(m.latent(x), latent) and math.isclose(m.cut, np.quantile(latent, (good == 0).mean()))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-(latent - m.cut + math.log(0.7 / 0.3)))))


def test_brown_score_by_hand(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS["en" if i % 2 else "de"] + [f"rare{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id % 5 = 0 AS held_out")
    train = docs.where("NOT held_out")
    lex = brown.lexicon(train)
    numbers = brown.coded(docs, lex)
    words = brown.classes_of(numbers.where("NOT held_out"), lex)
    coded = brown.classed(numbers, words)
    got = {r["doc_id"]: r["score"] for r in brown.score(coded, words, brown.transitions(coded.where("NOT held_out"), words)).collect()}

    of = {r["word"].decode(): r["class"] for r in words.table.collect()}
    k, end = words.classes, words.end_class
    seen = [t.lower().split() for i, t in rows if i % 5]
    n = Counter(w for t in seen for w in t) | Counter({"\0": len(seen)})
    of["\0"] = end
    paths = [[end, *(of[w] for w in t), end] for t in seen]
    pair = Counter(p for path in paths for p in zip(path, path[1:], strict=False))
    into, out = Counter(), Counter()
    for (a, b), m in pair.items():
        into[b] += m
        out[a] += m
    total, kinds = Counter(), Counter()
    for w, m in n.items():
        total[of[w]] += m
        kinds[of[w]] += 1
    for i, t in rows:
        s, last = 0.0, end
        for w in [*t.lower().split(), "\0"]:
            c = of.get(w, words.unseen)
            prior = (into[c] + 1) / (sum(into.values()) + k)
            s += math.log10((pair[last, c] + brown.BIGRAM * prior) / (out[last] + brown.BIGRAM)) + math.log10((n[w] + brown.ALPHA) / (total[c] + brown.ALPHA * (kinds[c] + 1)))
            last = c
        assert math.isclose(got[i], s, rel_tol=1e-9), i


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 60)), min_size=0, max_size=12), st.integers(0, 1000))
def test_shots_by_hand(scenes, seed):
    rng = np.random.default_rng(seed)
    frames = [np.clip(rng.normal(level, 6, (4, 4)), 0, 255).astype(np.uint8) for level, n in scenes for _ in range(n)]
    if not frames:
        assert media.shots(np.zeros((0, 4, 4), np.uint8), 40_000) == []
        return
    hist = [[sum(int(x) >> 4 == b for x in f.reshape(-1)) / 16 for b in range(media.BINS)] for f in frames]
    d = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) for a, b in zip(hist, hist[1:], strict=False)]
    starts = [0]
    for i, x in enumerate(d):
        near = [d[j] for j in range(max(i - media.AROUND, 0), min(i + media.AROUND + 1, len(d))) if j != i]
        mean = sum(near) / max(len(near), 1)
        spread = math.sqrt(max(sum(y * y for y in near) / max(len(near), 1) - mean * mean, 0))
        limit = max(mean + media.DEVIATIONS * spread, media.LEAST_DISTANCE)
        if abs(x - limit) < 1e-9:
            return  # too near to the limit for sums in another order
        if x > limit:
            starts.append(i + 1)
    got = media.shots(np.stack(frames), 40_000)
    assert [c["start_ms"] // 40 for c in got] == starts and sum(c["frames"] for c in got) == len(frames) and got[-1]["end_ms"] == 40 * len(frames)


def test_media_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text " * 40, "c", "f", 5), (2, None, "d", "g", 6)], "doc_id long, text string, Clip string, feature string, n_bytes int")
    files = media.encode(df.select("doc_id", "text", "Clip", "feature"))
    found = media.clips(files.withColumnRenamed("feature", "text"))
    assert found.columns == ["doc_id", "text", "n_bytes", "clip", "start_ms", "end_ms", "frames", "mean"] and {r["text"] for r in found.collect()} == {"f", "g"}
    told = media.digests(files)
    assert told.columns == ["doc_id", "Clip", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] and all(r["feature"].startswith("frames=") for r in told.collect())
    assert media.clips(files.select("media")).count() >= 2


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = con.sql(queries.ORACLE_SQL[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert text(df.select(*columns).collect()) == text(want)
