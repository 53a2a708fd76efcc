"""Language ID, toxicity, quality, class n-grams: accuracy on held-out rows, exact counts, edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rulesift.llm import brown, language_id, quality, toxicity

WORDS = {"en": "the of and with house water light tree stone".split(), "de": "der die und mit haus wasser licht baum stein".split(), "fr": "le la et avec maison eau lumière arbre pierre".split()}


def texts(n=240, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 60))), lang, "x", i))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, score long"  # an extra column with a clashing name
ODD = [(900, None, None, "x", 1), (901, "", "en", "x", 1), (902, "123 ...", None, "x", 1), (903, "the " * 200_000, None, "x", 1), (None, "the house and the water", None, "x", 1), (5, "the house", None, "x", 1), (5, "the house", None, "x", 1)]


def test_language_id(spark):
    rows = texts() + ODD
    got = language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in texts()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 5]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    for i in (900, 901, 902):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)


def test_language_id_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "the", None, "x", 1)], SCHEMA)
    assert language_id.identify(df).first()["lang_pred"] == "und" and language_id.identify(df.limit(0)).count() == 0


def test_keep_accepted_keeps_columns_and_clean_rows(spark):
    df = spark.createDataFrame(texts() + ODD, SCHEMA)
    kept = language_id.keep_accepted(df)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and not {900, 901, 902} & set(ids) and set(range(240)) <= set(ids)


def test_toxicity(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(600):
        bad = i % 4 == 0
        lines = [" ".join(rng.choice(WORDS["en"]) for _ in range(8)) for _ in range(6)]
        if bad:
            lines[rng.randrange(6)] += " " + rng.choice(["vile", "rotten", "foulmouth", "foulplay"])
        rows.append((i, ". ".join(lines) + ".", "en"))
        labels.append((i, int(bad)))
    rows += [(1000, None, None), (1001, "", None), (1002, "VILE rotten!", None), (None, "the", None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (1001, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, marks).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == dict(labels)[i] for i in held) / len(held) > 0.97
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[1002]["predicted"] == 1
    spans = [(s["start"], s["end"], s["sentence"]) for s in got[0]["offending"]]
    assert len(spans) == 1 and rows[0][1][spans[0][0] : spans[0][1]] == spans[0][2]
    flat = toxicity.judge(docs, marks.limit(0)).collect()
    assert len(flat) == len(rows) and all(r["predicted"] == 0 for r in flat)
    assert toxicity.judge(docs.limit(0), marks).count() == 0


def test_noisy_or_learns_the_sentence():
    bags = [[np.array([1, 2]), np.array([3])] if y else [np.array([1]), np.array([2])] for y in (0, 1) * 40]
    m = toxicity.train(bags, np.array([0, 1] * 40))
    assert m.weights[3] > 2 and m.weights[1] < 1 and math.isclose(toxicity.noisy_or(np.array([0.5, 0.5])), 0.75)


def test_quality(spark):
    rng, rows, labels = random.Random(3), [], []
    for i in range(600):
        good = i % 3 > 0
        words = [rng.choice(WORDS["de"]) for _ in range(rng.randint(5, 80))]
        rows.append((i, (" ".join(words) + ".") if good else " ".join(w.upper() + "!!" for w in words), "x"))
        labels.append((i, int(good)))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "x" * 300_000, "x"), (None, "das haus", "x")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, predicted string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, marks).collect()}
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == dict(labels)[i] for i in held) / len(held) > 0.97
    assert got[1000]["score"] == got[1001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(abs(r["score"] - quality.THRESHOLD) < 1e-9 for r in quality.judge(docs, marks.limit(0)).collect())
    assert quality.judge(docs.limit(0), marks).count() == 0


def test_pairs_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    good = (x[:, 3] + 0.2 * rng.normal(size=400) > 0).astype(int)
    m = quality.train(x, good)
    s = m.score(x)
    assert ((s >= quality.THRESHOLD) == good).mean() > 0.9


def base(rows):
    tok = lambda t: (t or "").encode().lower().split()
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(w for t in train for w in tok(t))
    n, v = sum(c.values()) + len(train), len(c) + (1 if train else 0)
    log = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    return n, {i: (len(tok(t)) + 1, sum(c[w] > 0 for w in tok(t)) + (len(train) > 0), sum(log(c[w]) for w in tok(t)) + log(len(train))) for i, t in rows}


@pytest.mark.parametrize("held", [brown.HELD, 5])
def test_brown(spark, monkeypatch, held):
    monkeypatch.setattr(brown, "HELD", held)  # with few words held the join has to bring the rest
    rows = [(r[0], r[1]) for r in texts(300)] + [(900, None), (901, ""), (902, "NEVER seen Never\x0bseen"), (903, "the of the"), (904, "the " * 50_000)]
    got = brown.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n, want = base(rows)
    assert len(got) == len(rows)
    for r in got:
        size, known, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n) and math.isclose(r["base_score"], score, rel_tol=1e-9)
        assert r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / size), rel_tol=1e-9)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # classes tell the languages apart


def test_brown_words_of_one_ending_have_their_own_classes(spark, monkeypatch):
    monkeypatch.setattr(brown, "HELD", 6)  # frames and the words alpha and beta are frequent, all others have to be placed
    ids = {out: [i for i in range(1000) if (zlib.crc32(str(i).encode()) % 10 == 0) == out] for out in (True, False)}
    lines = [f"left left {w} right " * 4 for k in range(90) for w in ("alpha", "alpha", f"x{k % 15}same")] + [f"upper {w} lower lower " * 4 for k in range(90) for w in ("beta", "beta", f"y{k % 15}same")]
    train = list(zip(ids[False], lines, strict=False))
    rows = [*train, (ids[True][0], "left left x3same right"), (ids[True][1], "left left y3same right")]
    got = {r["doc_id"]: r for r in brown.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fits, odd = got[ids[True][0]], got[ids[True][1]]
    assert fits["base_score"] == odd["base_score"] and fits["score"] > odd["score"] + 0.5
    words = brown.learn(spark.createDataFrame(train, "doc_id long, text string"))
    of = {r["word"].decode(): r["class"] for r in words.table.collect()}
    assert len(of) == words.vocabulary - 1 == 36 and {of[f"x{k}same"] for k in range(15)} == {of["alpha"]} != {of["beta"]} == {of[f"y{k}same"] for k in range(15)}
    assert brown.class_count(100) == 48 and brown.class_count(1_000_000) == 100


def test_best_classes_follow_the_likelihood():
    rng = np.random.default_rng(4)
    c, k = rng.integers(5, 60, (6, 6)).astype(float), 6
    slot, n, group = np.array([0, 3, 7, 9, 2, 8]), np.array([2, 1, 2, 1, 1, 1]), np.array([0, 0, 0, 0, 1, 1])
    own, phi = np.array([1, 4]), lambda x: (x * np.log(np.maximum(x, 1))).sum()
    for s, m, g in zip(slot, n, group, strict=True):
        c[(s, own[g]) if s < k else (own[g], s - k)] += m
    total, best = brown.best_classes(group, slot, n, own, c)
    for g in range(2):
        gain = []
        for to in range(k):
            d = c.copy()
            for s, m in zip(slot[group == g], n[group == g], strict=True):
                d[(s, own[g]) if s < k else (own[g], s - k)] -= m
                d[(s, to) if s < k else (to, s - k)] += m
            left, right = c.sum(axis=1), c.sum(axis=0)
            for side in (left, right):
                side[own[g]] -= total[g]
                side[to] += total[g]
            gain.append(phi(d) - phi(left) - phi(right))
        assert gain[best[g]] >= max(gain) - 1e-6
    assert total.tolist() == [3, 1]


def test_brown_without_training_rows(spark):
    df = spark.createDataFrame([(0, "a b")], "doc_id long, text string")
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    r = brown.judge(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and brown.judge(df.limit(0)).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    n = np.zeros((40, 40))
    for _ in range(4000):
        a = rng.integers(40)
        n[a, (a // 10 * 10 + 10 + rng.integers(10)) % 40] += 1

    def likelihood(of):
        m = np.eye(4)[of]
        c = m.T @ n @ m
        phi = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return phi(c) - phi(c.sum(axis=0)) - phi(c.sum(axis=1))

    of = brown.exchange(n, 4, 20)
    assert likelihood(of) > likelihood(np.arange(40) % 4)
    for u in range(40):  # no single exchange would raise it further
        for k in range(4):
            assert likelihood(np.where(np.arange(40) == u, k, of)) <= likelihood(of) + 1e-6
