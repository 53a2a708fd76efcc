"""Phrase mining against brute force: every shard, bucket and hot-prefix size gives the same rows."""

import random
import re
from collections import Counter

import pytest

from rulesift.llm import phrases
from rulesift.llm.queries import op11_phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, first=2000):
    """lang, rank, phrase, a, l, r, n, score by the contract's words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= support}
    out = {}
    for (lang, p), a in candidates.items():
        if any(q != p and x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:first], 1))


def corpus(seed):
    """Zipf-like words, a line that a third of the texts have, one word over and over, odd rows."""
    rng = random.Random(seed)
    words = ["of", "The", "ÉTÉ", "x y", "ab", "\x00", "-", "漢字"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(700):
        w = [rng.choice(words) if rng.random() < 0.1 else rng.choices(words, weights)[0] for _ in range(rng.randint(0, 70))]
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", " "]) for x in w)
        if i % 3 == 0:
            text += "\nAll rights of the w1 w2 reserved!"
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), (None, ""), ("", "the of the of the of"), ("fr", "a " * 3000), ("en", "a b c d e f g " * 400), ("en", "?!.")] + [rows[5]] * 9
    return rows


def mined(spark, rows, support, parts=3, **sizes):
    df = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "lang string, text string, word string, n int, shard int").repartition(parts)
    return sorted(map(tuple, phrases.collocations(df, support=support, **sizes).collect()))


@pytest.mark.parametrize("sizes", [{"most": 37, "bucket": 300, "hot": 11}, {"most": 3000, "bucket": 2000, "hot": 50}])
def test_against_brute_force(spark, sizes):
    rows = corpus(len(sizes))
    want = brute(rows, 8)
    assert len(want) > 90 and {len(r[2].split(" ")) for r in want} == {2, 3, 4, 5}
    assert mined(spark, rows, 8, **sizes) == want


def test_only_the_first_are_returned(spark):
    rows = corpus(9)
    assert mined(spark, rows, 8, first=7) == brute(rows, 8, 7)


def test_products_beyond_64_bits():
    """The score's arithmetic, in Spark's decimals."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    a, n, l_, r = 9 * 10**15, 8 * 10**16, 9 * 10**15 + 1, 9 * 10**15 + 7
    one = spark.createDataFrame([(a, n, l_, r)], "a long, n long, l long, r long")
    assert one.select(phrases.score()).first()[0] == 1000 * a * n // (l_ * r)


def test_nothing_frequent(spark, tmp_path):
    assert mined(spark, [("en", "a b c d"), ("en", None)], 2) == []
    assert mined(spark, [], 2) == []
    spark.createDataFrame([("en", "x y. z")] * 120, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_phrases(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert list(map(tuple, got.collect())) == [("en", 1, "x y", 120, 120, 120, 360, 3000)]


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    text = b" ab\ncd  " + b"x" * 120 + b" y z" * 60
    assert b"".join(phrases._parts(text)) == text
    assert [w for p in phrases._parts(text) for w in p.split()] == text.split()
