"""Searches by the index against single searches: all scores and ranks, and that few passages are scored."""

import random

from pyspark.sql import functions as F

from rulesift.operators import search

WORDS = ["the", "of", "a", "협력", "학습", "협력학습", "record", "records", "rec", "ord", "zeta", "x1", "é", "theory", "them"]


def corpus(spark, n=220, headings=True):
    rng = random.Random(6)
    weights = [9, 8, 7] + [2] * (len(WORDS) - 3)
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 25)))
        if i % 9 == 0:
            text += " 협 력 학습! The\nrecord"
        if i % 50 == 7:
            text = text.replace("협력 ", "협력\n") + " theoryof them zeta"
        rows.append((i, text, rng.choice([10, 80, 100]), rng.choices(WORDS, k=2) if headings else []))
    rows += [(n, "", 80, []), (n + 1, "?! --", 80, []), (n + 2, rows[3][1], 80, rows[3][3])]
    df = spark.createDataFrame(rows, "id int, searchText string, authority int, headingPath array<string>").withColumn("text", F.col("searchText"))
    return search.prepare(df if headings else df.drop("headingPath"))


QUERIES = ["협력 학습", "the record", "the", "of", "zeta", "rec ord", "the of a", "THE  Theory", "?!", "nowhere", "x1 é", "협력학습", "theory of them", "a", "é"]


def single(ready, query, limit):
    ranked = ready.withColumn("locator", F.lit(None).cast("string")).drop("locator")
    return [(r["id"], round(r["score"], 9)) for r in search.search(ranked, query, limit).collect()]


def test_every_query_as_by_itself(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "SEEDS", 1)
    scored = []
    features = search._features
    monkeypatch.setattr(search, "_features", lambda rows, q, t: (scored.append(rows), features(rows, q, t))[1])
    for headings in (True, False):
        ready = corpus(spark, headings=headings).cache()
        index = search.build_index(ready)
        queries = spark.createDataFrame(list(enumerate(QUERIES)) + [(100, ""), (101, " "), (1, "the record")], "query_id int, query string")
        del scored[:]
        got = search.search_many(ready, queries, 4, index=index)
        pairs = sum(df.count() for df in scored)
        have = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got.collect())
        del scored[:]
        want = sorted((i, k, d, s) for i, q in enumerate(QUERIES) for k, (d, s) in enumerate(single(ready, q, 4), 1))
        assert have == want and len({x[0] for x in have}) == len(QUERIES) - 1
        matches = sum(df.count() for df in scored)
        assert pairs > 100 and (headings or pairs < 0.6 * sum(ready.where(F.col("__s").contains(t)).count() for q in QUERIES for t in search.query_tokens(search.fold_query(q))))
        assert matches > 0
        ready.unpersist()


def test_words_are_counted_where_the_passage_is(spark):
    import re
    from collections import Counter

    index = search.build_index(corpus(spark))
    texts = {r["__no"]: (r["__s"], r["__len"]) for r in index.passages.collect()}
    want = {(w, no, n, size) for no, (s, size) in texts.items() for w, n in Counter(re.findall(r"[^\W_]+", s)).items()}
    rows = index.postings.collect()
    assert {(r["word"], e["no"], e["n"], e["len"]) for r in rows for e in r["entries"]} == want and len(want) > 500
    assert all(r["df"] == len(r["entries"]) and r["most"] == max(e["n"] for e in r["entries"]) and r["shortest"] == min(e["len"] for e in r["entries"]) for r in rows)
    assert {r["word"]: r["df"] for r in index.vocabulary.collect()} == Counter(w for w, *_ in want)


def test_empty_sets(spark):
    ready = corpus(spark, 5)
    queries = spark.createDataFrame([(1, "the")], "query_id int, query string")
    assert search.search_many(ready, queries.limit(0)).collect() == []
    assert search.search_many(ready.limit(0), queries).collect() == []
