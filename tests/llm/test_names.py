"""Extra columns with the names that operators use inside, and null files."""

import pytest

from rulesift.llm import decontamination, media, simhash, url_filter
from rulesift.llm.common import free_names


@pytest.mark.parametrize("name", ["best", "_best", "key", "passes", "n"])
def test_url_filter_keeps_extra_columns(spark, name):
    urls = spark.createDataFrame([(1, "http://a.org/x", "mine")], f"page_id int, url string, {name} string")
    got = url_filter.judge(urls, [("org", "/", "block")]).first()
    assert (got[name], got["rule"], got["verdict"]) == ("mine", "org/", "block")


@pytest.mark.parametrize("names", ["__a, __b", "a, b", "row_a, _row_a", "__row_a, id"])
def test_stages_keep_extra_columns(spark, names):
    one, other = (x.strip() for x in names.split(","))
    docs = spark.createDataFrame([(1, "ten words " * 8, "x", 5), (2, "clean text", "y", 6), (3, "clean text", "z", 7)], f"doc_id long, text string, {one} string, {other} int")
    bench = spark.createDataFrame([(1, "ten words " * 5)], "item_id long, text string")
    assert sorted(map(tuple, decontamination.keep_clean(docs, bench).collect())) == [(2, "clean text", "y", 6), (3, "clean text", "z", 7)]
    assert [tuple(r) for r in simhash.keep_first(docs).where("doc_id > 1").collect()] == [(2, "clean text", "y", 6)]


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "Best int, _best int")
    assert free_names(df, "best", "best", "x") == ["__best", "___best", "x"]


def test_null_media_and_frames_of_several_sizes(spark, monkeypatch):
    import numpy as np

    made = media.encode(spark.createDataFrame([(1, "text")], "doc_id long, text string"))
    rows = media.digests(made.unionByName(spark.createDataFrame([(2, 0, None)], made.schema))).orderBy("doc_id").collect()
    assert rows[0]["payload_bytes"] == 192 and [rows[1][k] for k, *_ in media.DIGEST] == [None] * len(media.DIGEST)
    monkeypatch.setattr(media, "read_avi", lambda data: (40_000, [np.zeros((8, 8), np.uint8), np.ones((16, 8), np.uint8)]))
    assert media.digest(b"x")["payload_bytes"] == 192
