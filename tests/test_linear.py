"""Forms that must stay linear in a text: prefix sums and distinct findings, against plain Python, and on long rows."""

import random
import time

from pyspark.sql import functions as F

from rulesift.functions import text as tx
from rulesift.functions.text import cumulative
from rulesift.operators import findings
from rulesift.plans.rulepack import latin_pack


def test_prefix_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 63, 64, 65, 1000)] + [None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select("i", cumulative(F.col("x")).alias("y")).collect()
    assert {r["i"]: r["y"] for r in got} == {i: None if x is None else [sum(x[:k]) for k in range(len(x))] for i, x in enumerate(lists)}


def test_distinct_findings(spark):
    rng = random.Random(2)
    rows = [[(rng.choice("ABC"), rng.choice([None, 1, 2, 3]), rng.choice([None, 4, 5]), n) for n in range(rng.choice([0, 1, 5, 60]))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, f array<struct<ruleId:string,start:int,end:int,n:int>>")
    for r in df.select("i", findings.distinct_findings(F.col("f")).alias("d")).collect():
        first = {}
        for x in rows[r["i"]]:
            first.setdefault(x[:3], x)
        assert [tuple(x) for x in r["d"]] == list(first.values())


def test_a_hundred_thousand_findings_in_one_text(spark):
    text = "### a@b.co licence " * 34_000
    df = spark.createDataFrame([("en", text, "official")], "field string, text string, profile string")
    start = time.time()
    row = findings.validate(df, latin_pack()).select(F.size("findings").alias("n"), "contentStatus", F.size(F.filter("findings", lambda f: f["ruleId"] == findings.CONFLICT)).alias("merged")).first()
    assert row["n"] > 34_000 and row["merged"] == 1 and time.time() - start < 60


def test_batches_to_python_are_bounded(spark):
    """10,000 rows of any length used to be one batch, and Python held all their texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        df = spark.range(1).select(tx.normalize_name(F.lit("é")).alias("x"))
        assert int(spark.conf.get(name).rstrip("bB")) == tx.BATCH_BYTES and df.first()["x"] == "é"
        spark.conf.set(name, "1000b")
        tx.normalize_name(F.lit("é"))
        assert spark.conf.get(name) == "1000b"
    finally:
        spark.conf.set(name, before)


def test_texts_are_folded_as_by_the_patterns(spark):
    """The patterns go to texts with one of their signs alone, and the ends are cut without one."""
    rng = random.Random(1)
    some, every = "aB \n\r\t", "aB" + tx.BLANKS + "\u180e\u200b\x1c\x1fé😀İ"
    rows = [(i, "".join(rng.choice(some if i % 2 else every) for _ in range(rng.randint(0, 14)))) for i in range(3000)] + [(9999, None)]
    t = F.col("t")
    ends = lambda x: F.regexp_replace(x, rf"(?U)^{tx.SPACE}+|{tx.SPACE}+$", "")
    blanks = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[\t ]+", " ")
    df = spark.createDataFrame(rows, "i int, t string")
    assert df.where(~tx.trim(t).eqNullSafe(ends(t)) | ~tx.fold_search(t).eqNullSafe(ends(F.lower(F.regexp_replace(blanks, " *\n *", "\n"))))).count() == 0
