"""Needles in texts, and the literals that patterns can't do without, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rulesift.functions.patterns import PROBES, fold, jvm, literal, problem, required
from rulesift.operators import contain, integrity, scan
from rulesift.plans.rulepack import conformance_pack, latin_pack


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most, part", [(contain.MOST, contain.PART), (3, 7)])
def test_needles_meet_the_texts_that_have_them(spark, monkeypatch, most, part):
    monkeypatch.setattr(contain, "PART", part)
    rng = random.Random(4)
    alphabet = "ab \né漢字😀협력학습."
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(200, None), (201, ""), (202, "a" * 500), (3, "ab ab")]
    needles = [(i, "".join(rng.choice(alphabet) for _ in range(1 + i % 5))) for i in range(40)] + [(50, ""), (51, None), (52, "aaaa"), (53, "nowhere at all"), (0, "ab"), (54, "ab"), (55, "협력 학습"), (56, "漢字")]
    got = contain.meet(spark.createDataFrame(texts, "id int, text string"), "text", spark.createDataFrame(needles, "n int, needle string"), most)
    assert got.columns == ["id", "text", "needle", "n"] or set(got.columns) == {"id", "text", "needle", "n"}
    want = sorted((i, n) for i, t in texts for n, x in needles if t and x and x in t)
    assert sorted((r["id"], r["n"]) for r in got.collect()) == want and len(want) > 300
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_texts_give_no_grams_but_the_needles(spark, monkeypatch):
    """Texts used to give a row for each of their distinct grams."""
    monkeypatch.setattr(contain, "PART", 7)
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abc é漢😀") for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(400, None), (401, "")]
    grams = list(dict.fromkeys(g for x in ("ab", "b", "é漢", "abc ab", "cab", "c a", "caba", "bca", "漢😀é", "aaaaaaaaaaaaaaaa") for g in contain._own_grams(x.encode())))
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    got = sorted((r["id"], r["g"]) for r in contain._having(df, "text", grams, "g").collect())
    want = sorted((i, k) for i, t in texts if t for k, (n, x) in enumerate(grams) if x.to_bytes(n, "little") in t.encode())
    assert got == want and len(want) > 300


def test_no_needles_and_no_texts(spark):
    texts = spark.createDataFrame([(1, "a")], "id int, text string")
    assert contain.meet(texts, "text", spark.createDataFrame([], "n int, needle string")).collect() == []
    assert contain.meet(texts.limit(0), "text", spark.createDataFrame([(1, "a")], "n int, needle string")).collect() == []


PATTERNS = {
    "licen[sc]e": ("licence", "license"), "TOEIC": ("toeic",), r"[a-z]+@[a-z.-]+\.[a-z]{2,}": ("@",), r"\d+": None, "a?b?c": ("abc", "ac", "bc", "c"), "(?:alpha|beta)[^.]{0,9}gamma": ("gamma",), "(?:alpha|beta)+x?": ("alpha", "beta"),
    "x*": None, "(foo)+bar": ("foobar", "foo") and None, "전국대회[^.!?\\n]{0,40}(?:수상|입상)": ("전국대회",), "é1": ("1",), "(?:a|\\d)": None, "^start": ("start",), "ab{2}c": ("ab",) and None, "strasse|straße": None,
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_required_literals(pattern):
    told = required(pattern, False)
    if PATTERNS[pattern] is not None:
        assert told == PATTERNS[pattern]
    if pattern in (r"\d+", "x*", "(?:a|\\d)"):
        assert told is None


def test_every_match_has_a_required_literal(spark):
    """Random expressions and texts: what the JVM's engine finds, letters of either case and look-alikes included, the literals don't leave out."""
    rng = random.Random(11)

    def expression(depth):
        kind = rng.randrange(8 if depth else 3)
        if kind < 2:
            return re.escape("".join(rng.choice("abKsi학é.") for _ in range(rng.randint(1, 3))))
        if kind == 2:
            return rng.choice(["[ab]", "[a-z]", "\\d", ".", "[^a]", "[sk]", "\\b"])
        if kind in (3, 4):
            return expression(depth - 1) + expression(depth - 1)
        if kind == 5:
            return f"(?:{expression(depth - 1)}|{expression(depth - 1)})"
        return f"(?:{expression(depth - 1)}){rng.choice(['?', '*', '+', '{2}', '{1,3}', '{0,2}'])}"

    patterns = [p for p in dict.fromkeys(expression(4) for _ in range(400)) if problem(p) is None]
    told = {p: required(p, False) for p in patterns}
    assert sum(x is not None for x in told.values()) > 60
    texts = ["".join(rng.choice("abkKsSiI학éÉ.1 Kſıİ") for _ in range(rng.randint(1, 12))) for _ in range(250)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fold(F.col("text")).alias("folded"))
    some = [p for p in patterns if told[p]][:150]
    rows = df.select(*[(F.col("text").rlike(jvm(p, False, False)) & ~F.exists(F.array(*map(F.lit, told[p])), lambda x: F.contains(F.col("folded"), x))).alias(str(i)) for i, p in enumerate(some)]).collect()
    assert [some[i] for i in range(len(some)) if any(r[str(i)] for r in rows)] == []


def test_scan_by_literals_needs_no_nested_loop(spark):
    rng = random.Random(2)
    words = ["a@b.co", "licence", "LICENSE", "###", "the the", "of of", "The THE", "10.1.2.3", "x", "TOEIC", "K-MOOC", "mooc", "항상", "전국대회 수상", None]
    for pack, fields in ((latin_pack(), ["en", "fr", None]), (conformance_pack(), [*conformance_pack().field_of])):
        rows = [(i, " ".join(w for w in rng.choices(words, k=5) if w), rng.choice(fields), rng.choice(["official", "official_plus_editorial"])) for i in range(120)] + [(500, None, fields[0], "official"), (501, "", fields[0], "official")]
        entries = spark.createDataFrame(rows, "id int, text string, field string, profile string")
        table = scan.scan_exploded(entries, pack)
        assert "NestedLoop" not in plan_of(table) and "Cartesian" not in plan_of(table)
        got = sorted((r["id"], r["ruleId"], r["text_hit"], r["start"], r["end"], r["startCp"]) for r in scan.first_of_rule(table, ["id"]).collect())
        folded = entries.where("text IS NOT NULL").select("id", F.explode(scan.scan_array(pack, F.col("text"), F.col("profile"), F.col("field"))).alias("h")).select("id", "h.*")
        assert got == sorted((r["id"], r["ruleId"], r["text"], r["start"], r["end"], r["startCp"]) for r in folded.collect()) and len(got) > 60


def test_patterns_without_literals_are_still_searched(spark):
    from dataclasses import replace

    pack = latin_pack()
    rules = [replace(r, patterns=(r"[0-9]{3}", "licen[sc]e")) if r.id == "IPV4" else r for r in pack.rules]
    entries = spark.createDataFrame([(1, "call 555 or licence 12", "en", "official"), (2, "12", "en", "official")], "id int, text string, field string, profile string")
    got = {(r["id"], r["ruleId"], r["text_hit"]) for r in scan.scan_exploded(entries, pack.with_rules(*rules)).collect()}
    assert got == {(1, "IPV4", "555"), (1, "IPV4", "licence"), (1, "LICENCE", "licence")}


def test_short_quotes_and_scripts_without_blanks(spark):
    passages = spark.createDataFrame([("그는 협력학습을 좋아한다",), ("漢字仮名交じり文",), ("one two",), ("onetwo three",)], "s string")
    quotes = spark.createDataFrame([(1, "협력"), (2, "仮名交"), (3, "e t"), (4, "two"), (5, "학습을 좋"), (6, ""), (7, "zzz"), (2, "one")], "item_id int, q string")
    found = integrity.quotes_contained(quotes, passages)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 3), (2, 3), (3, 1), (4, 2), (5, 1), (6, 0), (7, 0)]
    assert "NestedLoop" not in plan_of(found)
    assert PROBES and literal("a.b") == "a\\.b"
