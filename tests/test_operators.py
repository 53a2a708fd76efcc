"""Text functions, search, semantic checks, integrity, corpus building, streaming."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rulesift import more_queries, queries, schemas as S
from rulesift.functions import text as tx
from rulesift.operators import decide, evidence, findings, integrity, search, semantic
from rulesift.plans.rulepack import Rule, Semantic, conformance_pack
from rulesift.sources import chunk, extract, readers, sinks
from rulesift.streaming import shell


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, tx.normalize_search(F.col("t")), t="\ufeff Ａ\r\n  b\t c \u00a0") == "a\nb c"
    assert one(spark, tx.tokens(F.col("t")), t="a b a, b") == ["a", "b", "ab", "ba"]
    assert one(spark, tx.count_in(F.col("t"), F.lit("aba")), t="ababa") == 1 and one(spark, tx.count_in(F.col("t"), F.lit("")), t="x") == 0
    assert one(spark, tx.measure(F.col("t")), t="가\r\n😀").asDict() == {"charCount": 3, "byteCount": 8}
    assert one(spark, tx.utf16_length(F.col("t")), t="가😀") == 3
    assert one(spark, tx.occurrence_starts(F.col("t"), F.lit("a.")), t="a.xa.a.") == [0, 3, 5]
    assert one(spark, tx.occurrence_starts(F.col("t"), F.lit("\\E")), t="x\\E") == [1]
    assert one(spark, tx.pad_start(F.col("t"), 2), t="123") == "123"
    assert one(spark, tx.same_comparable(F.col("t"), F.lit("a b")), t=" ａ \n b")
    long = "x" * 200 + "needle" + "y" * 200
    got = one(spark, tx.snippet(F.col("t"), F.col("t"), F.lit("needle"), F.array(F.lit("needle"))), t=long)
    assert got == "…" + long[80:320] + "…"


def test_institutions_and_suppression(spark):
    assert one(spark, decide.allowed_institution(F.col("t")), t="서울 특별시 교육청")
    assert not one(spark, decide.allowed_institution(F.col("t")), t="민간연구소")


CHUNKS = [("c1", "s1", "협력 학습 안내", ["협력"]), ("c2", "s1", "협력적 과제", []), ("c3", "s2", "협력 학습 협력 학습", []), ("c4", "s2", "다른 내용", [])]


def passages(spark):
    rows = [(i, s, 80, ["elementary"], ("pdf-page", int(i[1:]), None, None, None, None, None), "l", h, t, t, None) for i, s, t, h in CHUNKS]
    return spark.createDataFrame(rows, S.CHUNKS)


def sources(spark):
    return spark.createDataFrame([(i, f"T{i}", "primary-guide" if i == "s1" else "directive-body", "pdf", 80, ["elementary"], 2026, "2026-03-01", None, "f", f"{i}.txt", f"{i}.txt", "A" * 64, None, 1) for i in ("s1", "s2")], S.SOURCES)


def test_search(spark):
    ready = search.prepare(passages(spark))
    ids = lambda **k: [r["id"] for r in search.search(ready, "협력 학습", 20, sources=sources(spark), **k).collect()]
    assert ids()[0] == "c3" and "c4" not in ids() and ids(source_ids=["s1"])[0] == "c1"
    assert ids(source_ids=[]) == [] and ids(roles=["directive-body"]) == ["c3"]
    for bad in (lambda: search.search(ready, " ", 5), lambda: search.search(ready, "x", 21), lambda: search.search(ready, "x" * 201, 5), lambda: ids(roles=["x"]), lambda: ids(source_ids=["s9"])):
        with pytest.raises(search.QueryError):
            bad()
    many = search.search_many(ready, spark.createDataFrame([(1, "협력 학습"), (2, "없는말")], "query_id int, query string"), 2).collect()
    single = [(r["id"], round(r["score"], 6)) for r in search.search(ready, "협력 학습", 2).collect()]
    assert [(r["id"], round(r["score"], 6)) for r in sorted(many, key=lambda r: r["rank"])] == single


def test_semantic(spark):
    base = conformance_pack()
    rule = Rule("SEM", "phrase", evidence=("EV-GUIDE-18-PROHIBITIONS",), patterns=("시험",), semantic=Semantic("t", (), ("고득점",), ("시험",), ("없음",)))
    soft = replace(rule, id="SOFT", outcome="review", applies_to=("behavior_opinion",))
    bare = replace(rule, id="BARE", semantic=None)
    pack = base.with_rules(rule, soft, bare)
    text = "앞 문장. 시험에서 고득점을 받음. 시험"
    cases = [
        ("SEM", "시험", 1, None, None, "prohibited"), ("SOFT", "시험", 1, None, None, "revise"), ("SEM", "시험", 2, None, None, "teacher_review"), ("SEM", "시험", None, None, "ambiguous_span", None),
        ("SEM", "시험", 3, "t", "occurrence_out_of_range", "teacher_review"), ("NONE", "시험", 1, None, "unknown_rule_id", None), ("SEM", "", None, None, "empty_span", None), ("SEM", "없다", None, None, "span_not_found", None), ("BARE", "시험", 1, None, "rule_not_semantic", None),
        ("SEM", "앞", None, None, None, "pass_no_match"),
    ]
    rows = [("b", i, f"e{i}", text, "behavior_opinion", "official", "pass_no_match", 0, "c", r, s, o, t) for i, (r, s, o, t, *_) in enumerate(cases)]
    got = semantic.verify(spark.createDataFrame(rows, S.CANDIDATES), pack).orderBy("entryOrd").collect()
    for case, r in zip(cases, got, strict=True):
        assert (r["errorCode"], r["finalRecommendation"]) == case[4:], case
    assert got[0]["context"] == " 시험에서 고득점을 받음." and got[3]["availableOccurrences"] == [1, 2]
    entries = semantic.entry_results(semantic.verify(spark.createDataFrame(rows[:3], S.CANDIDATES), pack))
    assert semantic.batch_results(entries).first()["status"] == "prohibited"


def bundle(spark):
    pack = conformance_pack()
    src = spark.createDataFrame([(e, f"T{e}", "primary-guide", "pdf", a, lv, 2026, "2026-03-01", None, "f", f"{e}.txt", f"{e}.txt", "A" * 64, None, 1) for e, a, lv in (("S1", 80, ["elementary"]), ("S2", 100, ["elementary", "middle", "high"]))], S.SOURCES)
    docs = src.select(F.col("id").alias("sourceId"), "title", "role", "format", "authority", "schoolLevels", F.col("sha256").alias("sourceSha256"), "sourceUrl", "snapshotName", F.lit(1).alias("unitCount"), F.lit(5).alias("extractedCharCount"), F.lit(True).alias("includedInChunks"))
    rows = [(f"S{1 + (e.authority == 100)}:{e.id}", f"S{1 + (e.authority == 100)}", e.authority, ["elementary"] if e.authority == 80 else ["elementary", "middle", "high"], ("pdf-page", 1, None, None, None, None, None), "l", [], e.quote, "", "", e.id) for e in pack.evidence]
    raw = spark.createDataFrame(rows, S.CHUNKS + ", e string")
    ready = raw.withColumn("__n", tx.normalize_search(F.col("text"))).withColumn("searchText", F.col("__n")).withColumn("textSha256", tx.sha256_upper(F.col("text"))).cache()
    active = ready.select(F.col("id").alias("chunkId"), F.when(F.size("schoolLevels") == 1, "elementary").otherwise("common").alias("scope"), F.lit("r").alias("reason"))
    ev = ready.select(F.col("e").alias("id"), F.col("id").alias("chunkId"), F.col("text").alias("quote"), F.col("textSha256").alias("quoteSha256"), F.lit("human").alias("checkedBy"), F.lit("2026-07-30").alias("checkedOn"))
    return integrity.Bundle(src, docs, ready.drop("e", "__n"), active, ev, pack, corpus_counts=(2, len(rows)))


def first(spark, b):
    return next(iter(integrity.violations(b)), (None,))[0]


FAULTS = {
    "corpus-count": lambda b: replace(b, corpus_counts=(1, 1)),
    "source-school-scope": lambda b: replace(b, sources=b.sources.withColumn("schoolLevels", F.array(F.lit("high")))),
    "source-document-reference": lambda b: replace(b, documents=b.documents.where("sourceId <> 'S1'"), corpus_counts=None),
    "source-document-metadata": lambda b: replace(b, documents=b.documents.withColumn("title", F.lit("x"))),
    "source-chunk-reference": lambda b: replace(b, chunks=b.chunks.withColumn("sourceId", F.lit("S9"))),
    "source-chunk-metadata": lambda b: replace(b, chunks=b.chunks.withColumn("authority", F.lit(10))),
    "chunk-text-hash": lambda b: replace(b, chunks=b.chunks.withColumn("textSha256", F.lit("0"))),
    "chunk-search-text": lambda b: replace(b, chunks=b.chunks.withColumn("searchText", F.lit("0"))),
    "document-chunk-inclusion": lambda b: replace(b, documents=b.documents.withColumn("includedInChunks", F.lit(False))),
    "active-chunk-reference": lambda b: replace(b, active=b.active.withColumn("chunkId", F.concat("chunkId", F.lit("x")))),
    "active-chunk-scope": lambda b: replace(b, active=b.active.withColumn("scope", F.lit("common"))),
    "evidence-active-reference": lambda b: replace(b, active=b.active.where("chunkId NOT LIKE 'S2%'")),
    "evidence-quote-hash": lambda b: replace(b, evidence=b.evidence.withColumn("quoteSha256", F.lit("0"))),
    "evidence-quote-containment": lambda b: replace(b, evidence=b.evidence.withColumn("quote", F.lit("zz")).withColumn("quoteSha256", tx.sha256_upper(F.lit("zz")))),
    "rule-evidence-reference": lambda b: replace(b, evidence=b.evidence.where("id <> 'EV-DIRECTIVE-4-2'")),
    "rule-conflict-reference": lambda b: replace(b, pack=b.pack.with_rules(*b.pack.rules[:-1], replace(b.pack.rules[-2], id="Z", conflicts=("Q",)))),
    "rule-conflict-symmetry": lambda b: replace(b, pack=b.pack.with_rules(*b.pack.rules, replace(b.pack.rules[8], id="Z", conflicts=("OFFICIAL-LANGUAGE-TEST",)))),
    "length-rule-field": lambda b: replace(b, pack=b.pack.with_rules(replace(b.pack.rules[0], max_bytes=61), *b.pack.rules[1:])),
    "duplicate-id": lambda b: replace(b, evidence=b.evidence.unionByName(b.evidence)),
    "rule-authority-separation": lambda b: replace(b, pack=b.pack.with_rules(replace(b.pack.rules[-1], evidence=("EV-DIRECTIVE-4-2",)), *b.pack.rules[:-1])),
    "bundle-file-set": lambda b: replace(b, manifest_files=b.sources.select(F.col("id").alias("path"), "sha256"), actual_files=b.sources.select(F.concat("id", F.lit("x")).alias("path"), "sha256")),
    "bundle-file-hash": lambda b: replace(b, manifest_files=b.sources.select(F.col("id").alias("path"), "sha256"), actual_files=b.sources.select(F.col("id").alias("path"), F.lit("0").alias("sha256"))),
    "bundle-content-hash": lambda b: replace(b, manifest_files=b.sources.select(F.col("id").alias("path"), "sha256"), actual_files=b.sources.select(F.col("id").alias("path"), "sha256"), declared_seal="0"),
}


def test_sound_bundle_and_faults(spark):
    b = bundle(spark)
    assert integrity.report(b, optional=True) == [] or [k for k, *_ in integrity.report(b)] == []
    for kind, spoil in FAULTS.items():
        assert first(spark, spoil(b)) == kind, kind
    with pytest.raises(integrity.BundleError) as e:
        integrity.require_sound(FAULTS["corpus-count"](b))
    assert str(e.value) == "Startup failed: corpus-count (corpus)"


def test_evidence(spark):
    b = bundle(spark)
    assert evidence.source_excerpt("S2:EV-DIRECTIVE-4-2", b.chunks, b.active, b.sources).first()["sourceId"] == "S2"
    with pytest.raises(evidence.UnknownChunk):
        evidence.source_excerpt("nope", b.chunks, b.active, b.sources)
    assert evidence.explain_rule(b.pack, findings.CONFLICT)["possibleOutcomes"] == ["review"]
    assert evidence.explain_rule(b.pack, "LENGTH-ADDRESS")["detectorSummary"] == "length: more than 900 bytes in address"
    got = evidence.evidence_summaries(b.pack.rules_table(spark).where("size(evidenceIds) > 0"), b.evidence, b.chunks, b.sources)
    assert got.where("ruleId = 'OFFICIAL-DIRECT-OBSERVATION'").first()["summaries"][0]["authority"] == 100


def test_readers(spark, tmp_path):
    ddl = "a string, b array<int>"
    (tmp_path / "x.jsonl").write_text('{"a":"1","b":[1]}\r\n{"a":"2"}\n')
    assert [r["a"] for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), ddl).collect()] == ["1", "2"]
    (tmp_path / "x.json").write_text('[{"a":"1"},\n {"a":"2","b":[3]}]')
    assert readers.read_json(spark, str(tmp_path / "x.json"), ddl).count() == 2
    for text, kind in (("{}\n\n{}\n", "json-lines"), ("", "json-lines"), ('{"a":\n', "json-syntax"), ('{"z":1}\n', "schema")):
        (tmp_path / "y.jsonl").write_text(text)
        with pytest.raises(integrity.BundleError) as e:
            readers.read_jsonl(spark, str(tmp_path / "y.jsonl"), ddl)
        assert e.value.kind == kind
    assert readers.contained("a\\b/../c") == "a/c"
    for bad in ("../x", "/x", "C:\\x", "a/../../b", ""):
        with pytest.raises(ValueError):
            readers.contained(bad)
    (tmp_path / "s1.txt").write_bytes(b"hello")
    import hashlib

    src = sources(spark).where("id = 's1'").withColumn("sha256", F.lit(hashlib.sha256(b"hello").hexdigest().upper()))
    assert readers.verified_sources(spark, src, str(tmp_path)).first()["sizeBytes"] == 5
    with pytest.raises(integrity.BundleError):
        readers.verified_sources(spark, sources(spark).where("id = 's1'"), str(tmp_path))
    with pytest.raises(integrity.BundleError):
        readers.read_bytes(spark, str(tmp_path / "none"))


def test_extraction(spark):
    assert one(spark, extract.printed_page(F.col("t")), t="제목\n\n본문\n 12 \n") == 12 and one(spark, extract.printed_page(F.col("t")), t="1\n2") is None
    assert one(spark, extract.page_headings(F.col("t")), t="\n 가 \n" + "나" * 121 + "\n다") == ["가"]
    items = spark.createDataFrame([([("a", False), ("b", True), ("c", False)],)], "i array<struct<str:string,hasEOL:boolean>>")
    assert items.select(extract.join_items(F.col("i"))).first()[0] == "ab\nc"
    xml = '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a ">">]><R><P><T><CHAR>가</CHAR><CHAR>&nbsp;나</CHAR></T></P><P/><P><CHAR>다</CHAR></P></R>'
    assert extract.hwpml_units(xml) == [(1, "가\u00a0나"), (3, "다")]
    tree = {"sections": [{"elements": [{"type": "paragraph", "data": {"runs": [{"text": "a"}, {"text": "b"}]}}, {"type": "table", "data": {"rows": [{"cells": [{"paragraphs": [{"text": "x"}], "elements": [{"type": "paragraph", "data": {"text": "x"}}]}, {"paragraphs": [{"text": "y"}]}]}]}}]}]}
    assert extract.hwp5_units(json.dumps(tree)) == [(1, "ab"), (2, "x\ty")]
    files = spark.createDataFrame([("s1", "hwpml", xml), ("s2", "hwp5-json", json.dumps(tree))], "sourceId string, format string, text string")
    assert extract.file_units(files).count() == 4
    statute = "\ufeff머리\n제1조(목적) 가\n제2조의3(정의) 나\n① 하나\n② 둘\n제3조 < 삭 제 >\n제22조(재검토기한) 끝\n 부 칙 <제1호, 2020. 1. 1.>\n제1조(시행일) x\n부칙 <제555호, 2026. 2. 12.>\n이 훈령은 시행한다."
    units = extract.statute_units(spark.createDataFrame([("s", statute)], "sourceId string, text string")).orderBy("unitIndex").collect()
    assert [(u["article"], u["paragraph"], u["heading"]) for u in units] == [("제1조", None, "제1조(목적)"), ("제2조의3", None, "제2조의3(정의)"), ("제3조", None, "제3조 < 삭 제 >"), ("제22조", None, "제22조(재검토기한)"), ("부칙", "제555호, 2026. 2. 12.", "부칙 <제555호, 2026. 2. 12.>")]
    assert units[3]["rawText"] == "제22조(재검토기한) 끝" and units[4]["rawText"].endswith("시행한다.")
    with pytest.raises(Exception, match="anchors"):
        extract.statute_units(spark.createDataFrame([("s", "x")], "sourceId string, text string")).collect()
    parts = extract.circled_paragraphs(spark.createDataFrame([("s", "머리\n① 하나\n② 둘")], "k string, body string")).collect()
    assert [(p["paragraph"], p["body"]) for p in parts] == [(None, "머리"), ("1", "① 하나"), ("2", "② 둘")]


def test_corpus(spark, tmp_path):
    src = spark.createDataFrame([("A", "Guide", "primary-guide", "pdf", 80, ["elementary"], 2026, "2026-03-01", None, "f", "a", "a", "0", None, 3), ("B", "Law", "directive-body", "text", 100, ["elementary"], 2026, "2026-03-01", None, "f", "b", "b", "0", None, 1), ("C", "Copy", "verification-copy", "text", 100, ["elementary"], 2026, "2026-03-01", None, "f", "c", "c", "0", None, 1)], S.SOURCES)
    units = spark.createDataFrame([("A", ("pdf-page", 7, 3, None, None, None, None), ["h"], " text\r\none "), ("B", ("article", None, None, "제4조", None, None, None), [], "제4조(x)\n① 하나\n② 둘"), ("C", ("article", None, None, "제4조", None, None, None), [], "copy")], S.UNITS)
    got = {r["id"]: r for r in chunk.chunks(units, src).collect()}
    assert sorted(got) == ["A:pdf-007", "B:article-04", "B:article-04-p01", "B:article-04-p02"]
    assert got["A:pdf-007"]["text"] == "text\none" and got["A:pdf-007"]["locatorLabel"] == "2026 초등 기재요령 인쇄 3쪽 (PDF 7쪽)" and got["B:article-04-p02"]["locatorLabel"] == "교육부훈령 제555호 제4조제2항"
    docs = chunk.documents(units, src)
    assert docs.where("includedInChunks").count() == 2
    with pytest.raises(integrity.BundleError, match="extraction-floor"):
        chunk.documents(units, src.withColumn("minimumExtractedChars", F.lit(1000)))
    with pytest.raises(integrity.BundleError, match="source-extraction-set"):
        chunk.documents(units.where("sourceId <> 'A'"), src)
    a = sinks.write_corpus(docs, chunk.chunks(units, src), str(tmp_path / "o"), "p", b"m")
    before = (tmp_path / "o" / "chunks.jsonl").read_bytes()
    assert sinks.write_corpus(docs, chunk.chunks(units, src), str(tmp_path / "o"), "p", b"m") == a and (tmp_path / "o" / "chunks.jsonl").read_bytes() == before
    sealed = sinks.seal(str(tmp_path / "o"), ["documents.json", "chunks.jsonl"], "p")
    files = spark.createDataFrame([(f["path"], f["sha256"]) for f in sealed["files"]], "path string, sha256 string")
    assert integrity.content_seal(files).first()["seal"] == sealed["bundleContentSha256"]
    assert sinks.snapshot(str(tmp_path / "o" / "chunks.jsonl"), str(tmp_path / "s" / "x")) and not sinks.snapshot(str(tmp_path / "o" / "chunks.jsonl"), str(tmp_path / "s" / "x"))
    with pytest.raises(integrity.BundleError):
        sinks.snapshot(str(tmp_path / "o" / "documents.json"), str(tmp_path / "s" / "x"))
    assert sinks.render(src, "{id}: {title}").orderBy("value").first()["value"] == "A: Guide" and json.loads(sinks.structured(src).first()["value"])["id"]


def test_streaming(spark, tmp_path):
    pack = replace(queries._batch_pack(), fields=queries._batch_pack().fields)
    rows = [("b1", 0, "e0", "en", "the x", "official"), ("b1", 1, "e1", "en", "x", "official"), ("b2", 0, "e0", "en", "y and z", "official")]
    df = spark.createDataFrame(rows, "batchId string, ord int, entryId string, field string, text string, profile string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {}
    q = shell.batches_to(stream, pack, lambda d, epoch: got.update({r["batchId"]: r["status"] for r in d.collect()}), str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert got == {"b1": "blocked", "b2": "review"}
    timed = findings.validate(df.withColumn("ts", F.timestamp_seconds(F.lit(0))), pack)
    assert {(r["status"], r["n"]) for r in shell.windowed_statuses(timed).collect()} == {("blocked", 1), ("pass", 1), ("review", 1)}
    assert shell.severest_by_window(timed).first()["status"] == "blocked"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL | more_queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = (queries.QUERIES | more_queries.QUERIES)[name](spark, folder)
    columns = sorted(df.columns)
    rel = con.sql((queries.ORACLE_SQL | more_queries.ORACLE_SQL)[name])
    assert columns == sorted(rel.columns)
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert text(df.select(*columns).collect()) == text(rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_sets_over_the_bound_are_dealt_into_blocks(spark, monkeypatch):
    rows = [(i, f"alpha{i % 7} beta{i % 5} gamma {i}") for i in range(40)]
    ready = search.prepare(spark.createDataFrame(rows, "id int, text string").withColumn("searchText", F.col("text")))
    queries = spark.createDataFrame([(i, f"beta{i % 5} alpha{i % 7}") for i in range(11)] + [(3, "gamma"), (50, "nowhere"), (None, "alpha1")], "query_id int, query string")
    quotes = spark.createDataFrame([(i, f"beta{i} gamma") for i in range(7)] + [(1, "alpha1"), (8, ""), (9, "alpha")], "item_id int, q string")
    passages = spark.createDataFrame([(t,) for _, t in rows], "s string")
    run = lambda: (sorted(map(str, search.search_many(ready, queries, 3).collect())), sorted(map(str, integrity.quotes_contained(quotes, passages).collect())))
    whole = run()
    assert len(whole[0]) > 30
    monkeypatch.setattr(search, "MAX_QUERIES", 5)
    monkeypatch.setattr(integrity, "MAX_QUOTES", 4)
    assert run() == whole
