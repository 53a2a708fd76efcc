"""Sealed bundles on disk: a sound one loads, each fault has its kind; texts for people."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.errors import BundleError
from rulesift.operators import findings, review
from rulesift.plans.api import Tools
from rulesift.plans.rulepack import Rule, conformance_pack
from rulesift.sources import bundle, readers, render, sinks

PACK = "test-pack"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest().upper()


def fold(t):
    from rulesift.operators.search import fold_query

    return fold_query(t)


def contents():
    """The parsed files of a sound bundle."""
    levels = ["elementary"]
    sources = [{"id": f"S{i}", "title": f"T{i}", "role": "verification-copy" if i == 7 else "primary-guide", "format": "pdf", "authority": 80, "schoolLevels": levels, "academicYear": 2026, "effectiveFrom": "2026-03-01", "fileName": "f", "relativeInputPath": f"in/{i}", "snapshotName": f"s{i}", "sha256": sha(str(i)), "minimumExtractedChars": 1} for i in range(8)]
    documents = [{k: s[k] for k in ("title", "role", "format", "authority", "schoolLevels", "snapshotName")} | {"sourceId": s["id"], "sourceSha256": s["sha256"], "unitCount": 1, "extractedCharCount": 5, "includedInChunks": s["role"] != "verification-copy"} for s in sources]
    text = "Texts Are Judged by what was seen."
    chunks = [{"id": f"S{i}:1", "sourceId": f"S{i}", "authority": 80, "schoolLevels": levels, "locator": {"kind": "pdf-page", "pdfPage": 1}, "locatorLabel": "p. 1", "headingPath": [], "text": text, "searchText": fold(text), "textSha256": sha(text)} for i in range(7)]
    active = [{"chunkId": c["id"], "scope": "elementary", "reason": "r"} for c in chunks]
    evidence = [{"id": f"E{i}", "chunkId": f"S{i}:1", "quote": "what was seen", "quoteSha256": sha("what was seen"), "checkedBy": "human", "checkedOn": "2026-07-30"} for i in range(2)]
    rule = {"title": "t", "message": "m", "recommendation": "r", "exceptions": []}
    official = rule | {"authorityClass": "official-policy", "profile": "official", "evidenceIds": ["E0"]}
    lengths = dict(zip(bundle.FIELD_KEYS[:4], bundle.LENGTH_RULES[:4], strict=True)) | {"volunteer_activity": bundle.LENGTH_RULES[4]}
    fields = {k: {"key": k, "label": k, "lengthPolicy": {"kind": "fixed-bytes", "displayKoreanChars": 5, "maxBytes": 15, "scope": "field"} if k in lengths else {"kind": "system-range"}, "applicableTo": "all-elementary", "contentRuleMode": "global-prohibitions", "provenanceMode": "none", "evidenceIds": ["E0"]} | ({"lengthRuleId": lengths[k]} if k in lengths else {}) for k in bundle.FIELD_KEYS}
    rules = [official | {"id": i, "kind": "length", "field": k, "maxBytes": 15, "outcome": "block", "appliesTo": [k]} for k, i in lengths.items()]
    rules += [official | {"id": "TEST", "outcome": "block", "appliesTo": "all", "detector": {"type": "regex-any", "patterns": ["toe[il]c"]}, "semanticReview": {"concept": "c", "semanticHints": ["h"], "confirmPatterns": [{"patternId": "p", "pattern": "score", "termPatterns": [{"termId": "t", "pattern": "s"}]}], "supportPatterns": [{"patternId": "q", "pattern": "test"}], "negativePatterns": [{"patternId": "n", "pattern": "(?!)"}]}}]
    rules += [rule | {"id": "STYLE", "authorityClass": "editorial-caution", "profile": "official_plus_editorial", "outcome": "review", "localPolicyId": bundle.POLICY, "appliesTo": ["behavior_opinion"], "detector": {"type": "literal-any", "patterns": ["always"], "caseInsensitive": True}}]
    rules += [official | {"id": "FACTS", "kind": "metadata", "check": "factual-accuracy", "possibleOutcomes": ["block", "review"], "appliesTo": ["behavior_opinion"]}]
    pack = {"id": PACK, "schoolLevel": "elementary", "academicYear": 2026, "effectiveFrom": "2026-03-01", "defaultProfile": "official", "authorityOrder": [100, 80, 10], "fields": fields, "rules": rules, "localPolicies": {bundle.POLICY: {"label": "l", "disclaimer": bundle.DISCLAIMER}}}
    return {"sources": {"schemaVersion": 1, "packId": PACK, "sources": sources}, "documents": documents, "chunks": chunks, "active": active, "evidence": evidence, "rules": pack}


def seal(root, got, spoil=lambda raw, manifest: None, corpus=None):
    """Write the files; spoil changes the bytes by kind, or the manifest, after everything has been hashed."""
    raw = {k: json.dumps(v).encode() for k, v in got.items()}
    raw["chunks"] = "".join(json.dumps(c) + "\n" for c in got["chunks"]).encode()
    told = {"schemaVersion": 1, "packId": PACK, "sourceManifestSha256": sha(raw["sources"]), "documentsSha256": sha(raw["documents"]), "chunksSha256": sha(raw["chunks"]), "documentCount": len(got["documents"]), "chunkCount": len(got["chunks"])}
    raw["corpus"] = json.dumps(told | (corpus or {})).encode()
    spoil(raw, None)
    paths = {k: p.format(PACK) for k, p in bundle.FILES.items()}
    files = [{"path": paths[k], "sha256": sha(raw[k])} for k in paths]
    manifest = {"schemaVersion": 1, "packId": PACK, "files": files, "bundleContentSha256": sha("".join(f"{f['path']}\0{f['sha256']}\n" for f in sorted(files, key=lambda f: f["path"])))}
    spoil(raw, manifest)
    for k, data in raw.items():
        (root / paths[k]).parent.mkdir(parents=True, exist_ok=True)
        (root / paths[k]).write_bytes(data)
    (root / bundle.MANIFEST).write_text(json.dumps(manifest))
    return str(root)


def test_sound_bundle_loads_and_serves(spark, tmp_path):
    tools = Tools.load(spark, seal(tmp_path, contents()), PACK)
    entry = spark.createDataFrame([("behavior_opinion", "Always a TOEIC.", "official_plus_editorial"), ("address", "x" * 16, "official")], "field string, text string, profile string")
    rows = {r["field"]: r for part in (entry.limit(1), entry.where("field = 'address'")) for r in tools.validate_record_text(part).collect()}
    assert [f["ruleId"] for f in rows["behavior_opinion"]["findings"]] == ["TEST", "STYLE"] and rows["behavior_opinion"]["findings"][0]["evidence"][0]["title"] == "T0"
    assert [f["ruleId"] for f in rows["address"]["findings"]] == ["LENGTH-ADDRESS"]
    info = tools.rule_pack_info()
    assert info["rulePackId"] == PACK and len(info["sources"]) == 8 and len(info["data"]["files"]) == 7 and len(info["data"]["bundleManifestSha256"]) == 64
    assert [r["id"] for r in tools.search_record_guidance("what was seen", 1).collect()] == ["S0:1"] and "8개" in render.pack_text(info)


def put(kind, *path):
    """A change of one value; the path ends with the new one."""

    def change(got):
        at = got[kind]
        for k in path[:-2]:
            at = at[k]
        at[path[-2]] = path[-1]

    return change


QUOTE = {"quote": "never", "quoteSha256": sha("never")}
FAULTS = [
    ("schema", put("sources", "sources", 0, "academicYear", 2025)), ("schema", put("sources", "sources", 0, "extra", 1)), ("schema", put("documents", 0, "unitCount", 0)), ("schema", put("documents", 0, "unitCount", True)), ("schema", put("chunks", 0, "locator", {"kind": "pdf-page", "pdfPage": 1, "x": 1})),
    ("schema", put("chunks", 0, "locator", {"kind": "appendix", "appendix": 6, "unitIndex": 1})), ("schema", put("rules", "fields", "address", "label", " ")), ("schema", put("rules", "rules", 5, "outcome", "warn")), ("schema", put("active", 0, "scope", "all")), ("schema", put("evidence", 0, "checkedBy", "tool")),
    ("rule-authority-separation", put("rules", "rules", 6, "evidenceIds", ["E0"])), ("rule-authority-separation", put("rules", "rules", 5, "localPolicyId", bundle.POLICY)),
    ("duplicate-id", put("active", 0, "chunkId", "S1:1")), ("duplicate-id", put("sources", "sources", 0, "snapshotName", "s1")), ("duplicate-id", put("rules", "rules", 5, "id", "STYLE")), ("duplicate-id", put("rules", "fields", "behavior_opinion", "evidenceIds", ["E0", "E0"])), ("duplicate-id", put("rules", "rules", 6, "appliesTo", ["behavior_opinion", "behavior_opinion"])), ("duplicate-id", put("rules", "rules", 7, "possibleOutcomes", ["block", "block"])),
    ("source-document-metadata", put("documents", 0, "title", "other")), ("chunk-text-hash", put("chunks", 0, "text", "other")), ("source-chunk-reference", put("chunks", 0, "sourceId", "S9")), ("document-chunk-inclusion", put("documents", 0, "includedInChunks", False)),
    ("active-chunk-reference", put("active", 0, "chunkId", "none")), ("active-chunk-scope", put("active", 0, "scope", "common")), ("evidence-quote-hash", put("evidence", 0, "quote", "never")), ("evidence-quote-containment", lambda g: g["evidence"][0].update(QUOTE)),
    ("rule-field-reference", put("rules", "fields", "behavior_opinion", "key", "address")), ("rule-evidence-reference", put("rules", "rules", 5, "evidenceIds", ["E9"])), ("rule-conflict-reference", put("rules", "rules", 5, "conflictsWith", ["TEST"])), ("rule-conflict-symmetry", put("rules", "rules", 5, "conflictsWith", ["STYLE"])),
    ("length-rule-field", put("rules", "rules", 0, "maxBytes", 14)), ("length-rule-field", put("rules", "rules", 0, "appliesTo", ["address"])), ("unsafe-regex", put("rules", "rules", 5, "detector", "patterns", ["(?<=a)b"])), ("unsafe-regex", put("rules", "rules", 5, "detector", "patterns", ["a*"])),
]


def kind_of(spark, root):
    with pytest.raises(BundleError) as e:
        bundle.load_bundle(spark, root, PACK)
    return e.value.kind


@pytest.mark.parametrize("at", range(0, len(FAULTS), 9))
def test_faults_have_their_kinds(spark, tmp_path, at):
    for i, (kind, change) in enumerate(FAULTS[at : at + 9]):
        got = contents()
        change(got)
        assert kind_of(spark, seal(tmp_path / str(i), got)) == kind, (at + i, kind)


def test_faults_of_files(spark, tmp_path):
    def spoil(change):
        def run(raw, manifest):
            change(raw, manifest)

        return run

    before = lambda k, data: spoil(lambda raw, m: raw.update({k: data}) if m is None else None)
    after = lambda change: spoil(lambda raw, m: change(raw, m) if m is not None else None)
    cases = {
        "json-syntax": before("rules", b"{"), "json-lines": before("chunks", b"{}\n\n{}\n"), "bundle-file-hash": after(lambda raw, m: raw.update(rules=b"{}")), "bundle-content-hash": after(lambda raw, m: m.update(bundleContentSha256="0" * 64)),
        "bundle-file-set": after(lambda raw, m: m["files"].__setitem__(0, m["files"][1] | {"path": m["files"][0]["path"]}) or None), "duplicate-id": after(lambda raw, m: m["files"].__setitem__(0, m["files"][1])),
    }
    cases["bundle-file-hash 2"] = cases.pop("bundle-file-set")
    for kind, change in cases.items():
        assert kind_of(spark, seal(tmp_path / kind.replace(" ", ""), contents(), change)) == kind.split()[0], kind
    assert kind_of(spark, seal(tmp_path / "c", contents(), corpus={"chunkCount": 1})) == "corpus-count" and kind_of(spark, seal(tmp_path / "d", contents(), corpus={"documentsSha256": "0" * 64})) == "corpus-file-hash"
    (tmp_path / "c" / bundle.FILES["active"]).unlink()
    assert kind_of(spark, str(tmp_path / "c")) == "data-read" and kind_of(spark, str(tmp_path / "nowhere")) == "data-read"


def test_table_reader_is_closed_at_every_level(spark):
    ddl = "a int, b struct<c: string>, d array<struct<e: int>>"
    rows = lambda *texts: spark.createDataFrame([(t,) for t in texts], "value string")
    assert [tuple(r) for r in readers.parse_rows(rows('{"a":1,"b":{"c":"x"},"d":[{"e":2}]}'), ddl, "p").collect()] == [(1, ("x",), [(2,)])]
    for bad in ('{"a":"x"}', '{"b":{"z":1}}', '{"d":[{"e":1},{"y":1}]}', '{"b":{"c":"x"}}'):
        with pytest.raises(BundleError) as e:
            readers.parse_rows(rows(bad), ddl, "p", required=("a",))
        assert e.value.kind == "schema"


def test_json_lines_are_sorted_at_every_level(spark):
    df = spark.sql("SELECT 1 AS z, named_struct('y', 2, 'b', array(named_struct('d', 1, 'c', 2))) AS a, CAST(NULL AS struct<q:int>) AS n")
    assert sinks.json_lines(df).first()["value"] == '{"a":{"b":[{"c":2,"d":1}],"y":2},"z":1}'


def test_names_are_compared_composed(spark):
    """Full-width, decomposed and spaced names are the same name; the fixed institutions need no list."""
    import unicodedata

    base = conformance_pack()
    rule = Rule(findings.SPECIFIC_NAME, "phrase", "name", evidence=("EV-GUIDE-18-PROHIBITIONS",), literal=False, patterns=(r"교육부|대한민국 학술원|ＡＢＣ 연구소|" + unicodedata.normalize("NFD", "교육부") + "|다른곳",), outcome="review")
    pack = base.with_rules(rule)
    sound = {"domestic": True, "schoolApproved": True, "inSchoolEducationPlan": True}
    act = lambda name: (sound["domestic"], [("school", name)], True, True)
    cases = [("behavior_opinion", "교육부", None, 0), ("behavior_opinion", "대한민국 학술원", None, 0), ("behavior_opinion", unicodedata.normalize("NFD", "교육부"), None, 0), ("behavior_opinion", "다른곳", None, 1), ("creative_career_special", "ＡＢＣ 연구소", act("ABC연구소"), 0), ("creative_career_special", "ＡＢＣ 연구소", act("ABD"), 1), ("behavior_opinion", "ＡＢＣ 연구소", act("ABC연구소"), 1)]
    df = spark.createDataFrame([(i, f, t, "official", a) for i, (f, t, a, _) in enumerate(cases)], f"i int, field string, text string, profile string, activityContext {S.nested(S.ACTIVITY)}")
    got = {r["i"]: sum(f["ruleId"] == findings.SPECIFIC_NAME for f in r["findings"]) for r in findings.validate(df, pack).collect()}
    assert got == {i: n for i, (*_, n) in enumerate(cases)}


def test_texts_for_people(spark):
    pack = conformance_pack()
    df = spark.createDataFrame([("b", 0, "e0", "behavior_opinion", "TOEIC 항상", "official_plus_editorial"), ("b", 1, "e1", "student_name", "가", "official_plus_editorial")], "batchId string, ord int, entryId string, field string, text string, profile string")
    rows = findings.validate(df, pack)
    told = [r["value"] for r in render.validation_texts(rows.orderBy("ord"), pack).collect()]
    assert told[0].startswith("문안 점검: 기재 차단\n작성 경위: 정보 확인 필요\n측정: 8자 / 12Byte\n- OFFICIAL-LANGUAGE-TEST: ") and render.HOUSE_WARNING in told[0] and "확인 항목: provenance.aiUse" in told[0] and told[0].endswith(render.DISCLAIMER)
    assert told[1] == f"문안 점검: 통과\n작성 경위: 확인됨\n측정: 1자 / 3Byte\n{render.DISCLAIMER}"
    batch = render.batch_texts(rows, findings.batch_status(rows)).first()["value"].split("\n")
    assert batch == ["종합 상태: 기재 차단", "검증 문안: 2건", "- e0: 기재 차단 (2개 finding)", "- e1: 탐지 없음 (0개 finding)"]
    reviewed = review.review(rows)
    text = render.review_texts(reviewed, review.review_batches(reviewed), "policy").first()["value"]
    assert text.startswith("종합: 기재 불가\n검토 문안: 2건 (통과 1 / 수정 권장 0 / 기재 불가 1)\n- e0: 기재 불가\n  이유: ") and "삭제·제외할 표현: TOEIC" in text and "※ policy" in text and "- e1: 통과\n  외부 AI 후속 조치: none\n※" in text
    found = spark.createDataFrame([("c1", "T", "p. 1", "snip", 2.0, 80), ("c2", "T", "p. 2", "snap", 3.0, 80)], "id string, title string, locatorLabel string, snippet string, score double, authority int")
    assert render.search_text(found).first()["value"] == "1. T - p. 2\n   chunkId: c2\n   snap\n2. T - p. 1\n   chunkId: c1\n   snip" and render.search_text(found.limit(0)).first()["value"] == render.NO_RESULTS
    assert render.excerpt_texts(found.select(F.col("id").alias("chunkId"), "title", "locatorLabel", F.lit("body").alias("text"))).first()["value"] == "T - p. 1\nchunkId: c1\nbody"
    evidence = spark.createDataFrame([(r.id, [(pack.evidence_of[e].title, pack.evidence_of[e].locator_label, pack.evidence_of[e].quote) for e in r.evidence]) for r in pack.rules if r.evidence], "ruleId string, summaries array<struct<title:string,locatorLabel:string,quote:string>>")
    rules = {r["ruleId"]: r["value"] for r in render.rule_texts(pack, pack.rules_table(spark), evidence).collect()}
    assert rules["OFFICIAL-LANGUAGE-TEST"].split("\n")[-1].startswith("[2026") and rules["EDITORIAL-UNSUPPORTED-SUPERLATIVE"].endswith(render.HOUSE_WARNING)
    assert render.field_text(pack).startswith("지원 항목: 10개\n- student_name: 성명")


def test_context_counts_utf16_units(spark):
    from rulesift.operators.semantic import context_of

    wide = "😀" * 30 + "x"
    for text, want in ((wide + "SPAN" + "y" * 50, "😀" * 19 + "x" + "SPAN" + "y" * 40), ("SPAN" + "a" + "😀" * 30, "SPAN" + "a" + "😀" * 19), ("b" * 50 + "SPAN", "b" * 40 + "SPAN")):
        at = text.index("SPAN")
        got = spark.createDataFrame([(text, at)], "t string, s int").select(context_of(F.col("t"), F.col("s"), F.col("s") + 4).alias("x")).first()["x"]
        assert got == want
