"""Golden cases, aggregate semantics, and property checks of validation."""

from dataclasses import replace

import pytest

from rulesift import schemas as S
from rulesift.operators import findings, review
from rulesift.plans.api import InputError, Tools, parse_boolean, parse_hosts, parse_port, parse_token, parse_toolset
from rulesift.plans.rulepack import Evidence, Rule, RulePack, conformance_pack

SOUND = {"observationBasis": "direct", "observationContinuity": "continuous", "factualSupport": "supported", "studentMaterial": "none", "studentWroteFinalNarrative": False, "aiUse": "none"}
OPINION = "behavior_opinion"

# Fixed values: (field, text, profile, provenance, activity, volunteer, status, rules).
GOLDEN = [
    (OPINION, "친구의 의견을 경청하고 협력적으로 과제를 수행함.", None, SOUND, None, None, "pass", []),
    (OPINION, "TOEIC에서 높은 점수를 취득함.", None, SOUND, None, None, "blocked", ["OFFICIAL-LANGUAGE-TEST"]),
    (OPINION, "전국대회에서 수상함.", None, SOUND, None, None, "blocked", ["OFFICIAL-CONTEST-PARTICIPATION-AWARD"]),
    (OPINION, "아버지의 직업이 의사임.", None, SOUND, None, None, "blocked", ["OFFICIAL-PARENT-SOCIOECONOMIC-STATUS"]),
    (OPINION, "해외 봉사 경험을 발표함.", None, SOUND, None, None, "blocked", ["OFFICIAL-OVERSEAS-ACTIVITY"]),
    (OPINION, "협력적인 태도로 활동함.", None, SOUND | {"studentWroteFinalNarrative": True}, None, None, "blocked", ["OFFICIAL-STUDENT-FINAL-DRAFT"]),
    (OPINION, "협력적인 태도로 활동함.", None, SOUND | {"aiUse": "verbatim", "teacherVerifiedAgainstActualPerformance": True}, None, None, "blocked", ["OFFICIAL-AI-VERBATIM"]),
    (OPINION, "협력적인 태도로 활동함.", None, SOUND | {"aiUse": "proofreading", "teacherVerifiedAgainstActualPerformance": True}, None, None, "pass", []),
    (OPINION, "관찰한 수행을 바탕으로 교사가 다시 작성함.", None, SOUND | {"aiUse": "draft_generation_rewritten", "teacherVerifiedAgainstActualPerformance": True}, None, None, "pass", []),
    ("creative_autonomy_club_special", "주제 탐구 활동에 참여함.", None, SOUND, {"domestic": True, "organizers": [{"kind": "external", "name": "민간연구소"}], "schoolApproved": True, "inSchoolEducationPlan": True}, None, "blocked", ["FIELD-CREATIVE-ACTIVITY-SCOPE"]),
    ("creative_career_special", "진로 탐색 활동에 참여함.", None, SOUND, {"domestic": True, "organizers": [{"kind": "education_authority", "name": "서울특별시교육청"}], "schoolApproved": True}, None, "pass", []),
    ("attendance_special", "교외대회 참가로 결석함.", None, None, None, None, "blocked", ["FIELD-ATTENDANCE-PROHIBITED-CONTENT"]),
    ("volunteer_activity", "현금을 기부함.", None, {"aiUse": "none"}, None, {"planType": "school", "evidenceAvailable": True, "activityKind": "service"}, "blocked", ["FIELD-VOLUNTEER-SIMPLE-DONATION"]),
    ("subject_achievement_special", "MOOC 강좌를 이수함.", None, SOUND, None, None, "blocked", ["FIELD-SUBJECT-PROHIBITED-CONTENT"]),
    (OPINION, "협력" * 1000, None, SOUND, None, None, "pass", []),
    ("attendance_special", "가" * 501, None, None, None, None, "blocked", ["LENGTH-ATTENDANCE-SPECIAL"]),
    ("volunteer_activity", "가" * 51, None, {"aiUse": "none"}, None, {"planType": "school", "evidenceAvailable": True, "activityKind": "service"}, "blocked", ["LENGTH-VOLUNTEER-ACTIVITY"]),
    (OPINION, "항상 협력적인 태도를 보임.", "official_plus_editorial", SOUND, None, None, "review", ["EDITORIAL-UNSUPPORTED-SUPERLATIVE"]),
    (OPINION, "항상 협력적인 태도를 보임.", "official", SOUND, None, None, "pass", []),
    *[(OPINION, "교사의 직접 관찰과 학생 자료를 함께 활용함.", None, SOUND | {"studentMaterial": m, "studentMaterialInSchoolEducationPlan": True, "studentMaterialUnderTeacherGuidance": True}, None, None, "pass", []) for m in ("peer_evaluation", "self_evaluation", "class_output", "reflection", "book_report")],
    # tri-state metadata beyond the golden cases
    (OPINION, "활동함.", None, None, None, None, "needs_context", []),
    (OPINION, "활동함.", None, SOUND | {"observationContinuity": "single_event"}, None, None, "review", ["FIELD-BEHAVIOR-CONTINUOUS-OBSERVATION"]),
    (OPINION, "활동함.", None, SOUND | {"factualSupport": "known_false"}, None, None, "blocked", ["OFFICIAL-FACTUAL-ACCURACY"]),
    (OPINION, "활동함.", None, SOUND | {"studentMaterial": "reflection", "studentMaterialInSchoolEducationPlan": False}, None, None, "blocked", ["OFFICIAL-STUDENT-MATERIAL-CONDITIONS"]),
    (OPINION, "활동함.", None, SOUND | {"studentMaterial": "reflection", "studentMaterialInSchoolEducationPlan": True}, None, None, "review", ["OFFICIAL-STUDENT-MATERIAL-CONDITIONS"]),
    (OPINION, "활동함.", None, SOUND | {"aiUse": "proofreading"}, None, None, "review", ["OFFICIAL-AI-VERIFICATION"]),
    ("volunteer_activity", "청소함.", None, {"aiUse": "none"}, None, {"planType": "individual", "schoolApproved": False, "evidenceAvailable": True, "activityKind": "service"}, "blocked", ["FIELD-VOLUNTEER-ELIGIBILITY"]),
    ("volunteer_activity", "청소함.", None, None, None, {"planType": "individual", "schoolApproved": True, "evidenceAvailable": True, "activityKind": "service"}, "pass", []),
    ("volunteer_activity", "청소함.", None, None, None, None, "review", ["FIELD-VOLUNTEER-ELIGIBILITY"]),
    ("creative_career_special", "활동함.", None, SOUND, {"domestic": True, "organizers": [{"kind": "school"}], "inSchoolEducationPlan": None}, None, "review", ["FIELD-CREATIVE-ACTIVITY-SCOPE"]),
    ("student_name", "TOEIC", None, None, None, None, "pass", []),
]


def rows(cases):
    out = []
    names = S.names(S.PROVENANCE)
    for i, (field, text, profile, prov, act, vol, *_) in enumerate(cases):
        p = None if prov is None else tuple(prov.get(n) for n in names)
        a = None if act is None else (act.get("domestic"), [(o["kind"], o.get("name")) for o in act["organizers"]] if act.get("organizers") is not None else None, act.get("schoolApproved"), act.get("inSchoolEducationPlan"))
        v = None if vol is None else tuple(vol.get(n) for n in S.names(S.VOLUNTEER))
        out.append(("b", i, f"e{i}", field, text, None, None, profile, p, a, v))
    return out


def test_golden(spark):
    got = findings.validate(spark.createDataFrame(rows(GOLDEN), S.ENTRIES), conformance_pack()).orderBy("ord").collect()
    for case, r in zip(GOLDEN, got, strict=True):
        assert (r["status"], [f["ruleId"] for f in r["findings"]]) == (case[6], case[7]), (case, r["error"])
        assert all(len(f["matchedText"] or "") <= 80 for f in r["findings"])


def pack_of(*rules):
    return RulePack("t", (replace(conformance_pack().field_of[OPINION], provenance_mode="none"),), rules, (Evidence("E1", "c1", "s1", "T1", 100, "l", "q"), Evidence("E2", "c2", "s2", "T2", 80, "l", "q")))


def phrase(i, pattern, conflicts=(), **more):
    return Rule(i, "phrase", evidence=(more.pop("evidence", "E2"),), literal=False, patterns=(pattern,), conflicts=conflicts, message=i, recommendation=f"fix {i}", **more)


def judge(spark, pack, *texts):
    df = spark.createDataFrame([("b", i, f"e{i}", OPINION, t, "official_plus_editorial") for i, t in enumerate(texts)], "batchId string, ord int, entryId string, field string, text string, profile string")
    return findings.validate(df, pack)


def test_conflicts_merge_components_and_lower_the_status(spark):
    pack = pack_of(phrase("A", "aa", ("B",)), phrase("B", "bb", ("A", "C")), phrase("C", "cc", ("B",), evidence="E1"), phrase("D", "dd", ("A",)))
    got = {r["text"]: r for r in judge(spark, pack, "aa", "aa bb", "aa cc", "aa bb cc", "aa dd").collect()}
    assert got["aa"]["status"] == "blocked"
    assert [f["ruleId"] for f in got["aa bb"]["findings"]] == [findings.CONFLICT] and got["aa bb"]["status"] == "review"
    assert [f["ruleId"] for f in got["aa cc"]["findings"]] == ["C", "A"]  # no bridge without B; higher authority first
    whole = got["aa bb cc"]["findings"]
    assert whole[0]["conflictingRuleIds"] == ["A", "B", "C"] and whole[0]["authority"] == 100 and [e["evidenceId"] for e in whole[0]["evidence"]] == ["E1", "E2"]
    assert got["aa dd"]["status"] == "blocked"  # one side alone declares it


def test_offsets_and_distinct_places(spark):
    pack = pack_of(Rule("R", "phrase", evidence=("E1",), literal=False, patterns=("b+", "bb")))
    text = "😀 bb é b"
    r = judge(spark, pack, text).first()
    units = text.encode("utf-16-le")
    places = [(f["start"], f["end"], f["startCp"]) for f in r["findings"]]
    assert [units[2 * a : 2 * b].decode("utf-16-le") for a, b, _ in places] == ["bb", "b"]
    assert [text[c] for *_, c in places] == ["b", "b"]


def test_literals_heed_case_and_expressions_do_not(spark):
    pack = pack_of(Rule("L", "phrase", evidence=("E1",), patterns=("A.b",)), Rule("I", "phrase", evidence=("E1",), patterns=("A.b",), ignore_case=True), Rule("X", "phrase", evidence=("E1",), literal=False, patterns=("a.b",)))
    got = {r["text"]: sorted(f["ruleId"] for f in r["findings"]) for r in judge(spark, pack, "A.b", "a.B", "AxB").collect()}
    assert got == {"A.b": ["I", "L", "X"], "a.B": ["I", "X"], "AxB": ["X"]}


@pytest.mark.parametrize("pattern", [r"(a)\1", r"(?<=a)b", "a*", "(", ""])
def test_unsafe_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        pack_of(phrase("A", pattern))


def test_input_errors_and_batches(spark):
    tools = Tools(conformance_pack())
    schema = "entryId string, ord int, field string, text string, grade int"
    ok = spark.createDataFrame([("a", 0, OPINION, "좋음", 1), ("b", 1, OPINION, "TOEIC", None)], schema)
    assert tools.validate_record_batch(ok)[1].first()["status"] == "blocked"
    for bad in ([("a", 0, OPINION, "", None)], [("a", 0, "nope", "x", None)], [("a", 0, OPINION, "x", 7)], [("a", 0, OPINION, "x", None)] * 2, [("a", 0, "daily_life_special", "x", None)], [("a", 0, OPINION, "가" * 200_001, None)], [(f"e{i}", i, OPINION, "x", None) for i in range(101)]):
        with pytest.raises(InputError) as e:
            tools.validate_record_batch(spark.createDataFrame(bad, schema))
        assert "nope" not in str(e.value)
    flagged, _ = tools.validate_record_batch(spark.createDataFrame([("a", 0, "nope", "x", None)], schema), reject=False)
    assert flagged.first()["error"] == "unsupported field" and flagged.first()["status"] is None


def test_review(spark):
    tools = Tools(conformance_pack())
    df = spark.createDataFrame([("a", 0, OPINION, "TOEIC 점수"), ("b", 1, OPINION, "항상 좋음"), ("c", 2, OPINION, "좋음")], "entryId string, ord int, field string, text string")
    rows, batches = tools.check_school_record(df)
    got = rows.orderBy("ord").collect()
    assert [r["status"] for r in got] == ["prohibited", "revise", "pass"] and got[0]["label"] == "기재 불가"
    assert got[0]["rewritePlan"]["mustRemove"] == ["TOEIC"] and got[0]["rewritePlan"]["action"] == "ask_evidence" and got[2]["rewritePlan"]["instructions"] == []
    assert got[0]["issues"][0]["citations"][0]["title"] and got[1]["issues"][0]["citations"] == []
    b = batches.first()
    assert (b["status"], b["total"], b["pass"], b["revise"], b["prohibited"]) == ("prohibited", 3, 1, 1, 1)
    assert len(review.catalog_version(tools.pack)) == 64 and tools.rule_pack_info()["rules"] == len(tools.pack.rules)


def test_settings():
    assert parse_port("80") == 80 and parse_boolean("1") and parse_hosts("a, b,") == ["a", "b"] and parse_toolset(None) == "teacher" and parse_token("x" * 32)
    for call in (lambda: parse_port("0"), lambda: parse_boolean("yes"), lambda: parse_token("short"), lambda: parse_toolset("all")):
        with pytest.raises(InputError):
            call()


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = judge(spark, conformance_pack(), "x")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
