"""Texts for people: what each tool says about its result, one text a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulesift.operators.decide import REQUIRED_INPUT
from rulesift.plans.rulepack import RulePack

# Words of the texts.
STATUS = {"pass": "탐지 없음", "needs_context": "추가 정보 확인 필요", "review": "교사 검토 필요", "blocked": "기재 차단"}
CONTENT = {"pass": "통과", "review": "검토 필요", "blocked": "기재 차단"}
CONTEXT = {"complete": "확인됨", "needs_context": "정보 확인 필요", "review": "교사 검토 필요", "blocked": "기재 차단"}
REVIEW = {"pass": "통과", "revise": "수정 권장", "prohibited": "기재 불가"}
HOUSE_WARNING, HOUSE_ADVICE = "[자체 편집 경고 - 공식 규정 아님]", "[자체 편집 권고 - 교육부 공식 금지 규정 아님]"
NO_RESULTS, AGAIN = "검색 결과 없음", "후보 수정문은 같은 도구로 다시 검증한 뒤에만 사용하세요."
DISCLAIMER = "자동 검증 결과는 공식 승인이나 법률 자문이 아니며, 최종 기재 여부는 학교가 공식 원문과 사실관계를 확인해야 합니다."
# End of the fixed values.


def _label(key: Column, words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[key]


def _lines(*parts: Column) -> Column:
    """Lines and arrays of lines, nulls left out, as one text."""
    return F.concat_ws("\n", *parts)


def _cite(e: Column) -> Column:
    return F.concat(F.lit("["), e["title"], F.lit(", "), e["locatorLabel"], F.lit("] "), e["quote"])


def _finding(f: Column) -> Column:
    cited = F.transform(f["evidence"], lambda e: F.concat(F.lit("  "), _cite(e)))
    house = f["authorityClass"] == "editorial-caution"
    return _lines(F.concat(F.lit("- "), f["ruleId"], F.lit(": "), f["message"]), F.concat(F.lit("  권고: "), f["recommendation"]), F.when(house, f"  {HOUSE_WARNING}"), F.when(~house, _lines(cited)).otherwise(None))


def _no_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n+$", "")


def validation_texts(rows: DataFrame, pack: RulePack) -> DataFrame:
    """value: of validated entries."""
    need = {r: (pack.rule[r].message, REQUIRED_INPUT[r]) for r in REQUIRED_INPUT if r in pack.rule} or {"": ("", "")}
    message, fields = (F.create_map(*[F.lit(x) for r, v in need.items() for x in (r, v[i])]) for i in (0, 1))
    wants = F.transform("needsContext", lambda n: F.concat(F.lit("- 확인 필요: "), F.try_element_at(message, n), F.lit("\n  확인 항목: "), F.try_element_at(fields, n)))
    m = F.col("measurement")
    head = [F.concat(F.lit("문안 점검: "), _label(F.col("contentStatus"), CONTENT)), F.concat(F.lit("작성 경위: "), _label(F.col("contextStatus"), CONTEXT)), F.concat(F.lit("측정: "), m["charCount"].cast("string"), F.lit("자 / "), m["byteCount"].cast("string"), F.lit("Byte"))]
    return rows.select(_lines(*head, F.transform("findings", lambda f: _no_blank_lines(_finding(f))), wants, F.lit(DISCLAIMER)).alias("value"))


def batch_texts(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """batchId, value: of validated entries and their batches' statuses."""
    line = F.concat(F.lit("- "), F.col("entryId"), F.lit(": "), _label(F.col("status"), STATUS), F.lit(" ("), F.size("findings").cast("string"), F.lit("개 finding)"))
    listed = rows.groupBy("batchId").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))  # a batch has 100 entries at most
    head = [F.concat(F.lit("종합 상태: "), _label(F.col("status"), STATUS)), F.concat(F.lit("검증 문안: "), F.size("x").cast("string"), F.lit("건"))]
    return batches.select("batchId", "status").join(listed, "batchId").select("batchId", _lines(*head, F.transform("x", lambda e: e["line"])).alias("value"))


def review_texts(reviews: DataFrame, batches: DataFrame, policy: str = "") -> DataFrame:
    """batchId, value: of reviewed entries and their batches' counts."""
    plan = F.col("rewritePlan")
    listed = lambda label, column: F.when(F.size(column) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(column, ", ")))
    each = lambda label, column: F.when(F.size(column) > 0, _lines(F.transform(column, lambda x: F.concat(F.lit(f"  {label}: "), x))))
    house = F.transform(F.filter("issues", lambda i: i["kind"] == "editorial"), lambda i: F.lit(f"  {HOUSE_ADVICE}"))
    told = F.when(F.col("status") != "pass", _lines(F.concat(F.lit("  이유: "), F.col("reason")), each("개선", F.col("improvementGuidance")), F.when(F.size(house) > 0, _lines(house))))
    entry = _lines(
        F.concat(F.lit("- "), F.col("entryId"), F.lit(": "), F.col("label")), told, F.concat(F.lit("  외부 AI 후속 조치: "), plan["action"]), listed("삭제·제외할 표현", plan["mustRemove"]), each("수정 지침", plan["instructions"]),
        listed("추가 확인 자료", plan["neededEvidence"]), F.when(plan["requiresRevalidation"], F.lit(f"  {AGAIN}")),
    )
    gathered = reviews.groupBy("batchId").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("line")))).alias("x"))  # a batch has 100 entries at most
    number = lambda c: F.col(c).cast("string")
    counts = F.concat(F.lit("검토 문안: "), number("total"), F.lit("건 (통과 "), number("pass"), F.lit(" / 수정 권장 "), number("revise"), F.lit(" / 기재 불가 "), number("prohibited"), F.lit(")"))
    return batches.join(gathered, "batchId").select("batchId", _lines(F.concat(F.lit("종합: "), _label(F.col("status"), REVIEW)), counts, F.transform("x", lambda e: e["line"]), F.lit(f"※ {policy}"), F.lit(DISCLAIMER)).alias("value"))


def search_text(results: DataFrame) -> DataFrame:
    """value: of one ranked list (20 rows at most; id, title, locatorLabel, snippet, score), in its order."""
    rank = F.row_number().over(W.orderBy(F.desc("score"), F.desc("authority"), "id"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit(" - "), F.col("locatorLabel"), F.lit("\n   chunkId: "), F.col("id"), F.lit("\n   "), F.col("snippet"))
    listed = results.withColumn("rank", rank).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return listed.select(F.when(F.size("x") == 0, NO_RESULTS).otherwise(_lines(F.transform("x", lambda e: e["line"]))).alias("value"))


def excerpt_texts(excerpts: DataFrame) -> DataFrame:
    """value: of source excerpts."""
    return excerpts.select(_lines(F.concat(F.col("title"), F.lit(" - "), F.col("locatorLabel")), F.concat(F.lit("chunkId: "), F.col("chunkId")), F.coalesce("text", F.lit(""))).alias("value"))


def rule_texts(pack: RulePack, rules: DataFrame, summaries: DataFrame) -> DataFrame:
    """ruleId, value: of a pack's rules (``rules_table``) with the evidence of ``evidence_summaries``."""
    house = F.col("authorityClass") == "editorial-caution"
    joined = rules.join(summaries, "ruleId", "left")
    cited = F.transform("summaries", _cite)
    return joined.select("ruleId", _lines(F.concat(F.col("ruleId"), F.lit(": "), F.col("title")), F.col("message"), F.concat(F.lit("권고: "), F.col("recommendation")), F.when(house, HOUSE_WARNING), F.when(~house & (F.size("summaries") > 0), _lines(cited))).alias("value"))


def field_text(pack: RulePack) -> str:
    return "\n".join([f"지원 항목: {len(pack.fields)}개", *(f"- {f.key}: {f.label}" for f in pack.fields)])


def pack_text(info: dict) -> str:
    """Of ``Loaded.info``."""
    return "\n".join([info["rulePackId"], f"학교급: 초등학교 / 학년도: {info['academicYear']}", f"시행일: {info['effectiveFrom']}", f"공식 출처: {len(info['sources'])}개"])
