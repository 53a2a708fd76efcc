"""The reviewer's view of validated entries: issues, three-state status, counts, rewrite plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.operators.findings import by_severity, severity
from rulesift.plans.rulepack import RulePack

# Texts that reviewers see.
PASS_REASON = "현재 규칙팩에서 금지 또는 수정 권장 표현이 탐지되지 않았습니다."
REWRITE_REASON = {
    "pass": "현재 규칙팩에서 수정이 필요한 항목이 탐지되지 않았습니다.",
    "prohibited": "입력 문장에 기재할 수 없는 핵심 내용이 포함되어 있어, 해당 내용을 제거한 안전한 수정문을 자동으로 확정할 수 없습니다.",
    "revise": "입력에 이미 확인된 사실만 유지하고 지적된 표현을 수정한 후보를 외부 AI가 작성한 뒤 다시 검증해야 합니다.",
}
NEEDED_EVIDENCE = ("observed fact that can be stated", "confirmation by the teacher in charge")
DEFAULT_FIELD, DEFAULT_PROFILE = "subject_achievement_special", "official_plus_editorial"


def issue_status(f: Column) -> Column:
    """An official block on content is prohibited, everything else is to be revised."""
    return F.when((f["authorityClass"] == "official-policy") & (f["outcome"] == "block") & (f["category"] == "content"), "prohibited").otherwise("revise")


def _issue(f: Column) -> Column:
    official = f["authorityClass"] == "official-policy"
    cite = F.transform(f["evidence"], lambda e: F.struct(e["title"].alias("title"), e["locatorLabel"].alias("locatorLabel"), e["quote"].alias("quote")))
    return F.struct(
        f["ruleId"].alias("ruleId"), F.when(official, "official").otherwise("editorial").alias("kind"), issue_status(f).alias("status"), f["message"].alias("reason"), f["recommendation"].alias("improvement"),
        F.when(f["matchedText"] != "", f["matchedText"]).alias("matchedText"), F.when(official, cite).otherwise(F.slice(cite, 1, 0)).alias("citations"),
    )


def issues(found: Column) -> Column:
    """Findings that a text's author can act on, as issues."""
    return F.transform(F.filter(found, lambda f: ~f["category"].isin("provenance", "context")), _issue)


def entry_status(own: Column) -> Column:
    return F.when(F.exists(own, lambda i: i["status"] == "prohibited"), "prohibited").when(F.size(own) > 0, "revise").otherwise("pass")


def label(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in S.REVIEW_LABELS.items() for x in pair])[status]


def rewrite_plan(status: Column, own: Column) -> Column:
    bad = F.filter(own, lambda i: i["status"] == "prohibited")
    none = F.array().cast("array<string>")
    remove = F.array_distinct(F.filter(F.transform(bad, lambda i: i["matchedText"]), lambda t: t.isNotNull()))
    advice = F.array_distinct(F.filter(F.transform(own, lambda i: i["improvement"]), lambda t: F.trim(t) != ""))
    reason = F.create_map(*[F.lit(x) for pair in REWRITE_REASON.items() for x in pair])[status]
    return F.struct(
        F.create_map(F.lit("pass"), F.lit("none"), F.lit("prohibited"), F.lit("ask_evidence"), F.lit("revise"), F.lit("rewrite"))[status].alias("action"),
        F.when(status == "pass", none).otherwise(remove).alias("mustRemove"), F.when(status == "pass", none).otherwise(advice).alias("instructions"), reason.alias("rewriteReason"),
        F.when(status == "prohibited", F.array(*map(F.lit, NEEDED_EVIDENCE))).otherwise(none).alias("neededEvidence"), (status != "pass").alias("requiresRevalidation"),
    )


def review(validated: DataFrame) -> DataFrame:
    """batchId, ord, entryId, field, error, status, label, reason, issues, improvementGuidance, rewritePlan."""
    listed = validated.withColumn("issues", issues(F.col("findings"))).withColumn("reviewStatus", entry_status(F.col("issues")))
    ok = F.col("error").isNull()
    return listed.select(
        *[c for c in ("batchId", "ord", "entryId", "field", "error") if c in listed.columns],
        F.when(ok, F.col("reviewStatus")).alias("status"), F.when(ok, label(F.col("reviewStatus"))).alias("label"),
        F.when(F.col("reviewStatus") == "pass", PASS_REASON).otherwise(F.try_element_at(F.col("issues"), F.lit(1))["reason"]).alias("reason"), "issues",
        F.array_distinct(F.transform("issues", lambda i: i["improvement"])).alias("improvementGuidance"), rewrite_plan(F.col("reviewStatus"), F.col("issues")).alias("rewritePlan"),
    )


def review_batches(reviewed: DataFrame) -> DataFrame:
    """batchId, status and counts; null status where an entry has an error, as it rejects the batch."""
    rolled = reviewed.groupBy("batchId").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in S.REVIEW_STATUS], F.max(severity(F.col("status"), S.REVIEW_STATUS)).alias("place"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("error")
    )
    return rolled.select("batchId", F.when(F.col("error").isNull(), by_severity(F.col("place"), S.REVIEW_STATUS)).alias("status"), "total", *S.REVIEW_STATUS, "error")


def semantic_catalog(pack: RulePack) -> list[dict]:
    """What a reader is asked to judge: phrase rules with a semantic part."""
    return [{"ruleId": r.id, "action": "prohibited" if not r.editorial and r.outcome == "block" else "revise", "concept": r.semantic.concept, "semanticHints": list(r.semantic.hints)} for r in pack.phrases() if r.semantic]


def catalog_version(pack: RulePack) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(semantic_catalog(pack), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest().upper()
