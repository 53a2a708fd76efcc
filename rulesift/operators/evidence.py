"""Evidence lookups: excerpts, their sources, and what a rule means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesift.operators.findings import CONFLICT
from rulesift.plans.rulepack import RulePack


class UnknownChunk(ValueError):
    pass


class UnknownRule(ValueError):
    pass


def evidence_summaries(rules: DataFrame, evidence: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """ruleId, summaries: the rule's excerpts in its order, each with its passage and source. A missing one is an error.

    Rules are exploded, joined by key, and gathered again with their place.
    """
    cited = rules.select("ruleId", F.posexplode("evidenceIds").alias("pos", "evidenceId"))
    whole = (
        cited.join(evidence.select(F.col("id").alias("evidenceId"), "chunkId", "quote"), "evidenceId", "left")
        .join(chunks.select(F.col("id").alias("chunkId"), "sourceId", "authority", "locatorLabel"), "chunkId", "left")
        .join(sources.select(F.col("id").alias("sourceId"), "title"), "sourceId", "left")
    )
    checked = whole.withColumn("title", F.when(F.col("title").isNotNull(), F.col("title")).otherwise(F.raise_error(F.concat(F.lit("missing evidence: "), F.col("evidenceId")))))
    item = F.struct("pos", "evidenceId", "chunkId", "sourceId", "title", "authority", "locatorLabel", "quote")
    gathered = checked.groupBy("ruleId").agg(F.array_sort(F.collect_list(item)).alias("x"))
    return gathered.select("ruleId", F.transform("x", lambda s: s.dropFields("pos")).alias("summaries"))


def source_excerpt(chunk_id: str, chunks: DataFrame, active: DataFrame, sources: DataFrame) -> DataFrame:
    """The passage with its source; passages that aren't active are unknown."""
    one = chunks.where(F.col("id") == chunk_id).join(active.where(F.col("chunkId") == chunk_id).select(F.col("chunkId").alias("id")), "id", "left_semi")
    found = one.join(sources.select(F.col("id").alias("sourceId"), "title", "role", F.col("sha256").alias("sourceSha256")), "sourceId")
    if found.isEmpty():
        raise UnknownChunk("unknown or inactive chunk")
    return found.select(F.col("id").alias("chunkId"), "sourceId", "title", "role", "authority", "sourceSha256", "locator", "locatorLabel", "headingPath", "text", "textSha256")


def active_chunks(approvals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages on the approval list (chunkId, ord), with the list's order."""
    return chunks.join(approvals.select(F.col("chunkId").alias("id"), "ord"), "id")


def explain_rule(pack: RulePack, rule_id: str) -> dict:
    """Outcomes, detector and evidence of a rule, the virtual conflict rule included."""
    if rule_id == CONFLICT:
        return {"ruleId": CONFLICT, "authorityClass": "official-policy", "possibleOutcomes": ["review"], "detectorSummary": "mutually declared conflicts among matched rules", "evidenceIds": []}
    if rule_id not in pack.rule:
        raise UnknownRule("unknown rule")
    r = pack.rule[rule_id]
    if r.kind == "phrase":
        outcomes, summary = [r.outcome], f"{'literal-any' if r.literal else 'regex-any'}: {len(r.patterns)} patterns"
    elif r.kind == "length":
        outcomes, summary = [r.outcome], f"length: more than {r.max_bytes} bytes in {r.field}"
    else:
        outcomes, summary = ["block", "review"], f"{r.kind}: {r.check}"
    out = {"ruleId": r.id, "title": r.title, "authorityClass": r.authority_class, "profile": r.profile, "appliesTo": "all" if r.applies_to is None else list(r.applies_to), "message": r.message, "recommendation": r.recommendation, "possibleOutcomes": outcomes, "detectorSummary": summary, "exceptions": list(r.exceptions), "evidenceIds": list(r.evidence)}
    return out | ({"localPolicyId": r.local_policy, "disclaimer": pack.local_policies.get(r.local_policy or "", "")} if r.editorial else {})
