"""Re-checking proposed spans: a candidate names a rule and an exact span; patterns judge the words around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.functions.text import occurrence_starts
from rulesift.operators.decide import cascade
from rulesift.operators.findings import by_severity, severity
from rulesift.plans.rulepack import RulePack

AROUND = 40
NEGATIVE_NEVER = "(?!)"


def _last(text: Column, part: str) -> Column:
    """Code points before the last occurrence, or -1."""
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back > 0, F.length(text) - back - len(part) + 1).otherwise(-1)


def _beside(near: Column, last: bool) -> Column:
    """The last or first AROUND UTF-16 units of a text of at most as many code points; half of a pair isn't kept."""
    units = F.encode(near, "UTF-16BE")
    size = 2 * AROUND
    cut = F.substring(units, F.greatest(F.length(units) - size, F.lit(0)) + 1, F.lit(size)) if last else F.substring(units, 1, size)
    edge = F.hex(F.substring(cut, 1, 2) if last else F.substring(cut, -2, 2))
    half = edge.between("DC00", "DFFF") if last else edge.between("D800", "DBFF")
    whole = F.when(half, F.substring(cut, 3, size) if last else F.substring(cut, 1, size - 2)).otherwise(cut)
    return F.when(F.length(units) <= size, near).otherwise(F.decode(whole, "UTF-16BE"))


def context_of(text: Column, start: Column, end: Column) -> Column:
    """The span with up to AROUND UTF-16 units on either side, cut after the last sentence end before and at the first after."""
    left = _beside(F.substring(text, F.greatest(start - AROUND, F.lit(0)) + 1, F.least(start, F.lit(AROUND))), last=True)
    right = _beside(F.substring(text, end + 1, AROUND), last=False)
    cut = F.greatest(_last(left, "\n"), _last(left, "."), _last(left, "다."))
    ends = F.array_min(F.filter(F.array(*[F.instr(right, p) for p in ("\n", ".", "다.")]), lambda x: x > 0))
    return F.concat(F.substring(left, cut + 2, AROUND), F.substring(text, start + 1, end - start), F.substring(right, 1, F.coalesce(ends, F.length(right))))


def _any(context: Column, patterns: tuple[str, ...]) -> Column:
    usable = [p for p in patterns if p != NEGATIVE_NEVER]
    return reduce(lambda a, b: a | b, [context.rlike(f"(?iu){p}") for p in usable], F.lit(False))


def verify(candidates: DataFrame, pack: RulePack) -> DataFrame:
    """The columns of ``candidates`` with candidateStatus, verification, finalRecommendation, errorCode, retryable, availableOccurrences."""
    rules = {r.id: r for r in pack.phrases()}
    rule_id, token = F.col("ruleId"), F.col("retryToken")
    pick = lambda names: rule_id.isin(*names) if names else F.lit(False)
    misplaced = reduce(lambda a, b: a | b, [(rule_id == r.id) & ~F.col("field").isin(*r.applies_to) for r in rules.values() if r.applies_to is not None], F.lit(False))
    staged = candidates.withColumn("__starts", occurrence_starts(F.col("text"), F.coalesce("spanText", F.lit(""))))
    n = F.size("__starts")
    occurrence = F.coalesce("occurrence", F.lit(1))
    error = cascade(
        (~pick(rules) | rule_id.isNull(), "unknown_rule_id"),
        (pick([i for i, r in rules.items() if r.editorial]) & ~F.col("profile").eqNullSafe("official_plus_editorial"), "rule_not_applicable"),
        (misplaced, "rule_not_applicable"),
        (F.coalesce("spanText", F.lit("")) == "", "empty_span"),
        (n == 0, "span_not_found"),
        ((n > 1) & F.col("occurrence").isNull(), "ambiguous_span"),
        ((occurrence < 1) | (occurrence > n), "occurrence_out_of_range"),
        (~pick([i for i, r in rules.items() if r.semantic]), "rule_not_semantic"),
    )
    staged = staged.withColumn("errorCode", error)
    start = F.when(F.col("errorCode").isNull(), F.try_element_at(F.col("__starts"), occurrence))
    staged = staged.withColumn("context", F.when(start.isNotNull(), context_of(F.col("text"), start, start + F.length("spanText"))))
    context = F.col("context")
    families = {k: reduce(lambda a, b: a | b, [(rule_id == i) & _any(context, getattr(r.semantic, k)) for i, r in rules.items() if r.semantic], F.lit(False)) for k in ("confirm", "support", "negative")}
    ok = F.col("errorCode").isNull()
    staged = staged.withColumns({"__confirm": families["confirm"], "__support": families["support"], "__negative": families["negative"]})
    verification = F.when(ok, F.when(F.col("__confirm") & ~F.col("__negative"), "confirmed").when(F.col("__confirm") | F.col("__support"), "supported_but_uncertain").otherwise("not_supported"))
    staged = staged.withColumn("verification", verification)
    second = F.coalesce(token, F.lit("")) != ""
    severe = pick([i for i, r in rules.items() if not r.editorial and r.outcome == "block"])
    final = F.when(~ok, F.when(second, "teacher_review")).when(F.col("verification") == "confirmed", F.when(severe, "prohibited").otherwise("revise")).when(F.col("verification") == "supported_but_uncertain", "teacher_review").otherwise("pass_no_match")
    options = F.when(F.col("errorCode").isin("ambiguous_span", "occurrence_out_of_range"), F.sequence(F.lit(1), n))
    return staged.select(
        *[F.col(f"`{c}`") for c in candidates.columns], F.when(ok, "verified").otherwise("invalid").alias("candidateStatus"), "verification", final.alias("finalRecommendation"), "errorCode", (~ok & ~second).alias("retryable"), options.alias("availableOccurrences"), "context"
    )


def retry_token(pack_id: str) -> Column:
    """A token for a second attempt; only its presence counts, and half of it is random."""
    named = F.to_json(F.array(F.lit(pack_id), F.col("entryId"), F.sha2("text", 256), F.col("candidateId"), F.col("ruleId")))
    return F.concat(F.sha2(named, 256), F.lit("."), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 16))


def entry_results(verified: DataFrame) -> DataFrame:
    """batchId, entryOrd, entryId, initialStatus, processingStatus, finalRecommendation: any retry leaves it open; else the severest, else the initial one."""
    rolled = verified.groupBy("batchId", "entryOrd", "entryId", "initialStatus").agg(F.bool_or("retryable").alias("retry"), F.max(F.when(F.col("finalRecommendation") != "pass_no_match", severity(F.col("finalRecommendation"), S.SEMANTIC_STATUS))).alias("place"))
    final = F.when(F.col("retry"), F.lit(None).cast("string")).otherwise(F.coalesce(by_severity(F.col("place"), S.SEMANTIC_STATUS), F.col("initialStatus")))
    return rolled.select("batchId", "entryOrd", "entryId", "initialStatus", F.when(F.col("retry"), "retry_required").otherwise("complete").alias("processingStatus"), final.alias("finalRecommendation"))


def batch_results(entries: DataFrame) -> DataFrame:
    """batchId, processingStatus, status."""
    open_ = F.col("processingStatus") == "retry_required"
    known = F.when(F.col("finalRecommendation").isin(*S.SEMANTIC_STATUS[1:]), severity(F.col("finalRecommendation"), S.SEMANTIC_STATUS))
    rolled = entries.groupBy("batchId").agg(F.bool_or(open_).alias("retry"), F.max(known).alias("place"))
    status = F.when(F.col("place").isNotNull(), by_severity(F.col("place"), S.SEMANTIC_STATUS)).when(~F.col("retry"), "pass_no_match")
    return rolled.select("batchId", F.when(F.col("retry"), "retry_required").otherwise("complete").alias("processingStatus"), status.alias("status"))
