"""Decision tables over tri-state metadata, and input checks. Absent is null and never false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.functions.text import normalize_name, utf16_length
from rulesift.plans.rulepack import RulePack

VERDICT = "array<struct<ruleId:string,outcome:string>>"
# Names of rules, of student materials, of excluded volunteer activities and of institutions.
AI_VERBATIM, AI_VERIFICATION = "OFFICIAL-AI-VERBATIM", "OFFICIAL-AI-VERIFICATION"
MATERIALS = ("peer_evaluation", "self_evaluation", "class_output", "reflection", "book_report")
EXCLUDED_SERVICE = ("simple_donation", "disciplinary_service", "juvenile_social_service", "education_activity_infringement_measure")
INSTITUTION_ENDINGS = ("교육청", "교육지원청")
INSTITUTIONS = ("교육부", "대한민국학술원", "국사편찬위원회", "국립국제교육원", "국립특수교육원", "교원소청심사위원회", "중앙교육연수원")
CREATIVE_FIELDS = ("creative_autonomy_club_special", "creative_career_special")
REQUIRED_INPUT = {
    "OFFICIAL-DIRECT-OBSERVATION": "provenance.observationBasis",
    "FIELD-BEHAVIOR-CONTINUOUS-OBSERVATION": "provenance.observationContinuity",
    "OFFICIAL-FACTUAL-ACCURACY": "provenance.factualSupport",
    "OFFICIAL-STUDENT-MATERIAL-CONDITIONS": "provenance.studentMaterial",
    "OFFICIAL-STUDENT-FINAL-DRAFT": "provenance.studentWroteFinalNarrative",
    AI_VERIFICATION: "provenance.aiUse",
}


def true(x: Column) -> Column:
    return x.eqNullSafe(True)


def false(x: Column) -> Column:
    return x.eqNullSafe(False)


def _in(x: Column, *values: str) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def cascade(*cases: tuple[Column, str]) -> Column:
    """The outcome of the first case that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, outcome in reversed(cases):
        out = F.when(condition, F.lit(outcome)).otherwise(out)
    return out


def _split(rules: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Matches and rules that need context, in order, from outcomes block, review, needs or null."""
    pairs = F.array(*[F.struct(F.lit(i).alias("ruleId"), o.alias("outcome")) for i, o in rules])
    matches = F.filter(pairs, lambda x: x["outcome"].isin("block", "review"))
    needs = F.transform(F.filter(pairs, lambda x: x["outcome"] == "needs"), lambda x: x["ruleId"])
    return matches, needs


def observation(p: Column) -> Column:
    basis = p["observationBasis"]
    return cascade((_in(basis, "none"), "block"), (_in(basis, "documented_exception"), "review"), (basis.isNull() | _in(basis, "unknown"), "needs"))


def continuity(p: Column) -> Column:
    x = p["observationContinuity"]
    return cascade((_in(x, "continuous"), None), (_in(x, "single_event"), "review"), (F.lit(True), "needs"))


def accuracy(p: Column) -> Column:
    x = p["factualSupport"]
    return cascade((_in(x, "known_false"), "block"), (_in(x, "unverified"), "review"), (x.isNull() | _in(x, "unknown"), "needs"))


def material(p: Column) -> Column:
    x, plan, guided = p["studentMaterial"], p["studentMaterialInSchoolEducationPlan"], p["studentMaterialUnderTeacherGuidance"]
    allowed = _in(x, *MATERIALS)
    return cascade((_in(x, "other"), "block"), (allowed & (false(plan) | false(guided)), "block"), (allowed & ~(true(plan) & true(guided)), "review"), (x.isNull(), "needs"))


def final_draft(p: Column) -> Column:
    x = p["studentWroteFinalNarrative"]
    return cascade((true(x), "block"), (x.isNull(), "needs"))


def ai_verbatim(p: Column) -> Column:
    return cascade((_in(p["aiUse"], "verbatim"), "block"))


def ai_verification(p: Column) -> Column:
    x = p["aiUse"]
    helped = _in(x, "proofreading", "draft_generation_rewritten")
    return cascade((helped & ~true(p["teacherVerifiedAgainstActualPerformance"]), "review"), (x.isNull() | _in(x, "unknown"), "needs"))


def provenance(pack: RulePack, field: Column, p: Column) -> Column:
    """struct(matches, needs): all rules for observed fields, AI rules alone for activities, none else."""
    watched = [f.key for f in pack.fields if f.provenance_mode == "teacher-observation"]
    activity = [f.key for f in pack.fields if f.provenance_mode == "activity-evidence"]
    matches, needs = _split([
        ("OFFICIAL-DIRECT-OBSERVATION", observation(p)),
        ("FIELD-BEHAVIOR-CONTINUOUS-OBSERVATION", F.when(field == "behavior_opinion", continuity(p))),
        ("OFFICIAL-FACTUAL-ACCURACY", accuracy(p)),
        ("OFFICIAL-STUDENT-MATERIAL-CONDITIONS", material(p)),
        ("OFFICIAL-STUDENT-FINAL-DRAFT", final_draft(p)),
        (AI_VERBATIM, ai_verbatim(p)),
        (AI_VERIFICATION, ai_verification(p)),
    ])
    ai, _ = _split([(AI_VERBATIM, ai_verbatim(p)), (AI_VERIFICATION, ai_verification(p))])
    nothing, no_needs = F.array().cast(VERDICT), F.array().cast("array<string>")
    return F.struct(
        F.when(_in(field, *watched), matches).when(_in(field, *activity), ai).otherwise(nothing).alias("matches"),
        F.when(_in(field, *watched), needs).otherwise(no_needs).alias("needs"),
    )


def creative(a: Column) -> Column:
    """Outcome for the scope of a creative activity, or null."""
    organizers = F.coalesce(a["organizers"], F.array().cast("array<struct<kind:string,name:string>>"))
    some = lambda kind: F.exists(organizers, lambda o: _in(o["kind"], kind))
    return cascade(
        (false(a["domestic"]) | some("external"), "block"),
        (~true(a["domestic"]) | (F.size(organizers) == 0) | some("unknown"), "review"),
        (F.forall(organizers, lambda o: _in(o["kind"], "school")), "plan"),
        (~true(a["schoolApproved"]), "review"),
    )


def creative_outcome(a: Column) -> Column:
    x = creative(a)
    return F.when(x == "plan", F.when(true(a["inSchoolEducationPlan"]), F.lit(None).cast("string")).otherwise("review")).otherwise(x)


def volunteer_outcome(v: Column) -> Column:
    kind, plan = v["activityKind"], v["planType"]
    return cascade(
        (_in(kind, *EXCLUDED_SERVICE), "block"),
        (_in(plan, "individual") & false(v["schoolApproved"]), "block"),
        (plan.isNull() | _in(plan, "unknown") | ~true(v["evidenceAvailable"]) | kind.isNull() | _in(kind, "unknown"), "review"),
        (_in(plan, "school") & _in(kind, "service"), None),
        (_in(plan, "individual") & true(v["schoolApproved"]) & _in(kind, "service"), None),
        (F.lit(True), "review"),
    )


def one(rule_id: str, outcome: Column) -> Column:
    """Array of one verdict, or none where the outcome is null."""
    return F.when(outcome.isNotNull(), F.array(F.struct(F.lit(rule_id).alias("ruleId"), outcome.alias("outcome")))).otherwise(F.array().cast(VERDICT))


def allowed_plain(plain: Column, names: tuple[str, ...] = ()) -> Column:
    """``allowed_institution`` of a name that is composed and without blanks."""
    return reduce(lambda a, b: a | b, [plain.endswith(e) for e in INSTITUTION_ENDINGS], plain.isin(*INSTITUTIONS, *names))


def allowed_institution(name: Column, names: tuple[str, ...] = (), compose: bool = True) -> Column:
    """On the fixed list or on ``names``, or one of the offices that its ending tells."""
    return allowed_plain(normalize_name(name, compose), names)


def shape_error(pack: RulePack, e: Column | None = None) -> Column:
    """The first reason why an entry can't be judged, or null. Works on columns field, text, profile, grade, curriculum."""
    c = (lambda n: F.col(n)) if e is None else (lambda n: e[n])
    special = [f.key for f in pack.fields if f.applicable_to == "special-basic-curriculum"]
    size = utf16_length(c("text"))
    return cascade(
        (~_in(c("field"), *pack.field_of), "unsupported field"),
        (c("text").isNull() | (size < 1) | (size > S.MAX_TEXT), "text must contain 1 to 200000 characters"),
        (c("profile").isNotNull() & ~_in(c("profile"), *S.PROFILES), "unsupported profile"),
        (c("grade").isNotNull() & ~c("grade").between(1, 6), "grade must be an integer from 1 to 6"),
        (c("curriculum").isNotNull() & ~_in(c("curriculum"), *S.CURRICULA), "unsupported curriculum"),
        (_in(c("field"), *special) & ~_in(c("curriculum"), "special_basic"), "this field requires curriculum special_basic"),
    )
