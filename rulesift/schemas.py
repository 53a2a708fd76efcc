"""Table layouts, enumerations and severity orders of the rule engine."""

from __future__ import annotations

# Closed lists of the data model.
PROFILES = ("official", "official_plus_editorial")
CURRICULA = ("general", "special_basic")
CONTENT_STATUS = ("pass", "review", "blocked")
CONTEXT_STATUS = ("complete", "needs_context", "review", "blocked")
OVERALL_STATUS = ("pass", "needs_context", "review", "blocked")
REVIEW_STATUS = ("pass", "revise", "prohibited")
SEMANTIC_STATUS = ("pass_no_match", "teacher_review", "revise", "prohibited")
SOURCE_ROLES = ("primary-guide", "directive-body", "verification-copy", "directive-appendix")
REVIEW_LABELS = {"pass": "통과", "revise": "수정 권장", "prohibited": "기재 불가"}
MAX_TEXT, MAX_BATCH, MAX_ID, MAX_QUERY, MAX_LIMIT, DEFAULT_LIMIT, MAX_CANDIDATES, MAX_SPAN, MAX_TOKEN = 200_000, 100, 100, 200, 20, 5, 10, 200, 300


def _parts(ddl: str) -> list[tuple[str, str]]:
    """Names and types of a column list; commas inside angle brackets don't part columns."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            name, kind = ddl[start:i].split(None, 1)
            out.append((name, kind.strip()))
            start = i + 1
    return out


def names(ddl: str) -> list[str]:
    return [n for n, _ in _parts(ddl)]


def nested(ddl: str) -> str:
    """The struct type of a column list, as text: no session is needed."""
    return f"struct<{','.join(f'{n}:{k}' for n, k in _parts(ddl))}>"


PROVENANCE = "observationBasis string, observationExceptionReason string, observationContinuity string, factualSupport string, studentMaterial string, studentMaterialInSchoolEducationPlan boolean, studentMaterialUnderTeacherGuidance boolean, studentWroteFinalNarrative boolean, aiUse string, teacherVerifiedAgainstActualPerformance boolean, evidenceReference string"
ACTIVITY = "domestic boolean, organizers array<struct<kind: string, name: string>>, schoolApproved boolean, inSchoolEducationPlan boolean"
VOLUNTEER = "planType string, schoolApproved boolean, evidenceAvailable boolean, activityKind string"


ENTRIES = f"batchId string, ord int, entryId string, field string, text string, grade int, curriculum string, profile string, provenance {nested(PROVENANCE)}, activityContext {nested(ACTIVITY)}, volunteerContext {nested(VOLUNTEER)}"
CANDIDATES = "batchId string, entryOrd int, entryId string, text string, field string, profile string, initialStatus string, candOrd int, candidateId string, ruleId string, spanText string, occurrence int, retryToken string"
LOCATOR = "kind string, pdfPage int, printedPage int, article string, paragraph string, appendix int, unitIndex int"
SOURCES = "id string, title string, role string, format string, authority int, schoolLevels array<string>, academicYear int, effectiveFrom string, publishedAt string, fileName string, relativeInputPath string, snapshotName string, sha256 string, sourceUrl string, minimumExtractedChars int"
DOCUMENTS = "sourceId string, title string, role string, format string, authority int, schoolLevels array<string>, sourceSha256 string, sourceUrl string, snapshotName string, unitCount int, extractedCharCount int, includedInChunks boolean"
CHUNKS = f"id string, sourceId string, authority int, schoolLevels array<string>, locator {nested(LOCATOR)}, locatorLabel string, headingPath array<string>, text string, searchText string, textSha256 string"
ACTIVE = "chunkId string, scope string, reason string"
EVIDENCE = "id string, chunkId string, quote string, quoteSha256 string, checkedBy string, checkedOn string"
UNITS = f"sourceId string, locator {nested(LOCATOR)}, headingPath array<string>, rawText string"

EVIDENCE_SUMMARY = "evidenceId string, chunkId string, sourceId string, title string, authority int, locatorLabel string, quote string"
FINDING = f"ruleId string, authorityClass string, authority int, outcome string, category string, message string, recommendation string, matchedText string, start int, end int, startCp int, evidence array<{nested(EVIDENCE_SUMMARY)}>, localPolicyId string, conflictingRuleIds array<string>"
