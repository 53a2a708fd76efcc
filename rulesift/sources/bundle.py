"""Loading a sealed bundle: seven files and their manifest become tables and a rule pack, or a failure with its kind.

Any store that Spark reads will do. Hashes are taken and layouts are judged where the files are read (see ``layout``):
unknown keys, missing keys and values outside their range are ``schema`` failures. The driver gets a row for each file, the
two manifests, the rule pack, which becomes constants of plans, and the excerpts that the pack cites. A document of more
than ``MAX_FILE`` bytes, or lines of more than ``MAX_LINES``, are refused. Everything that compares tables is left to the
checks of ``operators.integrity``, in their order; the first failure of all is raised.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.errors import BundleError
from rulesift.operators import integrity
from rulesift.plans.rulepack import Evidence, Field, Rule, RulePack, Semantic
from rulesift.sources.layout import Layout, any_text, closed, columns, count, day, document, either, flag, lines, many, mapped, matching, name, one_of, problem, text, whole
from rulesift.sources.tables import written

#: Bytes of a document, which is one value, and of a file of lines, which is hashed as a whole.
MAX_FILE, MAX_LINES = 16 << 20, 1 << 30

# Places of a bundle's files ({} is the pack's id), lists and constants of their layouts.
MANIFEST = "data/bundle-manifest.json"
FILES = {"sources": "sources/manifest.json", "documents": "data/corpus/documents.json", "chunks": "data/corpus/chunks.jsonl", "corpus": "data/corpus/corpus-manifest.json", "active": "data/corpus/active-chunks.json", "evidence": "data/evidence/verified-excerpts.json", "rules": "data/rules/{}.json"}
FIELD_KEYS = ("student_name", "address", "academic_status_special", "attendance_special", "creative_autonomy_club_special", "creative_career_special", "volunteer_activity", "daily_life_special", "subject_achievement_special", "behavior_opinion")
LENGTH_RULES = ("LENGTH-STUDENT-NAME", "LENGTH-ADDRESS", "LENGTH-ACADEMIC-STATUS-SPECIAL", "LENGTH-ATTENDANCE-SPECIAL", "LENGTH-VOLUNTEER-ACTIVITY")
METADATA_CHECKS = ("direct-observation", "factual-accuracy", "student-material", "student-final-narrative", "ai-use", "behavior-continuous-observation")
CONTEXT_CHECKS = ("creative-activity-eligibility", "volunteer-eligibility")
LEVELS, FORMATS, AUTHORITIES, APPENDICES = ("elementary", "middle", "high"), ("pdf", "text", "hwpml", "hwp5"), (100, 80), (7, 8, 9, 10, 11)
YEAR, EFFECTIVE, CHECKED_ON, SOURCE_COUNT, POLICY = 2026, "2026-03-01", "2026-07-30", 8, "LOCAL-EDITORIAL-POLICY"
DISCLAIMER = "교육부 명시 금지가 아닌 보수적 문장 품질 검토 항목"
# End of the fixed values.

sha, url, snapshot = matching("[A-F0-9]{64}"), matching(r"(?i)[a-z][a-z0-9+.-]*:\S+"), matching("[A-Za-z0-9][A-Za-z0-9._-]*")
levels = many(one_of(*LEVELS), 1, distinct=True)
_origin = {"title": text, "role": one_of(*S.SOURCE_ROLES), "format": one_of(*FORMATS), "authority": one_of(*AUTHORITIES), "schoolLevels": levels, "snapshotName": snapshot}
_source = closed(_origin | {"id": name, "academicYear": one_of(YEAR), "effectiveFrom": one_of(EFFECTIVE), "fileName": text, "relativeInputPath": text, "sha256": sha, "minimumExtractedChars": whole}, {"publishedAt": day, "sourceUrl": url})
_document = closed(_origin | {"sourceId": name, "sourceSha256": sha, "unitCount": whole, "extractedCharCount": whole, "includedInChunks": flag}, {"sourceUrl": url})
_locator = either(
    closed({"kind": one_of("pdf-page"), "pdfPage": whole}, {"printedPage": whole}),
    closed({"kind": one_of("article"), "article": text}, {"paragraph": text}),
    closed({"kind": one_of("appendix"), "appendix": one_of(*APPENDICES), "unitIndex": whole}),
)
_chunk = closed({"id": name, "sourceId": name, "authority": one_of(*AUTHORITIES), "schoolLevels": levels, "locator": _locator, "locatorLabel": text, "headingPath": many(text), "text": any_text, "searchText": any_text, "textSha256": sha})
_approval = closed({"chunkId": name, "scope": one_of("elementary", "common"), "reason": text})
_excerpt = closed({"id": name, "chunkId": name, "quote": text, "quoteSha256": sha, "checkedBy": one_of("human"), "checkedOn": one_of(CHECKED_ON)})
_length = either(
    closed({"kind": one_of("fixed-bytes"), "displayKoreanChars": whole, "maxBytes": whole, "scope": one_of("field", "entry")}),
    closed({"kind": one_of("conditional-name"), "displayKoreanChars": one_of(20), "displayLatinChars": one_of(60), "maxBytes": one_of(60)}),
    closed({"kind": one_of("system-range")}),
)
_field = closed(
    {"key": one_of(*FIELD_KEYS), "label": text, "lengthPolicy": _length, "applicableTo": one_of("all-elementary", "special-basic-curriculum"), "contentRuleMode": one_of("none", "global-prohibitions"), "provenanceMode": one_of("none", "teacher-observation", "activity-evidence"), "evidenceIds": many(name, 1)},
    {"lengthRuleId": one_of(*LENGTH_RULES)},
)
_pattern = {"patternId": name, "pattern": text}
_semantic = closed({"concept": text, "semanticHints": many(text, 1), "confirmPatterns": many(closed(_pattern | {"termPatterns": many(closed({"termId": name, "pattern": text}), 1)}), 1), "supportPatterns": many(closed(_pattern), 1), "negativePatterns": many(closed(_pattern), 1)})
_detector = closed({"type": one_of("literal-any", "regex-any"), "patterns": many(text, 1)}, {"caseInsensitive": flag})
_rule = {"id": name, "title": text, "appliesTo": either(one_of("all"), many(one_of(*FIELD_KEYS), 1)), "message": text, "recommendation": text, "exceptions": many(text)}
_official = _rule | {"authorityClass": one_of("official-policy"), "profile": one_of("official"), "evidenceIds": many(name, 1)}
_editorial = _rule | {"authorityClass": one_of("editorial-caution"), "profile": one_of("official_plus_editorial"), "outcome": one_of("review"), "localPolicyId": one_of(POLICY), "detector": _detector}
_outcomes, _also = {"possibleOutcomes": many(one_of("block", "review"), 1)}, {"conflictsWith": many(name)}
_any_rule = either(
    closed(_official | {"outcome": one_of("block", "review"), "detector": _detector}, _also | {"semanticReview": _semantic}),
    closed(_editorial, _also | {"semanticReview": _semantic}),
    closed(_official | {"kind": one_of("length"), "field": one_of(*FIELD_KEYS), "maxBytes": whole, "outcome": one_of("block")}, _also),
    closed(_official | _outcomes | {"kind": one_of("metadata"), "check": one_of(*METADATA_CHECKS)}, _also),
    closed(_official | _outcomes | {"kind": one_of("context"), "check": one_of(*CONTEXT_CHECKS)}, _also),
)


def layouts(pack_id: str) -> dict[str, Layout]:
    """The layout of each file."""
    head = {"schemaVersion": one_of(1), "packId": one_of(pack_id)}
    paths = [p.format(pack_id) for p in FILES.values()]
    return {
        MANIFEST: closed(head | {"files": many(closed({"path": one_of(*paths), "sha256": sha}), len(paths), len(paths)), "bundleContentSha256": sha}),
        "sources": closed(head | {"sources": many(_source, SOURCE_COUNT, SOURCE_COUNT)}),
        "documents": many(_document), "chunks": _chunk, "active": many(_approval), "evidence": many(_excerpt),
        "corpus": closed(head | {"sourceManifestSha256": sha, "documentsSha256": sha, "chunksSha256": sha, "documentCount": count, "chunkCount": count}),
        "rules": closed({
            "id": one_of(pack_id), "schoolLevel": one_of(LEVELS[0]), "academicYear": one_of(YEAR), "effectiveFrom": one_of(EFFECTIVE), "defaultProfile": one_of("official"), "authorityOrder": one_of([100, 80, 10]),
            "fields": mapped(FIELD_KEYS, _field), "rules": many(_any_rule, 1), "localPolicies": closed({POLICY: closed({"label": text, "disclaimer": one_of(DISCLAIMER)})}),
        }),
    }


# --- reading ----------------------------------------------------------------------------------------------------


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest().upper()


def files_read(spark: SparkSession, root: str, paths: list[str], told: tuple[str, ...] = ()) -> dict[str, tuple[str, bytes | None]]:
    """The hash of each file, in one pass, and the bytes of those ``told``; one that can't be read, or is too large, is a ``data-read`` failure, the first in order."""
    most = F.when(F.col("path").endswith(".jsonl"), MAX_LINES).otherwise(MAX_FILE)
    small = F.lit(False)
    for p in told:
        small = small | F.col("path").endswith(f"/{p}")

    def read(some: list[str]) -> dict:
        rows = spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in some]).where(F.col("length") <= most)
        got = rows.select("path", F.upper(F.sha2("content", 256)).alias("sha256"), F.when(small, F.col("content")).alias("content")).collect()  # a row for each of a bundle's files
        return {p: (r["sha256"], None if r["content"] is None else bytes(r["content"])) for p in some for r in got if r["path"].endswith(f"/{p}")}

    try:
        found = read(paths)
    except Exception:
        found = {}
    for p in paths:
        if p not in found:
            try:
                found |= read([p])
            except Exception as e:
                raise BundleError("data-read", p) from e
            if p not in found:
                raise BundleError("data-read", p)
    return found


def _refuse(constant: str) -> object:
    raise ValueError(constant)


def parse(data: bytes, path: str) -> object:
    """The value of a small JSON file: the manifests and the rule pack, whose values become constants of plans."""
    try:
        return json.loads(data.decode("utf-8", "replace"), parse_constant=_refuse)
    except ValueError as e:
        raise BundleError("json-syntax", path) from e


def problems(rows: dict[str, tuple[DataFrame, Layout]]) -> dict[str, str | None]:
    """What is wrong with each file's values, in one job."""
    each = [problem(df, layout, "blank" in df.columns).select(F.lit(kind).alias("kind"), "problem") for kind, (df, layout) in rows.items()]
    return {r["kind"]: r["problem"] for r in reduce(DataFrame.unionByName, each).collect()}  # a row for each file


def _authorities_mixed(raw: object) -> bool:
    """Official rules without evidence or with a local policy, editorial ones with evidence or without their policy; told before the layout."""
    rules = raw.get("rules") if isinstance(raw, dict) else None
    for r in rules if isinstance(rules, list) else []:
        if not isinstance(r, dict):
            continue
        kind, profile = r.get("authorityClass"), r.get("profile")
        if kind == "official-policy" and (profile != "official" or "localPolicyId" in r or "evidenceIds" not in r):
            return True
        if kind == "editorial-caution" and (profile != "official_plus_editorial" or r.get("localPolicyId") != POLICY or "evidenceIds" in r):
            return True
    return False


def rule_pack(raw: dict, excerpts: tuple[Evidence, ...] = (), gate: bool = True) -> RulePack:
    """A pack from its file's object. With ``gate=False`` patterns are not judged yet."""
    fields = []
    for f in raw["fields"].values():
        p = f["lengthPolicy"]
        fields.append(Field(f["key"], f["label"], p["kind"], p.get("maxBytes"), p.get("displayKoreanChars"), p.get("displayLatinChars"), p.get("scope"), f["applicableTo"], f["contentRuleMode"], f["provenanceMode"], f.get("lengthRuleId"), tuple(f["evidenceIds"])))
    rules = []
    for r in raw["rules"]:
        d, s = r.get("detector"), r.get("semanticReview")
        own = {} if d is None else {"literal": d["type"] == "literal-any", "patterns": tuple(d["patterns"]), "ignore_case": d.get("caseInsensitive", False)}
        if s:
            listed = lambda k, s=s: tuple(x["pattern"] for x in s[k])
            own["semantic"] = Semantic(s["concept"], tuple(s["semanticHints"]), listed("confirmPatterns"), listed("supportPatterns"), listed("negativePatterns"))
        rules.append(
            Rule(
                r["id"], r.get("kind", "phrase"), r["title"], r["authorityClass"] == "editorial-caution", None if r["appliesTo"] == "all" else tuple(r["appliesTo"]), r.get("outcome", "block"), r["message"], r["recommendation"],
                tuple(r.get("evidenceIds", ())), r.get("localPolicyId"), tuple(r.get("conflictsWith", ())), field=r.get("field"), max_bytes=r.get("maxBytes"), check=r.get("check"), exceptions=tuple(r["exceptions"]), outcomes=tuple(r.get("possibleOutcomes", ())), **own,
            )
        )
    return RulePack(raw["id"], tuple(fields), tuple(rules), excerpts, raw["defaultProfile"], {k: v["disclaimer"] for k, v in raw["localPolicies"].items()}, tuple(raw["fields"]), gate)


@dataclass
class Loaded:
    """A bundle that has passed all checks, and what its manifest says."""

    bundle: integrity.Bundle
    pack: RulePack
    raw_rules: dict
    sources: list[dict]
    files: list[dict]  # path, sha256
    manifest_sha256: str
    content_sha256: str

    def info(self) -> dict:
        """What identifies the pack: its constants, sources and hashes."""
        r = self.raw_rules
        told = ("title", "role", "authority", "schoolLevels", "academicYear", "effectiveFrom", "sourceUrl", "sha256")
        return {
            "rulePackId": r["id"], **{k: r[k] for k in ("schoolLevel", "academicYear", "effectiveFrom", "defaultProfile", "authorityOrder")},
            "sources": [{"sourceId": s["id"]} | {k: s[k] for k in told if s.get(k) is not None} for s in self.sources],
            "data": {"bundleManifestSha256": self.manifest_sha256, "bundleContentSha256": self.content_sha256, "files": [dict(f) for f in self.files]},
        }


def load_bundle(spark: SparkSession, root: str, pack_id: str) -> Loaded:
    """Read, check and build; raises ``BundleError`` for the first failure, in the order of a start-up."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # as JSON parsers do, the last of equal keys counts
    paths, layout = {k: p.format(pack_id) for k, p in FILES.items()}, layouts(pack_id)
    manifest_sha, manifest_bytes = files_read(spark, root, [MANIFEST], (MANIFEST,))[MANIFEST]
    manifest = parse(manifest_bytes, MANIFEST)
    full = {kind: f"{root.rstrip('/')}/{path}" for kind, path in (paths | {MANIFEST: MANIFEST}).items()}
    if problems({MANIFEST: (document(spark, full[MANIFEST]), layout[MANIFEST])})[MANIFEST]:
        raise BundleError("schema", MANIFEST)
    declared = {f["path"]: f["sha256"] for f in manifest["files"]}
    if len(declared) < len(manifest["files"]):
        raise BundleError("duplicate-id", MANIFEST)
    if set(declared) != set(paths.values()):
        raise BundleError("bundle-file-set", MANIFEST)
    found = files_read(spark, root, list(paths.values()), (paths["corpus"], paths["rules"]))
    for path in paths.values():
        if found[path][0] != declared[path]:
            raise BundleError("bundle-file-hash", path)
    if _digest("".join(f"{p}\0{declared[p]}\n" for p in sorted(declared)).encode()) != manifest["bundleContentSha256"]:
        raise BundleError("bundle-content-hash", MANIFEST)

    values = {kind: lines(spark, full[kind]) if kind == "chunks" else document(spark, full[kind]) for kind in paths}
    wrong = problems({kind: (df, layout[kind]) for kind, df in values.items()})
    for kind in ("sources", "documents", "chunks", "corpus", "active", "evidence"):
        if wrong[kind]:
            raise BundleError(wrong[kind], paths[kind])
    rules = parse(found[paths["rules"]][1], paths["rules"])
    if _authorities_mixed(rules):
        raise BundleError("rule-authority-separation", paths["rules"])
    if wrong["rules"]:
        raise BundleError(wrong["rules"], paths["rules"])

    def rows(kind: str, at: str = "$") -> DataFrame:
        return values[kind].select(F.explode(F.try_variant_get("v", at, "array<variant>")).alias("v"))

    listed = {"sources": (rows("sources", "$.sources"), S.SOURCES), "documents": (rows("documents"), S.DOCUMENTS), "chunks": (values["chunks"], S.CHUNKS), "active": (rows("active"), S.ACTIVE), "evidence": (rows("evidence"), S.EVIDENCE)}
    tables = {kind: written(columns(df, S.nested(ddl)), f"bundle-{kind}") for kind, (df, ddl) in listed.items()}
    keys = (("sources", "id"), ("sources", "snapshotName"), ("documents", "sourceId"), ("chunks", "id"), ("active", "chunkId"), ("evidence", "id"))
    each = [integrity.repeated(tables[kind], key).agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n") for i, (kind, key) in enumerate(keys)]
    repeats = [keys[r["i"]][0] for r in reduce(DataFrame.unionByName, each).where("n > 0").orderBy("i").collect()]  # a row for each key
    if len({r["id"] for r in rules["rules"]}) < len(rules["rules"]):
        repeats.append("rules")
    if repeats:
        raise BundleError("duplicate-id", paths[repeats[0]])

    corpus = json.loads(found[paths["corpus"]][1])
    # What the pack cites becomes part of its messages; other excerpts stay where they are.
    citing = sorted({e for x in (*rules["fields"].values(), *rules["rules"]) for e in x.get("evidenceIds", ())})
    told = tables["evidence"].where(F.col("id").isin(*citing)).select(F.col("id").alias("e"), "chunkId", "quote").join(tables["chunks"].select(F.col("id").alias("chunkId"), "sourceId", "authority", "locatorLabel"), "chunkId").join(tables["sources"].select(F.col("id").alias("sourceId"), "title"), "sourceId", "left")
    excerpts = tuple(Evidence(r["e"], r["chunkId"], r["sourceId"], r["title"] or "", r["authority"], r["locatorLabel"], r["quote"]) for r in sorted(told.collect(), key=lambda r: r["e"]))
    pack = rule_pack(rules, excerpts, gate=False)
    hashes = [(paths[k], corpus[n], found[paths[k]][0]) for k, n in (("sources", "sourceManifestSha256"), ("documents", "documentsSha256"), ("chunks", "chunksSha256"))]
    bundle = integrity.Bundle(
        tables["sources"], tables["documents"], tables["chunks"], tables["active"], tables["evidence"], pack,
        corpus_counts=(corpus["documentCount"], corpus["chunkCount"]), corpus_hashes=spark.createDataFrame(hashes, "path string, declared string, actual string"),
    )
    for kind, place, ids in integrity.violations(bundle):
        raise BundleError(kind, ids[0] if kind == "corpus-file-hash" else paths.get(place, place))
    pack = replace(pack, gate=True)
    origins = [r.asDict() for r in tables["sources"].collect()]  # SOURCE_COUNT rows
    return Loaded(replace(bundle, pack=pack), pack, rules, origins, manifest["files"], manifest_sha, manifest["bundleContentSha256"])
