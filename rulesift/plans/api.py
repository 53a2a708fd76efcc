"""The nine tools over a bundle, as functions on DataFrames (tables of any size) or on one request."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesift import schemas as S
from rulesift.operators import decide, evidence, findings, review, search, semantic
from rulesift.plans.rulepack import RulePack
from rulesift.sources.bundle import load_bundle


class InputError(ValueError):
    """A request outside the contract; its text never holds what was sent."""


@dataclass
class Tools:
    pack: RulePack
    chunks: DataFrame | None = None
    active: DataFrame | None = None
    sources: DataFrame | None = None
    institutions: tuple[str, ...] = ()
    info: dict | None = None

    @classmethod
    def load(cls, spark: SparkSession, root: str, pack_id: str, institutions: tuple[str, ...] = ()) -> Tools:
        """The tools over the sealed bundle in a folder, once it has passed every check."""
        got = load_bundle(spark, root, pack_id)
        return cls(got.pack, got.bundle.chunks, got.bundle.active, got.bundle.sources, institutions, got.info())

    def _checked(self, entries: DataFrame) -> DataFrame:
        """Reject a batch with a bad shape or a bad entry before any is judged."""
        bad = findings.batch_errors(entries).limit(1).collect()
        if bad:
            raise InputError(f"Invalid validation input: {bad[0]['error']}")
        wrong = entries.select(decide.shape_error(self.pack).alias("e")).where("e IS NOT NULL").limit(1).collect()
        if wrong:
            raise InputError(f"Invalid validation input: {wrong[0]['e']}")
        return entries

    @staticmethod
    def _complete(entries: DataFrame, defaults: dict) -> DataFrame:
        for name, value in defaults.items():
            entries = entries.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in entries.columns else F.lit(value))
        for name, kind in {"grade": "int", "curriculum": "string"}.items():
            if name not in entries.columns:
                entries = entries.withColumn(name, F.lit(None).cast(kind))
        return entries

    def validate_record_batch(self, entries: DataFrame, reject: bool = True) -> tuple[DataFrame, DataFrame]:
        """(entries with findings and statuses, status of each batch); with ``reject=False`` bad rows are flagged instead."""
        entries = self._complete(entries, {"batchId": "batch", "profile": self.pack.default_profile})
        rows = findings.validate(self._checked(entries) if reject else entries, self.pack, self.institutions)
        return rows, findings.batch_status(rows)

    def validate_record_text(self, entries: DataFrame) -> DataFrame:
        return self.validate_record_batch(entries.withColumns({"entryId": F.lit("entry"), "ord": F.lit(0)}))[0]

    def check_school_record(self, entries: DataFrame, default_field: str = review.DEFAULT_FIELD, profile: str = review.DEFAULT_PROFILE) -> tuple[DataFrame, DataFrame]:
        """(reviews of entries, counts of each batch). The reviewer's view has no curriculum, so fields that need one reject the batch."""
        entries = self._complete(entries, {"batchId": "batch", "field": default_field}).withColumns({"profile": F.lit(profile), "curriculum": F.lit(None).cast("string"), "grade": F.lit(None).cast("int")})
        rows = review.review(findings.validate(self._checked(entries).drop("provenance", "activityContext", "volunteerContext"), self.pack, self.institutions))
        return rows, review.review_batches(rows)

    def verify_semantic_candidate(self, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(candidates, entries, batches) with verdicts."""
        rows = semantic.verify(candidates, self.pack)
        entries = semantic.entry_results(rows)
        return rows, entries, semantic.batch_results(entries)

    def search_record_guidance(self, query: str, limit: int = S.DEFAULT_LIMIT, source_ids: list[str] | None = None, roles: list[str] | None = None) -> DataFrame:
        prepared = search.prepare(self.chunks.join(self.active.select(F.col("chunkId").alias("id")), "id", "left_semi"))
        return search.search(prepared, query, limit, source_ids=source_ids, roles=roles, sources=self.sources)

    def get_source_excerpt(self, chunk_id: str) -> DataFrame:
        return evidence.source_excerpt(chunk_id, self.chunks, self.active, self.sources)

    def explain_record_rule(self, rule_id: str) -> dict:
        return evidence.explain_rule(self.pack, rule_id)

    def list_record_fields(self, spark) -> DataFrame:
        return self.pack.fields_table(spark)

    def rule_pack_info(self) -> dict:
        """What identifies the pack; of a loaded bundle with its sources and hashes."""
        return (self.info or {}) | {"rulePackId": self.pack.id, "defaultProfile": self.pack.default_profile, "fields": len(self.pack.fields), "rules": len(self.pack.rules), "evidence": len(self.pack.evidence), "catalogVersion": review.catalog_version(self.pack)}


# --- settings of a service that hosts the tools -----------------------------------------------------------------


def parse_port(value: str | None, default: int = 3000) -> int:
    if value is None or value == "":
        return default
    if not re.fullmatch(r"\d+", value) or not 1 <= int(value) <= 65535:
        raise InputError("port must be an integer from 1 to 65535")
    return int(value)


def parse_boolean(value: str | None) -> bool:
    if value in (None, "", "false", "0"):
        return False
    if value in ("true", "1"):
        return True
    raise InputError("boolean must be true or false")


def parse_hosts(value: str | None) -> list[str] | None:
    hosts = [h.strip() for h in (value or "").split(",") if h.strip()]
    return hosts or None


def parse_token(value: str | None) -> str | None:
    if not value:
        return None
    if len(value) < 32:
        raise InputError("token must have at least 32 characters")
    return value


def parse_toolset(value: str | None) -> str:
    if value in (None, "", "teacher"):
        return "teacher"
    if value == "expert":
        return "expert"
    raise InputError("toolset must be teacher or expert")


TEACHER_TOOLS = ("check_school_record", "verify_semantic_candidate")
EXPERT_TOOLS = (*TEACHER_TOOLS, "validate_record_text", "validate_record_batch", "search_record_guidance", "get_source_excerpt", "explain_record_rule", "list_record_fields", "rule_pack_info")
