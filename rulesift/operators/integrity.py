"""Integrity checks. Each gives the rows that violate it, so that a sound bundle gives empty tables.

``report`` runs a bundle's checks in their order and names the first failure of each; ``first_failure`` stops at the
first, as a start-up gate does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.errors import BundleError
from rulesift.functions import patterns as gate
from rulesift.functions.text import normalize_search, sha256_upper
from rulesift.operators.contain import meet
from rulesift.plans.rulepack import RulePack

# The schools that a scope stands for, and the files of a sealed bundle by role.
SCOPES = {"elementary": ("elementary",), "common": ("elementary", "middle", "high")}
#: Quotes that are broadcast at once, and files of a seal.
MAX_QUOTES, MAX_FILES = 20_000, 10_000


# --- generic checks ---------------------------------------------------------------------------------------------


def dangling(left: DataFrame, key: str, right: DataFrame, to: str) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``; a null key refers to nothing and counts."""
    keys = right.select(F.col(to).alias("__to"))
    return left.join(keys, F.col(key) == F.col("__to"), "left_anti")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """id, n: values that occur more than once."""
    return df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def differing(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, columns: rows of both sides that differ, nulls being equal, and in what."""
    other = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = left.join(other, key)
    odd = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in columns]), lambda x: x.isNotNull())
    return both.select(key, odd.alias("columns")).where(F.size("columns") > 0)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def quotes_contained(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, n_passages: passages (s) that contain each quote (q); no passage contains an empty quote.

    The quotes are a stated set (excerpts that people checked); passages meet them by grams (see ``contain``), whatever
    their length and script. Up to ``MAX_QUOTES`` are broadcast and passages are read once; more go in blocks.
    """
    met = meet(passages.select("s"), "s", quotes.select("item_id", F.col("q").alias("needle")), MAX_QUOTES)
    hits = met.groupBy("item_id").agg(F.count("*").alias("n"))
    return quotes.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_passages"))


def content_seal(files: DataFrame) -> DataFrame:
    """seal, files: the hash of all ``path NUL sha LF`` in the order of paths. A bundle has a handful of files; more than ``MAX_FILES`` are an error, as all lines are one text."""
    lines = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    rolled = files.agg(lines.alias("x"), F.count("*").alias("files"))
    within = F.when(F.col("files") > MAX_FILES, F.raise_error(F.lit("too many files to seal")))
    return rolled.select(F.coalesce(within, sha256_upper(F.array_join(F.transform("x", lambda f: F.concat(f["path"], F.lit("\0"), f["sha256"], F.lit("\n"))), ""))).alias("seal"), "files")


# --- the checks of a bundle -------------------------------------------------------------------------------------


@dataclass
class Bundle:
    """Tables of one sealed data set (see ``rulesift.schemas``) and its rule pack."""

    sources: DataFrame
    documents: DataFrame
    chunks: DataFrame
    active: DataFrame
    evidence: DataFrame
    pack: RulePack
    manifest_files: DataFrame | None = None  # path, sha256 as declared
    actual_files: DataFrame | None = None  # path, sha256 as read
    declared_seal: str | None = None
    corpus_counts: tuple[int, int] | None = None  # documents, chunks as declared
    corpus_hashes: DataFrame | None = None  # path, declared, actual


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("id"))


def _literal(bundle: Bundle, ids: list[str]) -> DataFrame:
    spark = bundle.sources.sparkSession
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _pack_repeats(b: Bundle) -> list[str]:
    from collections import Counter

    found = [k for k, n in Counter(r.id for r in b.pack.rules).items() if n > 1]
    if not b.pack.field_keys:  # those of a file are unique
        found += [k for k, n in Counter(f.key for f in b.pack.fields).items() if n > 1]
    return found


def _inner_repeats(b: Bundle) -> list[str]:
    """Fields that cite an excerpt twice, rules that list a field, a conflict or an outcome twice."""
    lists = [(f.key, [f.evidence]) for f in b.pack.fields] + [(r.id, [r.applies_to or (), r.conflicts, r.outcomes]) for r in b.pack.rules]
    return [i for i, values in lists if any(len(set(v)) < len(v) for v in values)]


def _authority_separation(b: Bundle) -> list[str]:
    odd = []
    for r in b.pack.rules:
        if r.editorial and (r.evidence or not r.local_policy or r.profile != "official_plus_editorial"):
            odd.append(r.id)
        if not r.editorial and (not r.evidence or r.local_policy):
            odd.append(r.id)
    return odd


def _length_fields(b: Bundle) -> list[str]:
    odd, rules = [], {r.id: r for r in b.pack.rules if r.kind == "length"}
    for f in b.pack.fields:
        r = rules.get(f.length_rule or "")
        if f.length_kind == "system-range":
            if f.length_rule:
                odd.append(f.key)
        elif r is None or r.field != f.key or r.max_bytes != f.max_bytes or tuple(r.evidence) != tuple(f.evidence) or r.applies_to != (f.key,):
            odd.append(f.key)
    used = [f.length_rule for f in b.pack.fields if f.length_rule]
    return odd + [i for i in rules if used.count(i) != 1]


def _unsafe(b: Bundle) -> list[str]:
    return [r.id for r in b.pack.rules for p in r.patterns if not r.literal and gate.problem(p)]


def _semantic(b: Bundle) -> list[str]:
    odd = []
    for r in b.pack.phrases():
        if r.semantic and (not r.semantic.concept or not r.semantic.confirm or any(gate.problem(p) for p in (*r.semantic.confirm, *r.semantic.support))):
            odd.append(r.id)
    return odd


def _school_scope(b: Bundle) -> DataFrame:
    return _ids(b.sources.where(~F.array_contains("schoolLevels", "elementary")), "id")


def _documents_of_sources(b: Bundle) -> DataFrame:
    a = dangling(b.documents, "sourceId", b.sources.select("id"), "id")
    c = dangling(b.sources.select(F.col("id").alias("key")), "key", b.documents.select("sourceId"), "sourceId")
    return _ids(a, "sourceId").unionByName(_ids(c, "key"))


def _document_metadata(b: Bundle) -> DataFrame:
    columns = ["title", "role", "format", "authority", "schoolLevels", "sourceSha256", "sourceUrl", "snapshotName"]
    declared = b.sources.select(F.col("id").alias("sourceId"), "title", "role", "format", "authority", "schoolLevels", F.col("sha256").alias("sourceSha256"), "sourceUrl", "snapshotName")
    return _ids(differing(b.documents.select("sourceId", *columns), declared, "sourceId", columns), "sourceId")


def _chunk_metadata(b: Bundle) -> DataFrame:
    dim = b.sources.select(F.col("id").alias("__s"), F.col("authority").alias("__a"), F.col("schoolLevels").alias("__l"))
    odd = b.chunks.join(dim, F.col("sourceId") == F.col("__s")).where(~(F.col("authority").eqNullSafe(F.col("__a")) & F.col("schoolLevels").eqNullSafe(F.col("__l"))))
    return _ids(odd, "id")


def _inclusion(b: Bundle) -> DataFrame:
    n = b.chunks.groupBy("sourceId").agg(F.count("*").alias("n"))
    joined = b.documents.join(n, "sourceId", "left").withColumn("has", F.coalesce("n", F.lit(0)) > 0)
    return _ids(joined.where((F.col("includedInChunks") != F.col("has")) | ((F.col("role") == "verification-copy") == F.col("has"))), "sourceId")


def _active_rows(b: Bundle) -> DataFrame:
    return b.active.join(b.chunks.select(F.col("id").alias("chunkId"), "text", "searchText", "schoolLevels"), "chunkId")


def _scope(b: Bundle) -> DataFrame:
    wanted = F.when(F.col("scope") == "elementary", F.array(*map(F.lit, SCOPES["elementary"]))).when(F.col("scope") == "common", F.array(*map(F.lit, SCOPES["common"])))
    return _ids(_active_rows(b).where(~F.coalesce(same_set(F.col("schoolLevels"), wanted), F.lit(False))), "chunkId")


def _quotes(b: Bundle) -> DataFrame:
    both = b.evidence.join(b.chunks.select(F.col("id").alias("chunkId"), "text"), "chunkId")
    q, t = normalize_search(F.col("quote")), normalize_search(F.col("text"))
    rows = both.select("id", q.alias("q"), t.alias("t"))
    return _ids(rows.where((F.col("q") == "") | ~F.contains("t", "q")), "id")


def _seal(b: Bundle) -> DataFrame:
    sealed = content_seal(b.actual_files)
    return sealed.where(F.col("seal") != F.lit(b.declared_seal)).select(F.lit("bundle").alias("id"))


def _counts(b: Bundle) -> DataFrame:
    n = b.documents.agg(F.count("*").alias("d")).select("d", F.lit(1).alias("k")).join(b.chunks.agg(F.count("*").alias("c")).select("c", F.lit(1).alias("k")), "k")
    return n.where((F.col("d") != b.corpus_counts[0]) | (F.col("c") != b.corpus_counts[1])).select(F.lit("corpus").alias("id"))


def _repeats(b: Bundle) -> DataFrame:
    keyed = [_ids(b.sources, "id"), _ids(b.sources, "snapshotName"), _ids(b.documents, "sourceId"), _ids(b.chunks, "id"), _ids(b.active, "chunkId"), _ids(b.evidence, "id")]
    out = _literal(b, _pack_repeats(b))
    for i, k in enumerate(keyed):
        out = out.unionByName(repeated(k.withColumn("id", F.concat(F.lit(f"{i}:"), "id")), "id").select("id"))
    return out


def _conflict_reference(b: Bundle) -> list[str]:
    return [r.id for r in b.pack.rules for o in r.conflicts if o == r.id or o not in b.pack.rule]


def _conflict_symmetry(b: Bundle) -> list[str]:
    return [r.id for r in b.pack.rules for o in r.conflicts if o in b.pack.rule and r.id not in b.pack.rule[o].conflicts]


def _evidence_reference(b: Bundle) -> DataFrame:
    spark = b.sources.sparkSession
    cited = [(x.key, e) for x in b.pack.fields for e in x.evidence] + [(r.id, e) for r in b.pack.rules if not r.editorial for e in r.evidence]
    return dangling(spark.createDataFrame(cited, "id string, e string"), "e", b.evidence.select(F.col("id").alias("__e")), "__e").select("id")


def _field_reference(b: Bundle) -> list[str]:
    """Fields that are listed under another key than their own, and rules for fields that there are not."""
    odd = [f.key for k, f in zip(b.pack.field_keys, b.pack.fields, strict=True) if k != f.key] if b.pack.field_keys else []
    return odd + [r.id for r in b.pack.rules for f in (r.applies_to or ()) if f not in b.pack.field_of]


#: (kind, path, violations) in the order of a start-up; a violations function gives a table of ids or a list of them.
CHECKS: list[tuple[str, str, Callable[[Bundle], DataFrame | list[str] | None]]] = [
    ("bundle-file-set", "manifest", lambda b: b.manifest_files and same_rows(b.manifest_files.select("path"), b.actual_files.select("path")).select(F.col("path").alias("id"))),
    ("bundle-file-hash", "manifest", lambda b: b.manifest_files and _ids(differing(b.manifest_files, b.actual_files, "path", ["sha256"]), "path")),
    ("bundle-content-hash", "manifest", lambda b: b.declared_seal and _seal(b)),
    ("rule-authority-separation", "rules", _authority_separation),
    ("duplicate-id", "bundle", _repeats),
    ("corpus-file-hash", "corpus", lambda b: b.corpus_hashes and _ids(b.corpus_hashes.where(~F.col("declared").eqNullSafe(F.col("actual"))), "path")),
    ("corpus-count", "corpus", lambda b: b.corpus_counts and _counts(b)),
    ("source-school-scope", "sources", _school_scope),
    ("source-document-reference", "documents", _documents_of_sources),
    ("source-document-metadata", "documents", _document_metadata),
    ("source-chunk-reference", "chunks", lambda b: _ids(dangling(b.chunks, "sourceId", b.sources.select(F.col("id").alias("__s")), "__s"), "id")),
    ("source-chunk-metadata", "chunks", _chunk_metadata),
    ("chunk-text-hash", "chunks", lambda b: _ids(b.chunks.where(~sha256_upper(F.col("text")).eqNullSafe(F.col("textSha256"))), "id")),
    ("chunk-search-text", "chunks", lambda b: _ids(b.chunks.withColumn("__n", normalize_search(F.col("text"))).where(~F.col("__n").eqNullSafe(F.col("searchText"))), "id")),
    ("document-chunk-inclusion", "documents", _inclusion),
    ("active-chunk-reference", "active", lambda b: _ids(dangling(b.active, "chunkId", b.chunks.select("id"), "id"), "chunkId")),
    ("active-chunk-empty", "active", lambda b: _ids(_active_rows(b).where((F.trim("text") == "") | (F.trim("searchText") == "")), "chunkId")),
    ("active-chunk-scope", "active", _scope),
    ("evidence-active-reference", "evidence", lambda b: _ids(dangling(b.evidence, "chunkId", b.active.select(F.col("chunkId").alias("__c")), "__c"), "id")),
    ("evidence-quote-hash", "evidence", lambda b: _ids(b.evidence.where(~sha256_upper(F.col("quote")).eqNullSafe(F.col("quoteSha256"))), "id")),
    ("evidence-quote-containment", "evidence", _quotes),
    ("rule-field-reference", "rules", _field_reference),
    ("duplicate-id", "rules", _inner_repeats),
    ("rule-evidence-reference", "rules", _evidence_reference),
    ("rule-conflict-reference", "rules", _conflict_reference),
    ("rule-conflict-symmetry", "rules", _conflict_symmetry),
    ("length-rule-field", "rules", _length_fields),
    ("unsafe-regex", "rules", _unsafe),
]
#: Not part of a start-up.
OPTIONAL = [("semantic-rule-metadata", "rules", _semantic)]


def violations(bundle: Bundle, optional: bool = False) -> Iterator[tuple[str, str, list[str]]]:
    """kind, path and up to five ids of each check that fails, one check after the other."""
    for kind, path, check in CHECKS + (OPTIONAL if optional else []):
        found = check(bundle)
        if found is None or (isinstance(found, list) and not found):
            continue
        ids = found[:5] if isinstance(found, list) else [r["id"] for r in found.limit(5).collect()]
        if ids:
            yield kind, path, ids


def report(bundle: Bundle, optional: bool = False) -> list[tuple[str, str, list[str]]]:
    return list(violations(bundle, optional))


def require_sound(bundle: Bundle) -> None:
    """Raise for the first check that fails."""
    for kind, path, _ in violations(bundle):
        raise BundleError(kind, path)
