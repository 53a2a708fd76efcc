"""Reading bundles: bytes, JSON and JSONL documents with closed schemas, verified source files."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rulesift import schemas as S
from rulesift.errors import BundleError
from rulesift.sources.layout import Layout, columns, document, layout_of, lines, parsed, problem
from rulesift.sources.layout import many as some


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, content, sha256 (upper hex) of files; unreadable paths raise ``data-read``."""
    try:
        files = spark.read.format("binaryFile").load(path)
        files.limit(1).collect()
    except Exception as e:
        raise BundleError("data-read", path) from e
    return files.select("path", "content", F.upper(F.sha2("content", 256)).alias("sha256"))


def parse_rows(rows: DataFrame, ddl: str, path: str, column: str = "value", required: tuple[str, ...] = (), layout: Layout | None = None) -> DataFrame:
    """JSON objects of a column as columns.

    Unparseable rows raise ``json-syntax``. Rows of another layout raise ``schema``; without a ``layout`` it is that of the
    column types: unknown keys at any level, values of another type and missing ``required`` ones are refused.
    """
    got = rows.select(parsed(F.col(column)).alias("v"))
    wrong = problem(got, layout or layout_of(StructType.fromDDL(ddl), required)).first()["problem"] if not rows.isEmpty() else None
    if wrong:
        raise BundleError(wrong, path)
    return columns(got, S.nested(ddl))


def read_json(spark: SparkSession, path: str, ddl: str, many: bool = True, layout: Layout | None = None) -> DataFrame:
    """A JSON document: an array of objects (``many``) or one object; ``layout`` is that of an object."""
    whole = document(spark, path)
    objects = layout or layout_of(StructType.fromDDL(ddl))
    wrong = problem(whole, some(objects) if many else objects).first()["problem"]
    if wrong:
        raise BundleError(wrong, path)
    return columns(whole.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v")) if many else whole, S.nested(ddl))


def read_jsonl(spark: SparkSession, path: str, ddl: str, layout: Layout | None = None) -> DataFrame:
    """One object a line; empty files and blank lines raise ``json-lines``."""
    rows = lines(spark, path)
    wrong = problem(rows, layout or layout_of(StructType.fromDDL(ddl)), by_line=True).first()["problem"]
    if wrong:
        raise BundleError(wrong, path)
    return columns(rows, S.nested(ddl))


def contained(relative: str) -> str:
    """A path that stays inside its folder, with forward slashes; others are refused."""
    plain = relative.replace("\\", "/")
    clean = posixpath.normpath(plain)
    if not plain or plain.startswith("/") or re.match(r"[A-Za-z]:", plain) or clean == ".." or clean.startswith("../"):
        raise ValueError("path leaves its folder")
    return clean


def verified_sources(spark: SparkSession, sources: DataFrame, folder: str) -> DataFrame:
    """id, format, path, content, sizeBytes, sha256 of each listed file whose hash is as declared; a difference raises ``source-hash``."""
    listed = [(r["id"], r["format"], f"{folder}/{contained(r['relativeInputPath'])}", r["sha256"]) for r in sources.select("id", "format", "relativeInputPath", "sha256").collect()]  # a manifest lists a handful of files
    out = None
    for i, kind, path, sha in listed:
        one = read_bytes(spark, path).select(F.lit(i).alias("id"), F.lit(kind).alias("format"), "path", "content", F.length("content").alias("sizeBytes"), "sha256", F.lit(sha).alias("declared"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise BundleError("source-set", folder)
    bad = out.where("sha256 <> declared").select("id").limit(1).collect()
    if bad:
        raise BundleError("source-hash", bad[0]["id"])
    return out.drop("declared")
