"""Sinks: canonical JSON, JSONL, corpora, sealed manifests, snapshots, texts for people."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from rulesift.errors import BundleError


def canonical(value: object) -> str:
    """Keys sorted at every level, two blanks of indent, a line end."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def to_plain(df: DataFrame, order: list[str]) -> list[dict]:
    """Rows of a small table as dicts without nulls, in order."""

    def plain(x):
        if hasattr(x, "asDict"):
            return {k: plain(v) for k, v in x.asDict().items() if v is not None}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return [plain(r) for r in df.orderBy(*order).collect()]


def _by_key(value: Column, kind: DataType) -> Column:
    """The same value with the fields of its structs sorted by name, at every level."""
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (ArrayType, StructType)):
        return F.transform(value, lambda x: _by_key(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_by_key(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    return value


def json_lines(df: DataFrame) -> DataFrame:
    """value: one compact object a row, keys sorted at every level, nulls left out."""
    return df.select(F.to_json(F.struct(*[_by_key(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)])).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Distributed: one file a partition in a folder, replaced as a whole."""
    json_lines(df).write.mode("overwrite").text(path)


def _replace(path: Path, data: bytes) -> None:
    """Written beside its place, then moved over it."""
    fd, staged = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(staged, path)
    except BaseException:
        Path(staged).unlink(missing_ok=True)
        raise


def write_corpus(documents: DataFrame, chunks: DataFrame, root: str, pack_id: str, source_manifest: bytes) -> dict:
    """documents.json, chunks.jsonl and manifest.json of a small corpus, byte for byte the same for the same rows; all or none are replaced."""
    folder = Path(root)
    folder.mkdir(parents=True, exist_ok=True)
    docs = canonical(to_plain(documents, ["sourceId"])).encode()
    rows = to_plain(chunks, ["id"])
    lines = "".join(json.dumps(r, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n" for r in rows).encode()
    sha = lambda b: hashlib.sha256(b).hexdigest().upper()
    manifest = {"schemaVersion": 1, "packId": pack_id, "sourceManifestSha256": sha(source_manifest), "documentsSha256": sha(docs), "chunksSha256": sha(lines), "documentCount": documents.count(), "chunkCount": len(rows)}
    staged = {"documents.json": docs, "chunks.jsonl": lines, "manifest.json": canonical(manifest).encode()}
    kept = {n: (folder / n).read_bytes() for n in staged if (folder / n).exists()}
    try:
        for name, data in staged.items():
            _replace(folder / name, data)
    except BaseException:
        for name, data in kept.items():
            _replace(folder / name, data)
        raise
    return manifest


def seal(root: str, paths: list[str], pack_id: str) -> dict:
    """Manifest of a bundle's files: hash of each, and of all in the order of paths."""
    files = [{"path": p, "sha256": hashlib.sha256((Path(root) / p).read_bytes()).hexdigest().upper()} for p in sorted(paths)]
    whole = hashlib.sha256("".join(f"{f['path']}\0{f['sha256']}\n" for f in files).encode()).hexdigest().upper()
    manifest = {"schemaVersion": 1, "packId": pack_id, "files": files, "bundleContentSha256": whole}
    _replace(Path(root) / "bundle-manifest.json", canonical(manifest).encode())
    return manifest


def snapshot(source: str, target: str) -> bool:
    """Immutable copy: an equal one stays (False), a different one is a collision."""
    here, there = Path(source), Path(target)
    want = hashlib.sha256(here.read_bytes()).hexdigest()
    if there.exists():
        if hashlib.sha256(there.read_bytes()).hexdigest() != want:
            raise BundleError("snapshot-collision", there.name)
        return False
    there.parent.mkdir(parents=True, exist_ok=True)
    staged = there.with_name(f".{there.name}.part")
    shutil.copyfile(here, staged)
    if hashlib.sha256(staged.read_bytes()).hexdigest() != want:
        staged.unlink()
        raise BundleError("snapshot-copy", there.name)
    os.replace(staged, there)
    return True


def render(df: DataFrame, template: str) -> DataFrame:
    """value: a line for people, ``{column}`` replaced by the column's text (empty for null)."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    columns = [F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for i, p in enumerate(parts) if p]
    return df.select(F.concat(*columns).alias("value"))


def structured(df: DataFrame) -> DataFrame:
    """value: each row as one JSON object, nested columns included."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
