"""Bundles from SQL texts, files, folders and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from bagwright.plans.bundle import Bundle
from bagwright.sources import dialect as D


class ManifestError(ValueError):
    pass


def find_sql(folder: str | Path) -> list[Path]:
    """All .sql files below a folder, in order of their paths."""
    return sorted(p for p in Path(folder).rglob("*.sql") if p.is_file())


def layers(texts: Iterable[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """(name, Spark SQL) of each statement in (name, text, dialect); several statements of one text are numbered."""
    out = []
    for name, text, kind in texts:
        parts = D.statements(text)
        for i, part in enumerate(parts):
            made, query = D.produced(part)
            out.append((made or (name if len(parts) == 1 else f"{name}_{i + 1}"), D.to_spark(query, kind)))
    return out


def bundle(spark: SparkSession, texts: Iterable[tuple[str, str, str]]) -> Bundle:
    return Bundle(spark, layers(texts))


def from_files(spark: SparkSession, files: Iterable[str | Path], dialect: str = "generic") -> Bundle:
    return bundle(spark, [(Path(f).stem, Path(f).read_text(), dialect) for f in files])


def from_manifest(spark: SparkSession, path: str | Path) -> tuple[Bundle, list[str]]:
    """The bundle of an analysis manifest (version 1) and its targets."""
    path = Path(path)
    doc = json.loads(path.read_text())
    if str(doc.get("manifest_version")) != "1":
        raise ManifestError("manifest_version has to be 1")
    seen: set[str] = set()
    texts = []
    for item in doc.get("inputs", []):
        name = item.get("id")
        if not name or name in seen:
            raise ManifestError(f"input ids have to be there and differ: {name}")
        seen.add(name)
        if ("sql" in item) == ("file" in item):
            raise ManifestError(f"{name}: give sql or file")
        text = item["sql"] if "sql" in item else (path.parent / item["file"]).read_text()
        texts.append((name.replace("-", "_"), text, item.get("dialect", doc.get("dialect", "generic"))))
    targets = list(doc.get("targets", []))
    if doc.get("output_scope") == "targets" and not targets:
        raise ManifestError("output_scope targets needs targets")
    return bundle(spark, texts), targets
