"""dbt artifacts: models with what they read, warehouse schemas, tests as constraints."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from bagwright.operators.writes import Constraint
from bagwright.plans.bundle import Bundle
from bagwright.sources import dialect as D
from bagwright.sources import types

#: Versions of the artifacts' schemas that are read.
MANIFESTS, CATALOGS = ("v10", "v11", "v12"), ("v0", "v1")


class ArtifactError(ValueError):
    pass


@dataclass
class Project:
    adapter: str
    models: dict[str, str] = field(default_factory=dict)
    depends: dict[str, list[str]] = field(default_factory=dict)
    constraints: dict[str, list[Constraint]] = field(default_factory=dict)
    schemas: dict[str, T.StructType] = field(default_factory=dict)

    def bundle(self, spark: SparkSession) -> Bundle:
        return Bundle(spark, [(name, D.to_spark(sql, self.adapter)) for name, sql in self.models.items()])


def _version(doc: dict, allowed: tuple[str, ...]) -> None:
    url = doc.get("metadata", {}).get("dbt_schema_version", "")
    version = url.rstrip("/").rsplit("/", 1)[-1].removesuffix(".json")
    if version not in allowed:
        raise ArtifactError(f"schema version {version or 'missing'}; {', '.join(allowed)} are read")


def _relation(node: dict) -> str:
    if node.get("relation_name"):
        return node["relation_name"].replace('"', "").replace("`", "")
    return ".".join(x for x in (node.get("database"), node.get("schema"), node.get("alias") or node.get("identifier") or node["name"]) if x)


def _schema(node: dict) -> T.StructType | None:
    columns = node.get("columns") or {}
    if not columns or any(not (c.get("data_type") or c.get("type")) for c in columns.values()):
        return None
    ordered = sorted(columns.values(), key=lambda c: c.get("index", 0))
    return T.StructType([T.StructField(c["name"], types.parse(c.get("data_type") or c["type"])) for c in ordered])


def read_manifest(text: str) -> Project:
    """Models, sources and tests of manifest.json."""
    doc = json.loads(text)
    _version(doc, MANIFESTS)
    project = Project(doc["metadata"].get("adapter_type", "generic"))
    nodes = {**doc.get("nodes", {}), **doc.get("sources", {})}
    names = {key: _relation(n) for key, n in nodes.items() if n.get("resource_type") in ("model", "seed", "snapshot", "source")}
    for key, n in nodes.items():
        if key in names and (schema := _schema(n)):
            project.schemas[names[key]] = schema
        if n.get("resource_type") == "model" and n.get("language", "sql") == "sql":
            code = n.get("compiled_code") or n.get("compiled_sql") or n.get("raw_code") or ""
            project.models[names[key]] = code
            project.depends[names[key]] = [names[d] for d in n.get("depends_on", {}).get("nodes", []) if d in names]
        if key in names:
            for c in n.get("constraints") or []:
                _declared(project, names[key], c, c.get("columns") or [])
            for col in (n.get("columns") or {}).values():
                for c in col.get("constraints") or []:
                    _declared(project, names[key], c, [col["name"]])
    for n in nodes.values():
        if n.get("resource_type") == "test":
            _test(project, n, names)
    return project


def _put(project: Project, relation: str, constraint: Constraint) -> None:
    project.constraints.setdefault(relation, []).append(constraint)


def _declared(project: Project, relation: str, c: dict, columns: list[str]) -> None:
    kind = c["type"]
    if kind in ("not_null", "unique", "primary_key"):
        _put(project, relation, Constraint(kind, tuple(columns)))
    elif kind == "check" and c.get("expression"):
        _put(project, relation, Constraint("check", check=c["expression"]))
    elif kind == "foreign_key" and c.get("to"):
        _put(project, relation, Constraint("foreign_key", tuple(columns), c["to"].replace('"', ""), tuple(c.get("to_columns") or ())))


def _test(project: Project, n: dict, names: dict[str, str]) -> None:
    meta = n.get("test_metadata") or {}
    args = meta.get("kwargs") or {}
    config = n.get("config") or {}
    if config.get("where") or not config.get("enabled", True):
        return  # holds for some rows only
    owner = n.get("attached_node")
    reads = [d for d in n.get("depends_on", {}).get("nodes", []) if d in names]
    relation = names.get(owner) or (names[reads[-1]] if reads else None)
    column = args.get("column_name") or n.get("column_name")
    if relation is None or column is None:
        return
    if meta.get("name") in ("not_null", "unique"):
        _put(project, relation, Constraint(meta["name"], (column,)))
    elif meta.get("name") == "accepted_values":
        _put(project, relation, Constraint("accepted_values", (column,), values=tuple(args.get("values", ()))))
    elif meta.get("name") == "relationships":
        parent = next((names[d] for d in reads if names[d] != relation), None)
        if parent:
            _put(project, relation, Constraint("foreign_key", (column,), parent, (args["field"],)))


def read_catalog(text: str) -> dict[str, T.StructType]:
    """Warehouse schemas of catalog.json by relation."""
    doc = json.loads(text)
    _version(doc, CATALOGS)
    out = {}
    for n in {**doc.get("nodes", {}), **doc.get("sources", {})}.values():
        meta = n["metadata"]
        name = ".".join(x for x in (meta.get("database"), meta.get("schema"), meta["name"]) if x)
        if schema := _schema({"columns": n.get("columns", {})}):
            out[name] = schema
    return out


def read(manifest: str | Path, catalog: str | Path | None = None) -> Project:
    """A project's artifacts; catalog.json beside the manifest is used by itself, and outweighs declared types."""
    manifest = Path(manifest)
    project = read_manifest(manifest.read_text())
    catalog = Path(catalog) if catalog else manifest.with_name("catalog.json")
    if catalog.exists():
        project.schemas |= read_catalog(catalog.read_text())
    return project
