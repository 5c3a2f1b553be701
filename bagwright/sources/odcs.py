"""Open data contracts (ODCS 3.2, YAML): schemas and constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from bagwright.operators.writes import Constraint
from bagwright.sources import types

try:
    import yaml
except ImportError:  # the parser is optional
    yaml = None

#: Logical types by the Spark type that holds them.
LOGICAL = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "time": "time"}


class ContractError(ValueError):
    pass


@dataclass
class Contract:
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    constraints: dict[str, list[Constraint]] = field(default_factory=dict)


def _type(p: dict) -> T.DataType:
    if p.get("physicalType"):
        return types.parse(p["physicalType"])
    logical = p.get("logicalType")
    if logical == "array":
        return T.ArrayType(_type(p.get("items") or {"logicalType": "string"}))
    if logical == "object":
        return T.StructType([T.StructField(q["name"], _type(q)) for q in p.get("properties", [])])
    if logical in LOGICAL:
        return types.parse(LOGICAL[logical])
    raise ContractError(f"{p.get('name')}: no type")


def read(text: str) -> Contract:
    """Schemas and constraints of the relations in a contract."""
    if yaml is None:
        raise ContractError("reading contracts needs a YAML parser")
    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or doc.get("kind") != "DataContract" or not str(doc.get("apiVersion", "")).startswith("v3."):
        raise ContractError("not a data contract of version 3")
    out = Contract()
    ids: dict[str, tuple[str, str]] = {}
    relations = {}
    for s in doc.get("schema", []):
        name = s.get("physicalName") or s["name"]
        relations[s["name"]] = relations[s.get("id", s["name"])] = name
        for p in s.get("properties", []):
            column = p.get("physicalName") or p["name"]
            ids[f"{s['name']}.{p['name']}"] = (name, column)
            if p.get("id"):
                ids[f"schema/{s.get('id', s['name'])}/properties/{p['id']}"] = (name, column)
    for s in doc.get("schema", []):
        name = s.get("physicalName") or s["name"]
        columns, found, keys = [], [], []
        for p in s.get("properties", []):
            column = p.get("physicalName") or p["name"]
            columns.append(T.StructField(column, _type(p), not p.get("required", False)))
            if p.get("primaryKey"):
                keys.append((p.get("primaryKeyPosition", 1), column))
            elif p.get("required"):
                found.append(Constraint("not_null", (column,)))
            if p.get("unique"):
                found.append(Constraint("unique", (column,)))
            values = _accepted(p)
            if values:
                found.append(Constraint("accepted_values", (column,), values=values))
            for r in p.get("relationships", []):
                found += _foreign([column], r, ids, relations)
        if keys:
            found.insert(0, Constraint("primary_key", tuple(c for _, c in sorted(keys))))
        for r in s.get("relationships", []):
            own = [ids[x][1] if x in ids else x.rsplit(".", 1)[-1] for x in _list(r.get("from"))]
            found += _foreign(own, r, ids, relations)
        out.schemas[name], out.constraints[name] = T.StructType(columns), found
    return out


def _list(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _accepted(p: dict) -> tuple:
    options = p.get("logicalTypeOptions") or {}
    if options.get("enum"):
        return tuple(options["enum"])
    for q in p.get("quality", []):
        if q.get("metric") == "invalidValues" and (q.get("arguments") or {}).get("validValues") and q.get("mustBe", 0) == 0:
            return tuple(q["arguments"]["validValues"])
    return ()


def _foreign(own: list[str], r: dict, ids: dict, relations: dict) -> list[Constraint]:
    if r.get("type", "foreignKey") != "foreignKey":
        return []
    ends = []
    for x in _list(r.get("to")):
        x = x.lstrip("/")
        if x in ids:
            ends.append(ids[x])
        else:
            table, _, column = x.rpartition(".")
            ends.append((relations.get(table, table), column))
    if len(ends) != len(own) or len({t for t, _ in ends}) != 1:
        raise ContractError(f"relationship of {own} is not one key")
    return [Constraint("foreign_key", tuple(own), ends[0][0], tuple(c for _, c in ends))]
