"""The one adapter to Catalyst's plans: parsed and analysed trees as plain Python objects."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Node:
    """A plan or expression node: class name, fields and children."""

    kind: str
    fields: dict
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()


def _read(flat: list[dict], at: int = 0) -> tuple[Node, int]:
    """A tree from its nodes in preorder."""
    head = flat[at]
    node, at = Node(head["class"].rsplit(".", 1)[-1], head), at + 1
    for _ in range(head["num-children"]):
        child, at = _read(flat, at)
        node.children.append(child)
    return node, at


def _tree(plan) -> Node:
    return _read(json.loads(plan.toJSON()))[0]


def analysed(df: DataFrame) -> Node:
    return _tree(df._jdf.queryExecution().analyzed())


def parsed(spark: SparkSession, sql: str) -> Node:
    """The tree of SQL text, before names are looked up."""
    return _tree(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def expression(flat: list[dict]) -> Node:
    return _read(flat)[0]


def expressions(lists: list[list[dict]]) -> list[Node]:
    return [expression(x) for x in lists or []]


def ids(value) -> set[int]:
    """Ids of all attributes in a JSON value."""
    found: set[int] = set()
    if isinstance(value, dict):
        if str(value.get("class", "")).endswith(".AttributeReference"):
            found.add(value["exprId"]["id"])
        for v in value.values():
            found |= ids(v)
    elif isinstance(value, list):
        for v in value:
            found |= ids(v)
    return found


def view_name(node: Node) -> str:
    name = node.fields["desc"]["identifier"]
    return ".".join(x for x in (name.get("catalog"), name.get("database"), name["table"]) if x)
