"""Domains, facts, bundles, dialects and metadata documents."""

import json
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from bagwright.plans import domains as D
from bagwright.plans.bundle import Bundle, CycleError, reads
from bagwright.plans.facts import analyse_sql
from bagwright.plans.laws import Counts
from bagwright.sources import dbt, dialect, inputs, odcs, types

VALUES = [Decimal(x) for x in range(-3, 4)]
atom = st.builds(D.Domain.compare, st.sampled_from(["=", "<>", "<", "<=", ">", ">="]), st.sampled_from(VALUES))
tree = st.recursive(atom, lambda x: st.tuples(st.sampled_from(["and", "or"]), x, x), max_leaves=8)


def value(t):
    if isinstance(t, D.Domain):
        return t
    a, b = value(t[1]), value(t[2])
    return a.meet(b) if t[0] == "and" else a.join(b)


def holds(t, v):
    if isinstance(t, D.Domain):
        return v in t
    a, b = holds(t[1], v), holds(t[2], v)
    return a and b if t[0] == "and" else a or b


@given(tree)
@settings(max_examples=300, deadline=None)
def test_domain_algebra_is_membership(t):
    d = value(t)
    for v in [x / 2 for x in range(-8, 9)]:
        assert (Decimal(v) in d) == holds(t, Decimal(v))


def test_domain_kinds_and_affine():
    d = D.Domain.values([Decimal(1), Decimal(2)])
    assert d.kind == "include" and d.affine(Decimal(-2), Decimal(1)).to_json()["values"] == ["-3", "-1"]
    assert D.Domain.compare("<>", Decimal(1)).kind == "exclude"
    assert D.Domain.compare("<", Decimal(1)).meet(D.Domain.compare(">", Decimal(2))).impossible
    assert D.Domain.compare("<", Decimal(1)).meet(D.Domain.compare("<", "x")).kind == "unknown"
    assert "abd" in D.Domain.prefix("ab") and "ac" not in D.Domain.prefix("ab")


@pytest.fixture()
def views(spark):
    spark.createDataFrame([], "id int, amount int, status string, customer_id int").createOrReplaceTempView("ords")
    spark.createDataFrame([], "id int, score int").createOrReplaceTempView("custs")
    return spark


def domain(facts, relation, column):
    return facts.columns[(relation, column)].to_json()


def test_facts_of_filters(views):
    f = analyse_sql(views, "SELECT id, amount * 2 AS d FROM ords WHERE amount BETWEEN 5 AND 9 AND status IN ('a', 'b') AND NOT (id = 3)")
    assert f.exact and not f.impossible
    assert domain(f, "ords", "amount")["ranges"][0] == {"low": "5", "low_inclusive": True, "high": "9", "high_inclusive": True}
    assert domain(f, "ords", "status")["values"] == ["a", "b"]
    assert domain(f, "ords", "id") == {"kind": "exclude", "nulls": False, "values": ["3"]}
    assert f.outputs[1].domain.to_json()["ranges"][0]["low"] == "10"


def test_facts_of_contradiction_and_residue(views):
    assert analyse_sql(views, "SELECT id FROM ords WHERE amount > 5 AND amount < 3").impossible
    assert analyse_sql(views, "SELECT id FROM ords WHERE amount NOT IN (1, NULL)").impossible
    f = analyse_sql(views, "SELECT id FROM ords WHERE amount > 5 OR id < 3")
    assert f.residual == [D.CROSS_COLUMN] and domain(f, "ords", "amount")["kind"] == "unknown"
    assert analyse_sql(views, "SELECT id FROM ords WHERE length(status) > 3").residual == [D.OPAQUE]
    assert analyse_sql(views, "SELECT id FROM ords WHERE 2 * amount + 1 >= 7").columns[("ords", "amount")].to_json()["ranges"][0]["low"] == "3"
    f = analyse_sql(views, "SELECT id FROM ords WHERE amount IS NULL")
    assert f.columns[("ords", "amount")] == D.NULL


def test_facts_of_joins_and_aggregates(views):
    f = analyse_sql(views, "SELECT c.id, count(*) AS n, max(o.amount) AS m FROM ords o LEFT JOIN custs c ON o.customer_id = c.id GROUP BY c.id")
    assert f.joins == [{"kind": "LeftOuter", "keys": [[["ords.customer_id"], ["custs.id"]]]}]
    assert f.aggregated and f.outputs[1].domain.to_json()["ranges"][0]["low"] == "0"
    assert f.outputs[2].sources == {("ords", "amount")} and f.outputs[0].domain.nulls
    u = analyse_sql(views, "SELECT id FROM ords UNION ALL SELECT score FROM custs")
    assert u.outputs[0].sources == {("ords", "id"), ("custs", "score")}
    w = analyse_sql(views, "SELECT row_number() OVER (ORDER BY id) AS r FROM ords")
    assert w.outputs[0].domain.to_json()["ranges"][0]["low"] == "1"


LAYERS = [("mart", "SELECT cid, sum(amount) AS total FROM stage WHERE amount > 3 GROUP BY cid"), ("stage", "WITH x AS (SELECT * FROM ords) SELECT customer_id AS cid, amount FROM x WHERE amount < 10"), ("other", "SELECT id FROM custs")]


def test_bundle(views):
    b = Bundle(views, LAYERS)
    assert b.order() == ["stage", "mart", "other"] and b.outcomes() == ["mart", "other"]
    assert {(e["producer"], e["consumer"], e["status"]) for e in b.edges()} == {("stage", "mart", "Resolved"), ("ords", "stage", "External"), ("custs", "other", "External")}
    facts = b.facts()
    assert facts["mart"].outputs[1].sources == {("ords", "amount")}
    assert facts["mart"].columns[("ords", "amount")].to_json()["ranges"] == [{"low": "3", "low_inclusive": False, "high": "10", "high_inclusive": False}]
    assert list(b.select(["mart"]).layers) == ["mart", "stage"]
    event = b.select(["mart"]).openlineage("ns", "2024-01-01T00:00:00Z")[-1]
    assert event["outputs"][0]["facets"]["columnLineage"]["fields"]["total"]["inputFields"] == [{"namespace": "ns", "name": "ords", "field": "amount"}]
    assert json.loads(b.to_json()) == json.loads(b.to_json())


def test_bundle_cycle_and_ambiguity(views):
    b = Bundle(views, [("a", "SELECT * FROM b"), ("b", "SELECT * FROM a")])
    assert {e["status"] for e in b.edges()} == {"Cycle"}
    with pytest.raises(CycleError):
        b.order()
    b = Bundle(views, [("a", "SELECT 1 AS x"), ("a", "SELECT 2 AS x"), ("c", "SELECT * FROM a")])
    assert b.edges()[-1]["status"] == "Ambiguous"


def test_qualified_names(views):
    b = Bundle(views, [("wh.stage.o", "SELECT id, amount FROM raw.ords"), ("wh.mart.o", "SELECT id FROM wh.stage.o WHERE amount > 1")])
    assert b.order() == ["wh.stage.o", "wh.mart.o"]
    assert b.facts()["wh.mart.o"].outputs[0].sources == {("ords", "id")}


def test_reads(spark):
    assert reads(spark, "WITH a AS (SELECT * FROM x) SELECT * FROM a JOIN s.y ON a.i = y.i") in (["x", "s.y"], ["s.y", "x"])


CASES = [
    ("SELECT TOP 3 id FROM t ORDER BY id", "mssql", [(1,), (2,), (3,)]),
    ("SELECT id FROM t ORDER BY id FETCH FIRST 2 ROWS ONLY", "oracle", [(1,), (2,)]),
    ("SELECT k FROM t ORDER BY k FETCH FIRST 1 ROWS WITH TIES", "postgres", [(0,), (0,)]),
    ("SELECT id FROM t ORDER BY id LIMIT 1, 2", "mysql", [(2,), (3,)]),
    ("SELECT id, k FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1 ORDER BY id", "snowflake", [(2, 0), (4, 1)]),
    ("SELECT DISTINCT ON (k) k, id FROM t ORDER BY k, id", "postgres", [(0, 1), (1, 3)]),
    ("SELECT * EXCLUDE (k) FROM t ORDER BY id", "duckdb", [(1,), (2,), (3,), (4,)]),
    ('SELECT "id" FROM t WHERE "id" > 3', "postgres", [(4,)]),
    ("SELECT SAFE_CAST('x' AS INT) AS v", "bigquery", [(None,)]),
    ("SELECT t.id, x.v FROM t CROSS APPLY (SELECT t.id * 10 AS v) x WHERE t.id = 2", "mssql", [(2, 20)]),
    ("SELECT t.id, x.v FROM t OUTER APPLY (SELECT u.k AS v FROM t u WHERE u.id = t.id + 3) x ORDER BY id", "mssql", [(1, 1), (2, None), (3, None), (4, None)]),
    ("SELECT id FROM t WHERE 'a -- TOP; QUALIFY' = 'a -- TOP; QUALIFY' AND id = 1", "generic", [(1,)]),
]


@pytest.mark.parametrize("sql,kind,rows", CASES)
def test_dialects(spark, sql, kind, rows):
    spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id int, k int").createOrReplaceTempView("t")
    assert [tuple(r) for r in spark.sql(dialect.to_spark(sql, kind)).collect()] == rows


def test_statements():
    assert dialect.statements("SELECT ';'; -- x;\nSELECT 2;") == ["SELECT ';'", "-- x;\nSELECT 2"]
    assert dialect.produced("create or replace view a.b as select 1")[0] == "a.b"
    assert dialect.produced("INSERT INTO x (a) SELECT 1") == ("x", "SELECT 1")


@pytest.mark.parametrize("text,kind", [("BIGINT", T.LongType()), ("numeric(10, 2)", T.DecimalType(10, 2)), ("array<int>", T.ArrayType(T.IntegerType())), ("Nullable(String)", T.StringType()), ("text[]", T.ArrayType(T.StringType())), ("uint64", T.DecimalType(20, 0)), ("timestamp with time zone", T.TimestampType()), ("struct<a int, b array<text>>", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(T.StringType()))])), ("map<text, int>", T.MapType(T.StringType(), T.IntegerType()))])
def test_types(text, kind):
    assert types.parse(text) == kind


def test_bad_types():
    for text in ("decimal(50)", "nonsense"):
        with pytest.raises(types.TypeTextError):
            types.parse(text)


MANIFEST = {
    "metadata": {"dbt_schema_version": "https://schemas.getdbt.com/dbt/manifest/v12.json", "adapter_type": "duckdb"},
    "nodes": {
        "model.p.stage": {"resource_type": "model", "name": "stage", "schema": "m", "compiled_code": "SELECT id, amount FROM raw.ords WHERE amount > 2", "depends_on": {"nodes": ["source.p.raw.ords"]}, "columns": {}},
        "model.p.mart": {"resource_type": "model", "name": "mart", "schema": "m", "compiled_code": "SELECT id FROM m.stage QUALIFY row_number() OVER (ORDER BY amount) = 1", "depends_on": {"nodes": ["model.p.stage"]}},
        "test.p.a": {"resource_type": "test", "attached_node": "model.p.stage", "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}, "depends_on": {"nodes": ["model.p.stage"]}},
        "test.p.b": {"resource_type": "test", "attached_node": "model.p.stage", "test_metadata": {"name": "relationships", "kwargs": {"column_name": "id", "field": "id"}}, "depends_on": {"nodes": ["source.p.raw.ords", "model.p.stage"]}},
    },
    "sources": {"source.p.raw.ords": {"resource_type": "source", "name": "ords", "schema": "raw", "columns": {"id": {"name": "id", "data_type": "bigint"}, "amount": {"name": "amount", "data_type": "integer"}}}},
}


def test_dbt(spark, tmp_path):
    project = dbt.read_manifest(json.dumps(MANIFEST))
    assert project.depends["m.mart"] == ["m.stage"] and project.schemas["raw.ords"]["id"].dataType == T.LongType()
    assert {c.kind for c in project.constraints["m.stage"]} == {"unique", "foreign_key"}
    spark.createDataFrame([], project.schemas["raw.ords"]).createOrReplaceTempView("ords")
    assert project.bundle(spark).facts()["m.mart"].outputs[0].sources == {("ords", "id")}
    with pytest.raises(dbt.ArtifactError):
        dbt.read_manifest(json.dumps({"metadata": {"dbt_schema_version": "x/v3.json"}}))


CONTRACT = """
apiVersion: v3.2.0
kind: DataContract
schema:
  - name: customers
    physicalName: a.customers
    properties:
      - {name: id, logicalType: integer, physicalType: BIGINT, primaryKey: true, required: true}
      - {name: email, logicalType: string, unique: true}
  - name: orders
    properties:
      - {name: cid, logicalType: integer, relationships: [{to: customers.id}]}
      - {name: status, logicalType: string, logicalTypeOptions: {enum: [paid, pending]}}
"""


def test_odcs():
    c = odcs.read(CONTRACT)
    assert c.schemas["a.customers"]["id"].dataType == T.LongType()
    assert [x.kind for x in c.constraints["a.customers"]] == ["primary_key", "unique"]
    fk, accepted = c.constraints["orders"]
    assert (fk.parent, fk.parent_columns) == ("a.customers", ("id",)) and accepted.values == ("paid", "pending")
    with pytest.raises(odcs.ContractError):
        odcs.read("kind: other")


def test_manifest_and_command_line(spark, tmp_path):
    from bagwright.__main__ import main

    spark.createDataFrame([], "id int, amount int").createOrReplaceTempView("ords")
    (tmp_path / "q.sql").write_text("CREATE VIEW mart AS SELECT id FROM stage")
    doc = {"manifest_version": "1", "inputs": [{"id": "one", "sql": "CREATE TABLE stage AS SELECT id FROM ords WHERE amount = 1"}, {"id": "two", "file": "q.sql"}], "targets": ["mart"], "output_scope": "targets"}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    out = json.loads(main(["--manifest", str(tmp_path / "m.json")], spark))
    assert [x["name"] for x in out["layers"]] == ["stage", "mart"] and out["outcomes"] == ["mart"]
    events = json.loads(main(["--format", "openlineage", "--namespace", "n", "SELECT id FROM ords"], spark))
    assert events[0]["inputs"] == [{"namespace": "n", "name": "ords"}]
    with pytest.raises(inputs.ManifestError):
        (tmp_path / "m.json").write_text(json.dumps({**doc, "manifest_version": "2"}))
        inputs.from_manifest(spark, tmp_path / "m.json")


def test_count_laws():
    a, b = Counts(2, 5), Counts(0, 3)
    assert a.union_all(b) == Counts(2, 8) and a.union(b) == Counts(1, 8)
    assert a.intersect_all(b) == Counts(0, 3) and a.except_all(b) == Counts(0, 5)
    assert a.join(b, "left") == Counts(2, 15) and a.join(b, "full") == Counts(2, 15)
    assert a.limit(3, 1) == Counts(1, 3) and a.aggregate() == Counts(1, 1) and Counts(0, None).cross(Counts(0, 0)) == Counts(0, 0)


def test_assumptions(views):
    sql = "SELECT id FROM ords WHERE status = 'x' AND amount > 1"
    assert analyse_sql(views, sql).to_json()["exactness"] == "conditional"
    assert analyse_sql(views, sql, assume=["binary_collation"]).to_json()["exactness"] == "exact"
    assert analyse_sql(views, "SELECT id FROM ords WHERE amount > 1").to_json()["exactness"] == "exact"


@pytest.mark.parametrize(
    "condition,want",
    [
        ("amount > 5 AND amount < 9 AND status = 'x'", (True, True)),
        ("amount BETWEEN 3 AND 4 OR amount = 9", (True, True)),
        ("amount IS NULL", (True, True)),
        ("amount <> 3", (True, True)),
        ("2 * amount + 1 >= 7 AND id IN (4, 5)", (True, True)),
        ("amount > 5 AND amount < 3", (None, None)),
        ("amount > 5 OR id > 3", (None, None)),
    ],
)
def test_witness_rows(views, condition, want):
    from bagwright.plans import witness

    got = witness.check(views, f"SELECT id FROM ords WHERE {condition}")
    assert (got["qualifies"], got["rejected"]) == want


def test_obligations():
    from bagwright.plans.witness import NECESSARY, SUFFICIENT, Obligation

    a, b = Obligation("a > 1", SUFFICIENT), Obligation("b > 1")
    assert a.both(b).strength == SUFFICIENT and a.negated().strength == NECESSARY
    with pytest.raises(ValueError):
        a.either(Obligation("c", NECESSARY))


def test_counts_of_joins_with_open_bounds():
    from bagwright.plans.laws import Counts, write_counts

    none, open_, some = Counts(0, 0), Counts(0, None), Counts(2, 5)
    assert none.join(open_, "left") == Counts(0, 0) and open_.join(none, "left") == Counts(0, None)
    assert open_.join(none, "right") == Counts(0, 0) and none.join(open_, "full") == Counts(0, None)
    assert some.join(open_, "left") == Counts(2, None) and some.join(Counts(1, 3), "full") == Counts(2, 15)
    assert some.join(none, "left") == some and some.join(none, "full") == some
    assert write_counts("insert", some, Counts(1, None)) == {"affected": Counts(1, None), "after": Counts(3, None)}
    assert write_counts("delete", some)["after"] == Counts(0, 5) and write_counts("merge", some, some)["after"] == Counts(0, 10)
