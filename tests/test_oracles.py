"""Every registered relational query against an independent engine."""

import pytest

from bagwright import queries
from tests.conftest import bag, table

queries.load_all()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    expected = duck.sql(queries.ORACLES[name])
    assert bag(df) == table(expected.columns, expected.fetchall())
    kinds = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds


def test_queries_without_sql_are_few(spark, data):
    rest = sorted(set(queries.QUERIES) - set(queries.ORACLES))
    assert rest == ["sample_bernoulli"]
    a, b = (queries.QUERIES["sample_bernoulli"](spark, data).collect() for _ in range(2))
    assert a == b and 0 < len(a) < 200


@pytest.mark.parametrize("name", ["join_full", "join_full_using", "join_inner", "join_left", "join_natural", "join_nullsafe", "join_using", "join_right"])
def test_pairs_of_few_keys_are_made_by_many_tasks(spark, data, name):
    assert queries.QUERIES[name](spark, data).rdd.getNumPartitions() >= 64
