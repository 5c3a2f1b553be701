"""Facts about queries, as tables."""

from pyspark.sql import functions as F

from bagwright.plans import facts, witness
from bagwright.queries import query


def _view(t):
    t.orders.createOrReplaceTempView("_bw_fo")
    t.customer.createOrReplaceTempView("_bw_fc")
    return t.values(
        "SELECT c_mktsegment AS seg, o_totalprice * 2 + 1 AS twice, CASE WHEN o_custkey > 5 THEN 'a' ELSE 'b' END AS grp FROM _bw_fo JOIN _bw_fc ON o_custkey = c_custkey"
        " WHERE o_custkey BETWEEN 3 AND 40 AND o_orderstatus IN ('F', 'O') AND c_mktsegment LIKE 'B%' AND c_nationkey <> 7"
    )


@query("facts_lineage", "SELECT * FROM (VALUES ('seg', '_bw_fc', 'c_mktsegment'), ('twice', '_bw_fo', 'o_totalprice'), ('grp', '_bw_fo', 'o_custkey')) v(output, relation, \"column\")")
def _(t):
    return facts.lineage(_view(t))


@query("facts_domains", "SELECT * FROM (VALUES ('_bw_fc', 'c_mktsegment', '[B, C)', FALSE), ('_bw_fc', 'c_nationkey', 'exclude 7', FALSE), ('_bw_fo', 'o_custkey', '[3, 40]', FALSE), ('_bw_fo', 'o_orderstatus', 'include F, O', FALSE)) v(relation, \"column\", domain, nulls)")
def _(t):
    return facts.domains(_view(t))


@query(
    "facts_observed",
    "SELECT 'p_size' AS \"column\", count(p_size) AS known, count(*) - count(p_size) AS nulls, count(DISTINCT p_size) AS distinct_values, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS greatest FROM part UNION ALL "
    "SELECT 's', count(s), count(*) - count(s), count(DISTINCT s), min(s)::DOUBLE, max(s)::DOUBLE FROM (SELECT nullif(p_size % 10, 0) AS s FROM part)",
)
def _(t):
    return facts.observed(t.part.select("p_size", F.expr("nullif(p_size % 10, 0)").alias("s")), ["p_size", "s"])


def _case(name: str, obligation: str, rows: str, condition: str, example: str) -> str:
    return f"SELECT '{name}' AS \"case\", '{obligation}' AS obligation, count(*) AS n, min({example}::VARCHAR) AS example FROM {rows} WHERE {condition}"


_A = "(SELECT c_custkey, nullif(c_nationkey % 6, 0) AS k FROM customer)"
_B = "(SELECT nullif(s_nationkey % 6, 1) AS k2 FROM supplier)"


def _ab(t):
    a = t.customer.select("c_custkey", F.expr("nullif(c_nationkey % 6, 0)").alias("k"))
    return a, t.supplier.select(F.expr("nullif(s_nationkey % 6, 1)").alias("k2"))


@query(
    "witness_join",
    " UNION ALL ".join(
        [
            _case("matched", "left.k = right.k2 for some right row", _A, f"k IN (SELECT k2 FROM {_B} WHERE k2 IS NOT NULL)", "c_custkey"),
            _case("unmatched", "left.k <> right.k2 for every right row", _A, f"k NOT IN (SELECT k2 FROM {_B} WHERE k2 IS NOT NULL)", "c_custkey"),
            _case("null_key", "left.k IS NULL", _A, "k IS NULL", "c_custkey"),
        ]
    ),
)
def _(t):
    return witness.join_cases(*_ab(t), "k", "k2", "c_custkey")


_G = "(SELECT o_custkey, max(nullif(o_orderkey % 5, 0)) AS value FROM orders GROUP BY o_custkey)"


@query("witness_group", " UNION ALL ".join([_case("qualifying", "value > 3", _G, "value > 3", "o_custkey"), _case("rejected", "NOT (value > 3)", _G, "value <= 3", "o_custkey"), _case("unknown", "(value > 3) IS UNKNOWN", _G, "value IS NULL", "o_custkey")]))
def _(t):
    return witness.group_cases(t.orders, "o_custkey", F.max(F.expr("nullif(o_orderkey % 5, 0)")), "value > 3")


_R = "(SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey) AS n FROM orders)"


@query("witness_rank", " UNION ALL ".join([_case("kept", "rank <= 2 and row number <= 2", _R, "r <= 2 AND n <= 2", "o_orderkey"), _case("tied", "rank <= 2 < row number", _R, "r <= 2 AND n > 2", "o_orderkey"), _case("dropped", "rank > 2", _R, "r > 2", "o_orderkey")]).replace("min(o_orderkey", "min(o_custkey"))
def _(t):
    return witness.rank_cases(t.orders, ["o_custkey"], [F.col("o_orderkey") % 3], 2, "o_custkey")


@query(
    "witness_membership",
    " UNION ALL ".join(
        [
            _case("member", "k = k2 for some inner row", _A, f"(k IN (SELECT k2 FROM {_B})) IS TRUE", "c_custkey"),
            _case("no_member", "comparison FALSE with every inner row", _A, f"(k IN (SELECT k2 FROM {_B})) IS FALSE", "c_custkey"),
            _case("unknown", "no comparison TRUE and one UNKNOWN", _A, f"(k IN (SELECT k2 FROM {_B})) IS NULL", "c_custkey"),
        ]
    ),
)
def _(t):
    a, b = _ab(t)
    return witness.membership_cases(a, "k", b, "k2", "c_custkey")
