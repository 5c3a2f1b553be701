"""Subqueries, CTEs and views."""

from pyspark.sql import functions as F

from bagwright.operators import subqueries as S
from bagwright.queries import query

OUT = "(SELECT c_custkey, nullif(c_nationkey % 6, 0) AS k, c_custkey % 4 AS g FROM customer)"
INN = "(SELECT s_suppkey, nullif(s_nationkey % 5, 1) AS k, s_suppkey % 4 AS g FROM supplier)"


def outer(t):
    return t.customer.select("c_custkey", F.expr("nullif(c_nationkey % 6, 0)").alias("k"), (F.col("c_custkey") % 4).alias("g"))


def inner(t, null=True):
    k = F.expr("nullif(s_nationkey % 5, 1)")
    df = t.supplier.select("s_suppkey", k.alias("ik"), (F.col("s_suppkey") % 4).alias("ig"))
    return df if null else df.filter("ik IS NOT NULL")


@query("sub_exists", f"SELECT c_custkey FROM {OUT} o WHERE EXISTS (SELECT 1 FROM {INN} i WHERE i.k = o.k AND i.g = o.g)")
def _(t):
    return S.exists(outer(t), inner(t), (F.col("ik") == F.col("k")) & (F.col("ig") == F.col("g"))).select("c_custkey")


@query("sub_not_exists", f"SELECT c_custkey FROM {OUT} o WHERE NOT EXISTS (SELECT 1 FROM {INN} i WHERE i.k = o.k AND i.g = o.g)")
def _(t):
    return S.exists(outer(t), inner(t), (F.col("ik") == F.col("k")) & (F.col("ig") == F.col("g")), negate=True).select("c_custkey")


@query("sub_exists_joined", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = c.c_custkey AND l_quantity > 45)")
def _(t):
    made = t.orders.join(t.lineitem.filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"))
    return S.exists(t.customer, made, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("sub_exists_layers", "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 200000), twice AS (SELECT o_custkey FROM big GROUP BY o_custkey HAVING count(*) >= 2) SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM twice WHERE o_custkey = c_custkey)")
def _(t):
    twice = t.orders.filter("o_totalprice > 200000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return S.exists(t.customer, twice, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


for _neg, _null in ((False, True), (True, True), (False, False), (True, False)):
    _name = f"sub_{'not_' if _neg else ''}in{'' if _null else '_solid'}"
    _where = "" if _null else " WHERE k IS NOT NULL"

    def _in(t, neg=_neg, null=_null):
        df = S.with_in(outer(t), ["k"], inner(t, null), ["ik"])
        return df.filter(~F.col("_in") if neg else F.col("_in")).select("c_custkey")

    query(_name, f"SELECT c_custkey FROM {OUT} WHERE k {'NOT ' if _neg else ''}IN (SELECT k FROM {INN}{_where})")(_in)


@query("sub_in_truth", f"SELECT c_custkey, k IN (SELECT k FROM {INN}) AS _in FROM {OUT}")
def _(t):
    return S.with_in(outer(t), ["k"], inner(t), ["ik"]).select("c_custkey", "_in")


@query("sub_not_in_empty", f"SELECT c_custkey FROM {OUT} WHERE k NOT IN (SELECT k FROM {INN} WHERE s_suppkey < 0)")
def _(t):
    return S.with_in(outer(t), ["k"], inner(t).filter("s_suppkey < 0"), ["ik"]).filter(~F.col("_in")).select("c_custkey")


@query("sub_in_tuple", f"SELECT c_custkey FROM {OUT} o WHERE (k, g) IN (SELECT k, g FROM {INN})")
def _(t):
    return S.with_in(outer(t), ["k", "g"], inner(t), ["ik", "ig"]).filter("_in").select("c_custkey")


@query("sub_not_in_tuple", f"SELECT c_custkey FROM {OUT} o WHERE NOT EXISTS (SELECT 1 FROM {INN} i WHERE coalesce(i.k = o.k AND i.g = o.g, TRUE))")
def _(t):
    return S.with_in(outer(t), ["k", "g"], inner(t), ["ik", "ig"]).filter(~F.col("_in")).select("c_custkey")


for _op, _word in {"=": "eq", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}.items():
    for _q in ("ANY", "ALL"):

        def _quant(t, op=_op, q=_q):
            return S.with_quantified(outer(t), "k", op, q, inner(t), "ik", [("g", "ig")]).select("c_custkey", "_q")

        _test = f"o.k {_op} i.k"
        _hits = f"(SELECT count(*) FILTER (WHERE {_test}) FROM {INN} i WHERE i.g = o.g)"
        _miss = f"(SELECT count(*) FILTER (WHERE NOT ({_test})) FROM {INN} i WHERE i.g = o.g)"
        _gaps = f"(SELECT count(*) FILTER (WHERE ({_test}) IS NULL) FROM {INN} i WHERE i.g = o.g)"
        _sql = f"CASE WHEN {_hits} > 0 THEN TRUE WHEN {_gaps} > 0 THEN NULL ELSE FALSE END" if _q == "ANY" else f"CASE WHEN {_miss} > 0 THEN FALSE WHEN {_gaps} > 0 THEN NULL ELSE TRUE END"
        query(f"sub_{_q.lower()}_{_word}", f"SELECT c_custkey, {_sql} AS _q FROM {OUT} o")(_quant)


@query("sub_any_uncorrelated", f"SELECT c_custkey FROM {OUT} WHERE k > ANY (SELECT k FROM {INN})")
def _(t):
    return S.with_quantified(outer(t), "k", ">", "ANY", inner(t), "ik").filter("_q").select("c_custkey")


@query("sub_all_empty", f"SELECT c_custkey FROM {OUT} WHERE k > ALL (SELECT k FROM {INN} WHERE s_suppkey < 0)")
def _(t):
    return S.with_quantified(outer(t), "k", ">", "ALL", inner(t).filter("s_suppkey < 0"), "ik").filter("_q").select("c_custkey")


@query("sub_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders) AS top FROM customer")
def _(t):
    return S.scalar(t.customer.select("c_custkey"), t.orders.agg(F.max("o_totalprice").alias("m")), F.col("m"), [], "top")


@query("sub_scalar_corr", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey GROUP BY o_custkey) AS n FROM customer")
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("m"))
    return S.scalar(t.customer.select("c_custkey"), counts, F.col("m"), [("c_custkey", "o_custkey")], "n")


@query("sub_corr_filter", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def _(t):
    means = t.orders.groupBy(F.col("o_custkey").alias("c")).agg(F.avg("o_totalprice").alias("m"))
    return t.orders.join(means, F.col("o_custkey") == F.col("c")).filter("o_totalprice > m").select("o_orderkey")


@query("cte_chain", "WITH a AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_mktsegment, o_totalprice FROM a JOIN customer ON o_custkey = c_custkey) SELECT c_mktsegment, count(*) AS n FROM b GROUP BY c_mktsegment")
def _(t):
    t.orders.createOrReplaceTempView("_bw_orders")
    t.customer.createOrReplaceTempView("_bw_customer")
    return t.values("WITH a AS (SELECT o_custkey, o_totalprice FROM _bw_orders WHERE o_orderstatus = 'F'), b AS (SELECT c_mktsegment, o_totalprice FROM a JOIN _bw_customer ON o_custkey = c_custkey) SELECT c_mktsegment, count(*) AS n FROM b GROUP BY c_mktsegment")


@query("cte_recursive", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 3 FROM r WHERE n < 100) SELECT n FROM r")
def _(t):
    return t.values("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 3 FROM r WHERE n < 100) SELECT n FROM r")


@query("cte_recursive_distinct", "WITH RECURSIVE r(n) AS (SELECT 1 UNION SELECT (n * 2) % 37 FROM r) SELECT n FROM r")
def _(t):
    return S.fixpoint(t.values("SELECT 1 AS n"), lambda new: new.select(((F.col("n") * 2) % 37).cast("int").alias("n")))


@query("view_read", "SELECT n_name, count(*) AS n FROM (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0) GROUP BY n_name")
def _(t):
    t.customer.filter("c_acctbal > 0").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name").createOrReplaceTempView("_bw_view")
    return t.values("SELECT n_name, count(*) AS n FROM _bw_view GROUP BY n_name")
