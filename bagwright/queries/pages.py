"""Ordering, paging and top-k."""

from pyspark.sql import functions as F

from bagwright.operators import pages as P
from bagwright.queries import query


@query("page_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def _(t):
    return P.page(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 5).select("o_orderkey", "o_totalprice")


@query("page_comma_form", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 3")
def _(t):
    return P.page(t.part.select("p_partkey"), [F.asc("p_partkey")], 7, 3)


@query("page_top", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def _(t):
    return P.page(t.customer.select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 5)


@query("page_with_ties", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC NULLS LAST) <= 10")
def _(t):
    return P.first_with_ties(t.part.select("p_partkey", "p_size"), [("p_size", "desc")], 10)


@query("page_with_ties_nulls", "SELECT p_partkey, s FROM (SELECT p_partkey, nullif(p_size % 10, 0) AS s FROM part) QUALIFY rank() OVER (ORDER BY s NULLS LAST) <= (SELECT count(*) - 2 FROM part)")
def _(t):
    df = t.part.select("p_partkey", F.expr("nullif(p_size % 10, 0)").alias("s"))
    return P.first_with_ties(df, [("s", "asc")], df.count() - 2)


@query("page_with_ties_by_group", "SELECT p_partkey, p_brand, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size NULLS LAST) <= 2")
def _(t):
    return P.first_with_ties(t.part.select("p_partkey", "p_brand", "p_size"), [("p_size", "asc")], 2, by=["p_brand"])


@query("page_distinct", "SELECT DISTINCT p_brand, p_size FROM part ORDER BY p_brand, p_size LIMIT 12 OFFSET 2")
def _(t):
    return P.page(t.part.select("p_brand", "p_size").distinct(), [F.asc("p_brand"), F.asc("p_size")], 12, 2)


@query("page_distinct_on", "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1")
def _(t):
    return P.distinct_on(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.desc("p_size"), F.asc("p_partkey")])


@query("page_limit_by", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 2")
def _(t):
    return P.limit_by(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")], 2)


@query("page_nested", "SELECT p_partkey FROM (SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT 40) ORDER BY p_partkey DESC LIMIT 9 OFFSET 3")
def _(t):
    inner = P.page(t.part.select("p_partkey", "p_size"), [F.asc("p_size"), F.asc("p_partkey")], 40)
    return P.page(inner.select("p_partkey"), [F.desc("p_partkey")], 9, 3)


@query("page_membership", "SELECT count(*) > 0 AS present FROM (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5 OFFSET 2) WHERE p_partkey = 4")
def _(t):
    return P.page(t.part.select("p_partkey"), [F.asc("p_partkey")], 5, 2).filter("p_partkey = 4").agg((F.count(F.lit(1)) > 0).alias("present"))


@query("page_ties_report", "SELECT p_size, count(*) AS n FROM part GROUP BY p_size HAVING count(*) > 1")
def _(t):
    return P.ties(t.part, ["p_size"])


@query("order_nulls_first", "SELECT s, p_partkey FROM (SELECT nullif(p_size % 10, 0) AS s, p_partkey FROM part) ORDER BY s NULLS FIRST, p_partkey LIMIT 15")
def _(t):
    return P.page(t.part.select(F.expr("nullif(p_size % 10, 0)").alias("s"), "p_partkey"), [F.asc_nulls_first("s"), F.asc("p_partkey")], 15)
