"""Every join form."""

from pyspark.sql import functions as F

from bagwright.operators import joins as J
from bagwright.queries import query

#: Customers and orders on a nullable, repeating key.
A = "(SELECT c_custkey, nullif(c_nationkey % 6, 0) AS k FROM customer)"
B = "(SELECT s_suppkey, nullif(s_nationkey % 6, 1) AS k FROM supplier)"


def a(t):
    return t.customer.select("c_custkey", F.expr("nullif(c_nationkey % 6, 0)").alias("k"))


def b(t):
    return t.supplier.select("s_suppkey", F.expr("nullif(s_nationkey % 6, 1)").alias("k"))


def b2(t):
    return b(t).withColumnRenamed("k", "k2")


for _name, _how in {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "full": "FULL"}.items():

    def _join(t, how=_name):
        return J.few_keys(a(t), b(t), ["k"], how).select("c_custkey", "s_suppkey")

    query(f"join_{_name}", f"SELECT c_custkey, s_suppkey FROM {A} x {_how} JOIN {B} y ON x.k = y.k")(_join)


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("join_left_semi", f"SELECT c_custkey FROM {A} x WHERE EXISTS (SELECT 1 FROM {B} y WHERE x.k = y.k)")
def _(t):
    return a(t).join(b2(t), F.col("k") == F.col("k2"), "left_semi").select("c_custkey")


@query("join_left_anti", f"SELECT c_custkey FROM {A} x WHERE NOT EXISTS (SELECT 1 FROM {B} y WHERE x.k = y.k)")
def _(t):
    return a(t).join(b2(t), F.col("k") == F.col("k2"), "left_anti").select("c_custkey")


@query("join_right_semi", f"SELECT s_suppkey FROM {B} y WHERE EXISTS (SELECT 1 FROM {A} x WHERE x.k = y.k)")
def _(t):
    return J.right_semi(a(t), b2(t), F.col("k") == F.col("k2")).select("s_suppkey")


@query("join_right_anti", f"SELECT s_suppkey FROM {B} y WHERE NOT EXISTS (SELECT 1 FROM {A} x WHERE x.k = y.k)")
def _(t):
    return J.right_anti(a(t), b2(t), F.col("k") == F.col("k2")).select("s_suppkey")


@query("join_using", f"SELECT k, c_custkey, s_suppkey FROM {A} x JOIN {B} y USING (k)")
def _(t):
    return J.few_keys(a(t), b(t), ["k"])


@query("join_full_using", f"SELECT k, c_custkey, s_suppkey FROM {A} x FULL JOIN {B} y USING (k)")
def _(t):
    return J.few_keys(a(t), b(t), ["k"], "full")


@query("join_natural", f"SELECT k, c_custkey, s_suppkey FROM {A} x NATURAL JOIN {B} y")
def _(t):
    return J.natural(a(t), b(t), by=J.few_keys)


@query("join_natural_disjoint", "SELECT r_name, s_name FROM region CROSS JOIN (SELECT s_name FROM supplier)")
def _(t):
    return J.natural(t.region.select("r_name"), t.supplier.select("s_name"))


@query("join_theta", f"SELECT n_nationkey, s_suppkey FROM nation JOIN {B} y ON n_nationkey < y.k")
def _(t):
    return t.nation.join(b(t), F.col("n_nationkey") < F.col("k")).select("n_nationkey", "s_suppkey")


@query("join_nullsafe", f"SELECT c_custkey, s_suppkey FROM {A} x JOIN {B} y ON x.k IS NOT DISTINCT FROM y.k")
def _(t):
    return J.few_keys(a(t), b(t), ["k"], null_safe=True).select("c_custkey", "s_suppkey")


@query("join_eq_or_null", f"SELECT n_nationkey, s_suppkey FROM (SELECT n_nationkey, nullif(n_regionkey, 0) AS k FROM nation) x JOIN {B} y ON x.k = y.k OR x.k IS NULL")
def _(t):
    n = t.nation.select("n_nationkey", F.expr("nullif(n_regionkey, 0)").alias("k"))
    return n.join(b2(t), (F.col("k") == F.col("k2")) | F.col("k").isNull()).select("n_nationkey", "s_suppkey")


@query("join_temporal_theta", "SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey AND o.o_orderdate >= e.ts")
def _(t):
    return t.events.join(t.orders, (F.col("user_id") == F.col("o_custkey")) & (F.col("o_orderdate") >= F.col("ts"))).select("event_id", "o_orderkey")


@query("join_self", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def _(t):
    x, y = t.nation.alias("x"), t.nation.alias("y")
    return x.join(y, (F.col("x.n_regionkey") == F.col("y.n_regionkey")) & (F.col("x.n_nationkey") < F.col("y.n_nationkey"))).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"))


@query("join_composite", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def _(t):
    x, y = t.lineitem.select("l_orderkey", "l_linenumber"), t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return x.join(y, ["l_orderkey", "l_linenumber"])


@query("join_chain3", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("join_comma_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def _(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'ASIA'").select("n_name", "r_name")


ASOF = "(SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts)"


@query("join_asof", f"SELECT o_orderkey, e.event_id FROM orders o ASOF LEFT JOIN {ASOF} e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    return J.asof(o, t.events.select("user_id", "ts", "event_id"), ["user_id"], "o_orderdate", "ts", ["event_id"], "event_id").select("o_orderkey", "event_id")


@query("join_asof_inner", f"SELECT o_orderkey, e.event_id FROM orders o ASOF JOIN {ASOF} e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    return J.asof(o, t.events.select("user_id", "ts", "event_id"), ["user_id"], "o_orderdate", "ts", ["event_id"], "event_id", how="inner").select("o_orderkey", "event_id")


@query("join_asof_sliced", f"SELECT o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey, (TIMESTAMP '2024-01-01' + to_days((o_orderkey % 40)::INTEGER)) AS at FROM orders) o ASOF LEFT JOIN {ASOF} e ON o.o_custkey = e.user_id AND o.at >= e.ts")
def _(t):
    """Within a key, days are ordered apart from each other; each day takes over the last row before it."""
    at = F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, int(o_orderkey % 40))")
    o = t.orders.select(F.col("o_custkey").alias("user_id"), "o_orderkey", at.alias("at"))
    return J.asof(o, t.events.select("user_id", "ts", "event_id"), ["user_id"], "at", "ts", ["event_id"], "event_id", slices=lambda c: F.to_date(c)).select("o_orderkey", "event_id")


@query("join_lateral", "SELECT r_name, n.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 5) n")
def _(t):
    inner = t.nation.filter((F.col("n_regionkey") == F.col("r_regionkey").outer()) & (F.col("n_nationkey") > 5)).select("n_name")
    return t.region.lateralJoin(inner).select("r_name", "n_name")


@query("join_cross_apply", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r <= 2")
def _(t):
    return J.apply_top(t.customer, t.orders, [("c_custkey", "o_custkey")], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("c_custkey", "o_orderkey")


@query("join_outer_apply", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r <= 2")
def _(t):
    return J.apply_top(t.customer, t.orders, [("c_custkey", "o_custkey")], [F.desc("o_totalprice"), F.col("o_orderkey")], 2, outer=True).select("c_custkey", "o_orderkey")


@query("join_salted", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    left = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return J.salted(left, t.part.select("p_partkey", "p_brand"), "p_partkey", 4).select("l_orderkey", "l_linenumber", "p_brand")


@query("hist_join_key", f"SELECT k AS key, left_n, right_n, left_n * right_n AS pairs FROM (SELECT k, count(*) AS left_n FROM {A} GROUP BY k) JOIN (SELECT k, count(*) AS right_n FROM {B} GROUP BY k) USING (k)")
def _(t):
    return J.key_histogram(a(t), b(t), "k", "k")


@query("join_match_report", f"SELECT 'left' AS side, CASE WHEN k IS NULL THEN 'NULL_KEY' WHEN k IN (SELECT k FROM {B} WHERE k IS NOT NULL) THEN 'MATCHED' ELSE 'UNMATCHED' END AS status, count(*) AS n FROM {A} GROUP BY ALL UNION ALL SELECT 'right', CASE WHEN k IS NULL THEN 'NULL_KEY' WHEN k IN (SELECT k FROM {A} WHERE k IS NOT NULL) THEN 'MATCHED' ELSE 'UNMATCHED' END, count(*) FROM {B} GROUP BY ALL")
def _(t):
    return J.match_report(a(t), b(t), "k", "k")
