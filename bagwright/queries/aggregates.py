"""Aggregation, grouping sets, set operations and histograms."""

from pyspark.sql import functions as F

from bagwright.operators import aggregates as A
from bagwright.operators import sets
from bagwright.plans import laws
from bagwright.queries import query

X = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice, nullif(l_linenumber % 5, 0) AS x FROM lineitem)"


def x(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", F.expr("nullif(l_linenumber % 5, 0)").alias("x"))


@query("agg_global", f"SELECT count(*) AS n, count(x) AS nx, sum(x)::BIGINT AS s, round(avg(x), 6) AS a, min(x) AS lo, max(x) AS hi FROM {X}")
def _(t):
    return x(t).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("nx"), F.sum("x").alias("s"), F.round(F.avg("x"), 6).alias("a"), F.min("x").alias("lo"), F.max("x").alias("hi"))


@query("agg_global_empty", f"SELECT count(*) AS n, count(x) AS nx, sum(x)::BIGINT AS s, avg(x) AS a, min(x) AS lo FROM {X} WHERE l_orderkey < 0")
def _(t):
    return x(t).filter("l_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("nx"), F.sum("x").alias("s"), F.avg("x").alias("a"), F.min("x").alias("lo"))


@query("agg_group_empty", f"SELECT x, count(*) AS n FROM {X} WHERE l_orderkey < 0 GROUP BY x")
def _(t):
    return x(t).filter("l_orderkey < 0").groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@query("agg_group", f"SELECT x, count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM {X} GROUP BY x")
def _(t):
    return x(t).groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))


@query("agg_group_all", f"SELECT l_returnflag, x, count(*) AS n FROM {X} GROUP BY ALL")
def _(t):
    x(t).createOrReplaceTempView("_bw_x")
    return t.values("SELECT l_returnflag, x, count(*) AS n FROM _bw_x GROUP BY ALL")


@query("agg_having", f"SELECT x, sum(l_linenumber)::BIGINT AS s FROM {X} GROUP BY x HAVING sum(l_linenumber) > 100 AND x IS NOT NULL")
def _(t):
    return x(t).groupBy("x").agg(F.sum("l_linenumber").alias("s")).filter("s > 100 AND x IS NOT NULL")


@query("agg_having_3vl", f"SELECT x, CASE WHEN x > 2 THEN 'TRUE' WHEN NOT x > 2 THEN 'FALSE' ELSE 'UNKNOWN' END AS _truth, count(*) AS n FROM {X} GROUP BY x")
def _(t):
    groups, _ = A.groups_with_contributors(x(t), ["x"], "l_orderkey", [F.count(F.lit(1)).alias("n")], F.col("x") > 2)
    return groups.select("x", "_truth", "n")


@query("agg_contributors", f"SELECT x, l_orderkey FROM {X} WHERE x IN (SELECT x FROM {X} GROUP BY x HAVING x > 2)")
def _(t):
    _, rows = A.groups_with_contributors(x(t), ["x"], "l_orderkey", [F.count(F.lit(1)).alias("n")], F.col("x") > 2)
    return rows


@query("agg_filter", f"SELECT l_returnflag, count(*) FILTER (WHERE x > 2) AS n, sum(l_linenumber) FILTER (WHERE x > 2)::BIGINT AS s FROM {X} GROUP BY 1")
def _(t):
    return x(t).groupBy("l_returnflag").agg(F.count(A.where(F.lit(1), F.col("x") > 2)).alias("n"), F.sum(A.where(F.col("l_linenumber"), F.col("x") > 2)).alias("s"))


@query("agg_count_distinct", f"SELECT l_returnflag, count(DISTINCT x) AS n FROM {X} GROUP BY 1")
def _(t):
    return x(t).groupBy("l_returnflag").agg(F.countDistinct("x").alias("n"))


SETS = "grouping(l_returnflag)::INTEGER AS g1, grouping(l_linestatus)::INTEGER AS g2, count(*) AS n"


def _sets():
    return [F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count(F.lit(1)).alias("n")]


@query("agg_rollup", f"SELECT l_returnflag, l_linestatus, {SETS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(*_sets())


@query("agg_cube", f"SELECT l_returnflag, l_linestatus, {SETS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(*_sets())


@query("agg_sets", f"SELECT l_returnflag, l_linestatus, {SETS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def _(t):
    return A.grouping_sets(t.lineitem, ["l_returnflag", "l_linestatus"], [["l_returnflag"], ["l_linestatus"], []], _sets())


@query("agg_with_rollup", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(t):
    t.lineitem.createOrReplaceTempView("_bw_li")
    return t.values("SELECT l_returnflag, count(*) AS n FROM _bw_li GROUP BY l_returnflag WITH ROLLUP")


@query("agg_with_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    t.lineitem.createOrReplaceTempView("_bw_li")
    return t.values("SELECT l_returnflag, l_linestatus, count(*) AS n FROM _bw_li GROUP BY l_returnflag, l_linestatus WITH CUBE")


@query("agg_with_totals", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ()) HAVING count(*) > 2")
def _(t):
    from bagwright.sources import dialect

    t.lineitem.createOrReplaceTempView("_bw_li")
    return dialect.run(t.spark, "SELECT l_returnflag, count(*) AS n FROM _bw_li GROUP BY l_returnflag WITH TOTALS HAVING count(*) > 2", "clickhouse")


@query("agg_exact_sum", "SELECT sum(l_orderkey * 1000000)::DOUBLE AS s FROM lineitem")
def _(t):
    return t.lineitem.agg(A.exact_sum(F.col("l_orderkey") * 1000000).cast("double").alias("s"))


_ONE = {
    "any_value": ("any_value(l_returnflag)", lambda: F.any_value("l_returnflag"), "l_returnflag"),
    "bit_and": ("bit_and(l_linenumber)", lambda: F.bit_and("l_linenumber"), None),
    "bit_or": ("bit_or(l_linenumber)", lambda: F.bit_or("l_linenumber"), None),
    "bit_xor": ("bit_xor(l_linenumber)", lambda: F.bit_xor("l_linenumber"), None),
    "bool_and": ("bool_and(x > 1)", lambda: F.bool_and(F.col("x") > 1), None),
    "bool_or": ("bool_or(x > 3)", lambda: F.bool_or(F.col("x") > 3), None),
    "every": ("bool_and(x > 0)", lambda: F.every(F.col("x") > 0), None),
    "avg": ("round(avg(l_quantity), 4)", lambda: F.round(F.avg("l_quantity"), 4), None),
    "min": ("min(x)", lambda: F.min("x"), None),
    "max": ("max(x)", lambda: F.max("x"), None),
    "count": ("count(x)", lambda: F.count("x"), None),
    "sum": ("sum(x)::BIGINT", lambda: F.sum("x"), None),
    "corr": ("round(corr(l_linenumber, l_quantity), 6)", lambda: F.round(F.corr("l_linenumber", "l_quantity"), 6), None),
    "covar_pop": ("round(covar_pop(l_linenumber, l_quantity), 4)", lambda: F.round(F.covar_pop("l_linenumber", "l_quantity"), 4), None),
    "covar_samp": ("round(covar_samp(l_linenumber, l_quantity), 4)", lambda: F.round(F.covar_samp("l_linenumber", "l_quantity"), 4), None),
    "stddev": ("round(stddev(l_quantity), 4)", lambda: F.round(F.stddev("l_quantity"), 4), None),
    "stddev_pop": ("round(stddev_pop(l_quantity), 4)", lambda: F.round(F.stddev_pop("l_quantity"), 4), None),
    "stddev_samp": ("round(stddev_samp(l_quantity), 4)", lambda: F.round(F.stddev_samp("l_quantity"), 4), None),
    "var_pop": ("round(var_pop(l_quantity), 4)", lambda: F.round(F.var_pop("l_quantity"), 4), None),
    "var_samp": ("round(var_samp(l_quantity), 4)", lambda: F.round(F.var_samp("l_quantity"), 4), None),
    "variance": ("round(variance(l_quantity), 4)", lambda: F.round(F.variance("l_quantity"), 4), None),
    "array_agg": ("coalesce(array_to_string(list_sort(array_agg(x) FILTER (WHERE x IS NOT NULL)), ','), '')", lambda: F.array_join(F.sort_array(F.array_agg("x")).cast("array<string>"), ","), "l_orderkey"),
    "string_agg": ("string_agg(x::VARCHAR, ',' ORDER BY l_linenumber)", lambda: F.expr("listagg(CAST(x AS STRING), ',') WITHIN GROUP (ORDER BY l_linenumber)"), "l_orderkey"),
}
for _name, (_sql, _col, _key) in _ONE.items():
    _by = _key or "l_linestatus"

    def _agg(t, col=_col, by=_by):
        return x(t).groupBy(by).agg(col().alias("v"))

    query(f"agg_{_name}", f"SELECT {_by}, {_sql} AS v FROM {X} GROUP BY {_by}")(_agg)


@query("agg_join_group_having", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 5")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).filter("n > 5")


L = "(SELECT nullif(c_nationkey % 7, 0) AS k, c_mktsegment AS s FROM customer)"
R = "(SELECT nullif(s_nationkey % 7, 0) AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS s FROM supplier)"


def left(t):
    return t.customer.select(F.expr("nullif(c_nationkey % 7, 0)").alias("k"), F.col("c_mktsegment").alias("s"))


def right(t):
    return t.supplier.select(F.expr("nullif(s_nationkey % 7, 0)").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("s"))


for _kind in sets.LAWS:

    def _set(t, kind=_kind):
        return sets.apply(kind, left(t), right(t))

    query("set_" + _kind.lower().replace(" ", "_"), f"SELECT k, s FROM {L} {_kind} SELECT k, s FROM {R}")(_set)

    def _law(t, kind=_kind):
        return sets.multiplicities(kind, left(t), right(t)).filter("n > 0").select("k", "s", "n")

    query("set_law_" + _kind.lower().replace(" ", "_"), f"SELECT k, s, count(*) AS n FROM (SELECT k, s FROM {L} {_kind} SELECT k, s FROM {R}) GROUP BY k, s")(_law)


@query("set_minus", f"SELECT k, s FROM {L} EXCEPT SELECT k, s FROM {R}")
def _(t):
    return sets.apply("MINUS", left(t), right(t))


@query("set_by_name", f"SELECT k, s FROM {L} UNION ALL BY NAME SELECT s, k FROM {R}")
def _(t):
    return sets.union_by_name(left(t), right(t).select("s", "k"))


@query("set_by_name_distinct", f"SELECT k, s FROM {L} UNION BY NAME SELECT s, k FROM {R}")
def _(t):
    return sets.union_by_name(left(t), right(t).select("s", "k"), distinct=True)


@query("set_nested", f"(SELECT k, s FROM {L} EXCEPT ALL SELECT k, s FROM {R}) UNION ALL (SELECT k, s FROM {R} INTERSECT ALL SELECT k, s FROM {L})")
def _(t):
    return sets.tree(("UNION ALL", ("EXCEPT ALL", left(t), right(t)), ("INTERSECT ALL", right(t), left(t))))


@query("set_branch_pages", "(SELECT p_partkey AS k FROM part ORDER BY p_partkey LIMIT 3) UNION ALL (SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 2)")
def _(t):
    return t.part.select(F.col("p_partkey").alias("k")).orderBy("k").limit(3).unionAll(t.supplier.select("s_suppkey").orderBy(F.desc("s_suppkey")).limit(2))


@query("set_paged", f"SELECT k, s FROM {L} UNION SELECT k, s FROM {R} ORDER BY k NULLS LAST, s LIMIT 7")
def _(t):
    return sets.apply("UNION", left(t), right(t)).orderBy(F.asc_nulls_last("k"), "s").limit(7)


@query("set_membership", f"SELECT count(*) > 0 AS present FROM (SELECT k, s FROM {L} INTERSECT SELECT k, s FROM {R}) WHERE k IS NULL AND s = 'BUILDING'")
def _(t):
    both = sets.apply("INTERSECT", left(t), right(t))
    return both.filter(sets.member(both, (None, "BUILDING"))).agg((F.count(F.lit(1)) > 0).alias("present"))


@query("hist_column", f"SELECT k AS value, count(*) AS n FROM {L} GROUP BY k")
def _(t):
    return laws.histogram(left(t), ["k"]).withColumnRenamed("k", "value")


@query("hist_tuple", f"SELECT k, s, count(*) AS n FROM {L} GROUP BY k, s")
def _(t):
    return laws.histogram(left(t), ["k", "s"])


@query("hist_statistics", f"SELECT count(*) AS rows, count(k) AS known, count(*) - count(k) AS nulls, count(DISTINCT k) AS distinct_values, count(k) - count(DISTINCT k) AS duplicates, round((count(*) - count(k)) / count(*), 6) AS null_fraction FROM {L}")
def _(t):
    return laws.statistics(left(t), "k")


@query("count_laws", f"SELECT (SELECT count(*) FROM {L}) + (SELECT count(*) FROM {R}) AS union_all, (SELECT sum(a.n * b.n)::BIGINT FROM (SELECT k, count(*) AS n FROM {L} GROUP BY k) a JOIN (SELECT k, count(*) AS n FROM {R} GROUP BY k) b USING (k)) AS equijoin, (SELECT count(DISTINCT coalesce(k, -1)) FROM {L}) AS groups, least((SELECT count(*) FROM {L}), 5) AS page")
def _(t):
    return laws.predicted_counts(left(t), right(t), "k", 5)


@query("count_row_goal", f"SELECT 'rows' AS goal, CASE WHEN count(*) BETWEEN 1 AND 1000000 THEN 'Feasible' ELSE 'Unsatisfiable' END AS outcome FROM {L}")
def _(t):
    return laws.row_goal(left(t), at_least=1, at_most=1_000_000)


@query(
    "count_joint_goals",
    f"SELECT 'rows' AS goal, count(*) AS n, CASE WHEN count(*) >= 1 THEN 'Feasible' ELSE 'Residual' END AS outcome FROM {L} UNION ALL SELECT 'small', count(*), CASE WHEN count(*) BETWEEN 1 AND 5000000 THEN 'Feasible' ELSE 'Residual' END FROM {L} WHERE k < 4"
    f" UNION ALL SELECT 'none', count(*), CASE WHEN count(*) = 0 THEN 'Feasible' ELSE 'Residual' END FROM {L} WHERE k >= 2 UNION ALL SELECT 'more', count(*), 'Unsatisfiable' FROM {L} WHERE k < 4 AND k > 1",
)
def _(t):
    """Goals over one source, met together: 'more' asks for more rows than 'small', which includes them, may have."""
    return laws.joint_goals(left(t), {"rows": ([], 1, None), "small": (["k < 4"], 1, 5_000_000), "none": (["k >= 2"], 0, 0), "more": (["k < 4", "k > 1"], 6_000_000, None)})


@query("rejected_rows", f"SELECT count(*) AS rejected FROM {L} WHERE NOT coalesce(k > 2, FALSE)")
def _(t):
    return left(t).filter(~F.coalesce(F.col("k") > 2, F.lit(False))).agg(F.count(F.lit(1)).alias("rejected"))


@query("hist_inverted", "SELECT p_size AS source_value, p_size * 3 + 2 AS output_value, count(*) AS n FROM part GROUP BY p_size")
def _(t):
    return laws.inverted_histogram(t.part, "p_size", scale=3, shift=2)
