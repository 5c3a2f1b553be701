"""Window functions and frames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bagwright.operators import windows as W
from bagwright.queries import query

O = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderkey % 7 AS g, nullif(o_orderkey % 11, 0) AS x FROM orders)"


def o(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", (F.col("o_orderkey") % 7).alias("g"), F.expr("nullif(o_orderkey % 11, 0)").alias("x"))


def by(*order):
    return Window.partitionBy("o_custkey").orderBy(*order)


TOTAL = ("o_orderdate", "o_orderkey")
SQL_TOTAL = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"

_RANKS = {
    "row_number": (lambda: F.row_number().over(by(*TOTAL)), f"row_number() OVER ({SQL_TOTAL})"),
    "rank": (lambda: F.rank().over(by(F.asc_nulls_last("x"))), "rank() OVER (PARTITION BY o_custkey ORDER BY x ASC NULLS LAST)"),
    "dense_rank": (lambda: F.dense_rank().over(by(F.desc_nulls_first("x"))), "dense_rank() OVER (PARTITION BY o_custkey ORDER BY x DESC NULLS FIRST)"),
    "ntile": (lambda: F.ntile(3).over(by(*TOTAL)), f"ntile(3) OVER ({SQL_TOTAL})"),
    "percent_rank": (lambda: F.round(F.percent_rank().over(by(F.asc_nulls_last("x"))), 6), "round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY x ASC NULLS LAST), 6)"),
    "cume_dist": (lambda: F.round(F.cume_dist().over(by(F.asc_nulls_last("x"))), 6), "round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY x ASC NULLS LAST), 6)"),
    "lag": (lambda: F.lag("x", 2).over(by(*TOTAL)), f"lag(x, 2) OVER ({SQL_TOTAL})"),
    "lead": (lambda: F.lead("x", 1).over(by(*TOTAL)), f"lead(x, 1) OVER ({SQL_TOTAL})"),
    "first": (lambda: F.first("x").over(by(*TOTAL).rowsBetween(-2, 0)), f"first_value(x) OVER ({SQL_TOTAL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "last": (lambda: F.last("x").over(by(*TOTAL).rowsBetween(0, 1)), f"last_value(x) OVER ({SQL_TOTAL} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)"),
    "nth_value": (lambda: F.nth_value("x", 2).over(by(*TOTAL).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), f"nth_value(x, 2) OVER ({SQL_TOTAL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "first_ignore_nulls": (lambda: F.first("x", ignorenulls=True).over(by(*TOTAL).rowsBetween(-3, 0)), f"first_value(x IGNORE NULLS) OVER ({SQL_TOTAL} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    "rows": (lambda: F.sum("x").over(by(*TOTAL).rowsBetween(-1, 1)), f"(sum(x) OVER ({SQL_TOTAL} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT"),
    "range_peers": (lambda: F.count(F.lit(1)).over(by(F.asc_nulls_last("x"))), "count(*) OVER (PARTITION BY o_custkey ORDER BY x ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "range_offset": (lambda: F.sum("g").over(by(F.asc("g")).rangeBetween(-2, 1)), "(sum(g) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING))::BIGINT"),
    "unordered": (lambda: F.max("x").over(Window.partitionBy("o_custkey")), "max(x) OVER (PARTITION BY o_custkey)"),
    "avg": (lambda: F.round(F.avg("x").over(by(*TOTAL)), 6), f"round(avg(x) OVER ({SQL_TOTAL}), 6)"),
    "min_max": (lambda: F.max("x").over(by(*TOTAL)) - F.min("x").over(by(*TOTAL)), f"max(x) OVER ({SQL_TOTAL}) - min(x) OVER ({SQL_TOTAL})"),
    "filter": (lambda: F.count(F.when(F.col("x") > 5, 1)).over(by(*TOTAL)), f"count(*) FILTER (WHERE x > 5) OVER ({SQL_TOTAL})"),
}
for _name, (_col, _sql) in _RANKS.items():
    _cast = "::BIGINT" if "::" not in _sql and "round" not in _sql else ""

    def _win(t, col=_col, cast=_cast):
        v = col()
        return o(t).select("o_orderkey", (v.cast("long") if cast else v).alias("v"))

    query(f"win_{_name}", f"SELECT o_orderkey, ({_sql}){_cast} AS v FROM {O}")(_win)


@query("win_groups", f"SELECT o_orderkey, (sum(x) OVER (PARTITION BY o_custkey ORDER BY g GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW))::BIGINT AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY g GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {O}")
def _(t):
    one = W.groups_frame(o(t), ["o_custkey"], [F.asc("g")], -1, 0, {"s": F.sum("x")})
    return W.groups_frame(one, ["o_custkey"], [F.asc("g")], 0, None, {"n": F.count(F.lit(1))}).select("o_orderkey", "s", "n")


for _exclude in ("current row", "group", "ties"):

    def _without(t, exclude=_exclude):
        return W.excluding(o(t), ["o_custkey"], ["g"], "x", exclude, "s").select("o_orderkey", "s")

    query(f"win_exclude_{_exclude.replace(' ', '_')}", f"SELECT o_orderkey, (sum(x) OVER (PARTITION BY o_custkey ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {_exclude.upper()}))::BIGINT AS s FROM {O}")(_without)


@query("win_count_distinct", f"SELECT o_orderkey, count(DISTINCT x) OVER (PARTITION BY o_custkey) AS n FROM {O}")
def _(t):
    return W.distinct_count(o(t), ["o_custkey"], "x", "n").select("o_orderkey", "n")


@query("win_named", f"SELECT o_orderkey, row_number() OVER w AS r, (sum(x) OVER w)::BIGINT AS s FROM {O} WINDOW w AS ({SQL_TOTAL})")
def _(t):
    o(t).createOrReplaceTempView("_bw_o")
    return t.values(f"SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS r, sum(x) OVER w AS s FROM _bw_o WINDOW w AS ({SQL_TOTAL})")


@query("win_qualify", f"SELECT o_orderkey, o_custkey FROM {O} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(t):
    return W.qualify(o(t), {"r": F.row_number().over(by(F.desc("o_totalprice"), F.asc("o_orderkey")))}, "r <= 2").select("o_orderkey", "o_custkey")


@query("win_qualify_two", f"SELECT o_orderkey FROM {O} QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY g) = 1 AND count(*) OVER (PARTITION BY o_custkey) > 3")
def _(t):
    return W.qualify(o(t), {"r": F.rank().over(by(F.asc("g"))), "n": F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))}, "r = 1 AND n > 3").select("o_orderkey")


@query("win_where_before", f"SELECT o_orderkey, row_number() OVER ({SQL_TOTAL}) AS r FROM {O} WHERE x > 3")
def _(t):
    return o(t).filter("x > 3").select("o_orderkey", F.row_number().over(by(*TOTAL)).cast("long").alias("r"))


@query("win_over_join", "SELECT o_orderkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select("o_orderkey", "n_name", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("r"))


@query("page_top_groups", "SELECT o_custkey, n, rank() OVER (ORDER BY n DESC, o_custkey) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) QUALIFY r <= 20")
def _(t):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "o_custkey").limit(20)  # a top-n first: the rank then sees 20 rows
    return top.select("o_custkey", "n", F.rank().over(Window.orderBy(F.desc("n"), "o_custkey")).cast("long").alias("r"))


@query("win_over_group", "SELECT c_nationkey, c_mktsegment, o_custkey, n, rank() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY n DESC, o_custkey) AS r FROM (SELECT c_nationkey, c_mktsegment, o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, c_mktsegment, o_custkey)")
def _(t):
    counts = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.rank().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy(F.desc("n"), "o_custkey")).cast("long"))


@query("win_ties", f"SELECT o_custkey, g, count(*) AS n FROM {O} GROUP BY o_custkey, g HAVING count(*) > 1")
def _(t):
    return W.tied(o(t), ["o_custkey"], ["g"])


@query("ranked_orders", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT c_mktsegment, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P') WHERE rn <= 2 GROUP BY c_mktsegment")
def ranked_orders(t):
    """Join, filter, rank within a customer, keep two, aggregate."""
    df = t.orders.filter("o_orderstatus <> 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    kept = W.qualify(df, {"rn": F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey"))}, "rn <= 2")
    return kept.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("stream_windows_batch", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    from bagwright.streaming.windows import tumbling

    return tumbling(t.events, "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")]).select("start", "event_type", "n")
