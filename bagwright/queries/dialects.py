"""SQL text of other dialects, rewritten and run."""

from bagwright.queries import query
from bagwright.sources import dialect


def _run(t, sql, kind):
    for name in ("part", "customer", "orders", "nation", "region"):
        getattr(t, name).createOrReplaceTempView(f"_bw_{name}")
    return dialect.run(t.spark, sql, kind)


_TEXTS = {
    "sql_qualify": ("snowflake", "SELECT o_custkey, o_orderkey FROM _bw_orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "sql_qualify_alias": ("snowflake", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM _bw_orders QUALIFY r <= 2", "SELECT o_custkey, o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS r FROM orders QUALIFY r <= 2"),
    "sql_top": ("mssql", "SELECT TOP (5) [c_custkey], c_acctbal FROM _bw_customer ORDER BY c_acctbal DESC, c_custkey", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5"),
    "sql_top_ties": ("mssql", "SELECT TOP 4 WITH TIES p_partkey, p_size FROM _bw_part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 4"),
    "sql_fetch": ("oracle", "SELECT p_partkey FROM _bw_part ORDER BY p_partkey OFFSET 3 ROWS FETCH NEXT 4 ROWS ONLY", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 4 OFFSET 3"),
    "sql_limit_comma": ("mysql", "SELECT p_partkey FROM _bw_part ORDER BY p_partkey LIMIT 3, 4", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 4 OFFSET 3"),
    "sql_distinct_on": ("postgres", 'SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM _bw_part ORDER BY p_brand, "p_size" DESC, p_partkey', "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1"),
    "sql_exclude": ("duckdb", "SELECT * EXCLUDE (r_name) FROM _bw_region", "SELECT * EXCLUDE (r_name) FROM region"),
    "sql_safe_cast": ("bigquery", "SELECT p_partkey, SAFE_CAST(p_brand AS INT) AS v FROM _bw_part", "SELECT p_partkey, TRY_CAST(p_brand AS INTEGER) AS v FROM part"),
    "sql_cross_apply": ("mssql", "SELECT r.r_name, x.n_name FROM _bw_region r CROSS APPLY (SELECT n.n_name FROM _bw_nation n WHERE n.n_regionkey = r.r_regionkey) x", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "sql_outer_apply": ("mssql", "SELECT r.r_name, x.n_name FROM _bw_region r OUTER APPLY (SELECT n.n_name FROM _bw_nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20) x", "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 20"),
    "sql_unnest": ("generic", "SELECT UNNEST(array(1, 2, 3)) AS v", "SELECT unnest([1, 2, 3]) AS v"),
    "sql_top_percent": ("mssql", "SELECT TOP 10 PERCENT p_partkey, p_size FROM _bw_part ORDER BY p_size DESC, p_partkey", "SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r, count(*) OVER () AS n FROM part) WHERE r <= ceil(n * 10 / 100.0)"),
    "sql_top_percent_ties": ("mssql", "SELECT TOP (5) PERCENT WITH TIES p_partkey, p_size FROM _bw_part ORDER BY p_size", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r, count(*) OVER () AS n FROM part) WHERE r <= ceil(n * 5 / 100.0)"),
    "sql_distinct_top": ("mssql", "SELECT DISTINCT TOP 6 p_size FROM _bw_part ORDER BY p_size", "SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 6"),
    "sql_distinct_top_ties": ("mssql", "SELECT DISTINCT TOP 3 WITH TIES p_brand, p_size FROM _bw_part ORDER BY p_size", "SELECT p_brand, p_size FROM (SELECT DISTINCT p_brand, p_size FROM part) QUALIFY rank() OVER (ORDER BY p_size) <= 3"),
    "sql_top_column": ("generic", "SELECT top, n FROM (SELECT p_size AS top, count(*) AS n FROM _bw_part GROUP BY p_size) q", "SELECT p_size AS top, count(*) AS n FROM part GROUP BY p_size"),
    "sql_fetch_offset_ties": ("oracle", "SELECT p_size FROM _bw_part ORDER BY p_size OFFSET 2 ROWS FETCH NEXT 5 ROWS WITH TIES", "SELECT p_size FROM (SELECT p_size, rank() OVER (ORDER BY p_size) AS r, row_number() OVER (ORDER BY p_size) AS n FROM part) WHERE n > 2 AND r <= 7"),
    "sql_distinct_on_unordered": ("postgres", "SELECT DISTINCT ON (p_brand) p_brand FROM _bw_part", "SELECT DISTINCT p_brand FROM part"),
    "sql_distinct_on_limit": ("postgres", "SELECT DISTINCT ON (p_brand) p_brand, p_partkey FROM _bw_part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 3", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1 ORDER BY p_brand DESC LIMIT 3"),
    "sql_exclude_qualify_top": ("snowflake", "SELECT TOP 3 * EXCLUDE (p_name, p_type, p_retailprice) FROM _bw_part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1 ORDER BY p_partkey", "SELECT p_partkey, p_brand, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1 ORDER BY p_partkey LIMIT 3"),
    "sql_limit_by": ("clickhouse", "SELECT p_brand, p_partkey FROM _bw_part ORDER BY p_size, p_partkey LIMIT 2 BY p_brand LIMIT 9", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) <= 2 ORDER BY p_size, p_partkey LIMIT 9"),
    "sql_limit_by_offset": ("clickhouse", "SELECT p_brand, p_partkey FROM _bw_part ORDER BY p_partkey LIMIT 1, 2 BY p_brand", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) BETWEEN 2 AND 3"),
    "sql_limit_percent": ("duckdb", "SELECT p_partkey FROM _bw_part ORDER BY p_partkey LIMIT 10%", "SELECT p_partkey FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) <= (SELECT ceil(count(*) * 10 / 100.0) FROM part)"),
    "sql_limit_ties": ("clickhouse", "SELECT p_partkey, p_size FROM _bw_part ORDER BY p_size LIMIT 4 WITH TIES", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size) <= 4"),
    "sql_unnest_from": ("bigquery", "SELECT p_partkey, v FROM _bw_part, UNNEST(array(p_size, p_size + 1)) AS v WHERE p_partkey < 9", "SELECT p_partkey, unnest([p_size, p_size + 1]) AS v FROM part WHERE p_partkey < 9"),
    "sql_unnest_with_offset": ("bigquery", "SELECT p_partkey, v, o FROM _bw_part CROSS JOIN UNNEST(array(p_size, 7)) AS v WITH OFFSET AS o", "SELECT p_partkey, CASE WHEN o = 0 THEN p_size ELSE 7 END AS v, o::INTEGER AS o FROM part, range(2) AS t(o)"),
    "sql_unnest_ordinality": ("postgres", "SELECT p_partkey, u.v, u.n FROM (SELECT p_partkey, array(p_size, 7) AS a FROM _bw_part) q CROSS JOIN LATERAL UNNEST(a) WITH ORDINALITY AS u(v, n)".replace("u.v, u.n", "v, n"), "SELECT p_partkey, CASE WHEN n = 1 THEN p_size ELSE 7 END AS v, n::INTEGER AS n FROM part, range(1, 3) AS t(n)"),
    "sql_backslash": ("mysql", r"SELECT r_regionkey, 'it\'s; \\ --no' AS s FROM _bw_region", r"SELECT r_regionkey, 'it''s; \ --no' AS s FROM region"),
    "sql_no_backslash": ("postgres", r"SELECT r_regionkey, 'a\n''b' AS s FROM _bw_region", r"SELECT r_regionkey, 'a\n''b' AS s FROM region"),
    "sql_dollar_quotes": ("postgres", r"SELECT r_regionkey, $x$it's $ a\b$x$ AS s FROM _bw_region", r"SELECT r_regionkey, 'it''s $ a\b' AS s FROM region"),
    "sql_straight_join": ("mysql", "SELECT STRAIGHT_JOIN r_name, n_name FROM _bw_region STRAIGHT_JOIN _bw_nation ON n_regionkey = r_regionkey", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "sql_global_join": ("clickhouse", "SELECT r_name, n_name FROM _bw_region GLOBAL LEFT JOIN _bw_nation ON n_regionkey = r_regionkey WHERE r_regionkey GLOBAL NOT IN (SELECT 3)", "SELECT r_name, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 3"),
    "sql_prewhere": ("clickhouse", "SELECT p_partkey FROM _bw_part PREWHERE p_size > 10 OR p_size = 3 WHERE p_partkey < 100 OR p_size = 40 ORDER BY p_partkey SETTINGS max_threads = 2 FORMAT JSON", "SELECT p_partkey FROM part WHERE (p_size > 10 OR p_size = 3) AND (p_partkey < 100 OR p_size = 40)"),
    "sql_row_lock": ("postgres", "SELECT n_name FROM _bw_nation WHERE n_nationkey < 9 ORDER BY n_name FOR UPDATE SKIP LOCKED", "SELECT n_name FROM nation WHERE n_nationkey < 9"),
    "sql_pipe": ("bigquery", "FROM _bw_part |> WHERE p_size > 20 |> AGGREGATE count(*) AS n GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 20 GROUP BY p_brand"),
    "sql_at_time_zone": ("spark", "SELECT o_orderkey, CAST(to_utc_timestamp(o_orderdate, 'America/New_York') + INTERVAL '1' DAY AS TIMESTAMP_NTZ) AS v FROM _bw_orders WHERE o_orderkey < 50", "SELECT o_orderkey, (timezone('UTC', timezone('America/New_York', o_orderdate)) + INTERVAL 1 DAY)::TIMESTAMP AS v FROM orders WHERE o_orderkey < 50"),
    "sql_group_by_all": ("duckdb", "SELECT p_brand, count(*) AS n FROM _bw_part GROUP BY ALL", "SELECT p_brand, count(*) AS n FROM part GROUP BY ALL"),
}
for _name, (_kind, _sql, _oracle) in _TEXTS.items():

    def _text(t, sql=_sql, kind=_kind):
        return _run(t, sql, kind)

    query(_name, _oracle)(_text)
