"""Projection, filters, three-valued logic and scalar expressions."""

from pyspark.sql import functions as F

from bagwright.functions import scalars as S
from bagwright.operators import shapes, truth
from bagwright.queries import query

#: A nullable, repeating value for both engines.
SIZE = "nullif(p_size % 10, 0)"


def parts(t):
    return t.part.select("p_partkey", F.expr(SIZE).alias("s"), "p_brand", "p_name", "p_retailprice", "p_size")


@query("where_3vl", f"SELECT CASE WHEN s > 4 THEN 'TRUE' WHEN NOT s > 4 THEN 'FALSE' ELSE 'UNKNOWN' END AS truth, count(*) AS n FROM (SELECT {SIZE} AS s FROM part) GROUP BY 1")
def _(t):
    return truth.truth_counts(parts(t), F.col("s") > 4)


@query("where_row_truth", f"SELECT p_partkey, CASE WHEN s > 2 AND p_size < 30 OR s IS NULL AND p_size > 40 THEN 'TRUE' WHEN NOT (s > 2 AND p_size < 30 OR s IS NULL AND p_size > 40) THEN 'FALSE' ELSE 'UNKNOWN' END AS _truth FROM (SELECT p_partkey, p_size, {SIZE} AS s FROM part)")
def _(t):
    df = parts(t)
    return truth.with_truth(df, ((F.col("s") > 2) & (F.col("p_size") < 30)) | (F.col("s").isNull() & (F.col("p_size") > 40))).select("p_partkey", "_truth")


@query("where_and_or_not", f"SELECT p_partkey FROM (SELECT p_partkey, p_size, {SIZE} AS s FROM part) WHERE NOT (s = 3 OR p_size > 25) AND (s <> 4 OR s IS NULL)")
def _(t):
    return parts(t).filter(~((F.col("s") == 3) | (F.col("p_size") > 25)) & ((F.col("s") != 4) | F.col("s").isNull())).select("p_partkey")


for _name, _op in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():

    def _compare(t, op=_op):
        return parts(t).filter(f"s {op} 5").select("p_partkey", "s")

    query(f"where_{_name}", f"SELECT p_partkey, s FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s {_op} 5")(_compare)


@query("in_list_null", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s IN (1, 2, NULL)")
def _(t):
    return parts(t).filter("s IN (1, 2, NULL)").select("p_partkey")


@query("not_in_null", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s NOT IN (1, 2, NULL)")
def _(t):
    return parts(t).filter("s NOT IN (1, 2, NULL)").select("p_partkey")


@query("not_in_list", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s NOT IN (1, 2)")
def _(t):
    return parts(t).filter(~F.col("s").isin(1, 2)).select("p_partkey")


@query("between_pos", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s BETWEEN 2 AND 6")
def _(t):
    return parts(t).filter(F.col("s").between(2, 6)).select("p_partkey")


@query("between_neg", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s NOT BETWEEN 2 AND 6")
def _(t):
    return parts(t).filter(~F.col("s").between(2, 6)).select("p_partkey")


@query("between_inverted_null", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s NOT BETWEEN 6 AND NULL OR s BETWEEN 7 AND 3")
def _(t):
    return parts(t).filter("s NOT BETWEEN 6 AND NULL OR s BETWEEN 7 AND 3").select("p_partkey")


@query("like_prefix", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, substr(p_name, 1, 1) || substr(p_name, 2, 2)) AND p_brand LIKE 'Brand#1%'")
def _(t):
    prefix, exact = truth.safe_prefix("Brand#1%")
    assert not exact
    return t.part.filter(F.col("p_brand").startswith(prefix)).filter(F.col("p_name").isNotNull()).select("p_partkey", "p_name")


@query("like_not_escaped", "SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand#2%' AND p_name NOT LIKE '%x_y' AND p_type NOT LIKE '100^%' ESCAPE '^'")
def _(t):
    return t.part.filter("p_brand NOT LIKE 'Brand#2%' AND p_name NOT LIKE '%x_y' AND p_type NOT LIKE '100^%' ESCAPE '^'").select("p_partkey")


@query("distinct_from", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s, nullif(p_size % 3, 0) AS u FROM part) WHERE s IS DISTINCT FROM u")
def _(t):
    df = t.part.select("p_partkey", F.expr(SIZE).alias("s"), F.expr("nullif(p_size % 3, 0)").alias("u"))
    return df.filter(truth.distinct_from(F.col("s"), F.col("u"))).select("p_partkey")


@query("not_distinct_from", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s, nullif(p_size % 3, 0) AS u FROM part) WHERE s IS NOT DISTINCT FROM u")
def _(t):
    df = t.part.select("p_partkey", F.expr(SIZE).alias("s"), F.expr("nullif(p_size % 3, 0)").alias("u"))
    return df.filter(F.col("s").eqNullSafe(F.col("u"))).select("p_partkey")


@query("is_null", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s IS NULL")
def _(t):
    return parts(t).filter(F.col("s").isNull()).select("p_partkey")


@query("is_not_null", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE s IS NOT NULL")
def _(t):
    return parts(t).filter(F.col("s").isNotNull()).select("p_partkey")


@query("is_true_false", f"SELECT p_partkey, (s > 4) IS TRUE AS is_t, (s > 4) IS FALSE AS is_f, (s > 4) IS NOT TRUE AS not_t, (s > 4) IS NOT FALSE AS not_f FROM (SELECT p_partkey, {SIZE} AS s FROM part)")
def _(t):
    p = F.col("s") > 4
    return parts(t).select("p_partkey", truth.is_true(p).alias("is_t"), truth.is_false(p).alias("is_f"), (~truth.is_true(p)).alias("not_t"), (~truth.is_false(p)).alias("not_f"))


@query("is_unknown", f"SELECT p_partkey FROM (SELECT p_partkey, {SIZE} AS s FROM part) WHERE (s > 4) IS NULL")
def _(t):
    return parts(t).filter(truth.is_unknown(F.col("s") > 4)).select("p_partkey")


@query("bare_boolean", "SELECT p_partkey FROM (SELECT p_partkey, p_size > 20 AS big FROM part) WHERE big")
def _(t):
    return t.part.select("p_partkey", (F.col("p_size") > 20).alias("big")).filter("big").select("p_partkey")


@query("select_alias_star", "SELECT *, p_size + 1 AS next_size FROM part")
def _(t):
    return t.part.select("*", (F.col("p_size") + 1).alias("next_size"))


@query("star_edit", "SELECT p_partkey, p_name, p_brand AS brand, p_type, p_size * 2 AS p_size FROM part")
def _(t):
    return shapes.star(t.part, exclude=["p_retailprice"], replace={"p_size": F.col("p_size") * 2}, rename={"p_brand": "brand"})


@query("select_distinct", f"SELECT DISTINCT {SIZE} AS s, p_brand FROM part")
def _(t):
    return parts(t).select("s", "p_brand").distinct()


@query("case_expressions", f"SELECT p_partkey, CASE WHEN s > 6 THEN 'big' WHEN s > 3 THEN 'mid' ELSE 'low' END AS searched, CASE s WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS simple FROM (SELECT p_partkey, {SIZE} AS s FROM part)")
def _(t):
    s = F.col("s")
    return parts(t).select("p_partkey", F.when(s > 6, "big").when(s > 3, "mid").otherwise("low").alias("searched"), S.simple_case(s, {1: "one", 2: "two"}).alias("simple"))


@query("coalesce_nullif", f"SELECT p_partkey, coalesce(s, -1) AS c, nullif(p_size, 5) AS n FROM (SELECT p_partkey, p_size, {SIZE} AS s FROM part)")
def _(t):
    return parts(t).select("p_partkey", F.coalesce("s", F.lit(-1)).alias("c"), F.nullif("p_size", F.lit(5)).alias("n"))


@query("arithmetic", "SELECT p_partkey, -p_size AS neg, +p_size AS pos, ~p_size AS inv, p_size + 7 AS a, p_size - 7 AS b, p_size * 7 AS c, p_size // 7 AS d, p_size % 7 AS e, p_size / 8.0::DOUBLE AS f FROM part")
def _(t):
    x = F.col("p_size")
    return t.part.select("p_partkey", (-x).alias("neg"), F.positive(x).alias("pos"), F.bitwise_not(x).alias("inv"), (x + 7).alias("a"), (x - 7).alias("b"), (x * 7).alias("c"), S.integer_divide(x, F.lit(7)).cast("int").alias("d"), (x % 7).alias("e"), (x / 8).alias("f"))


@query("bitwise", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x FROM part")
def _(t):
    x = F.col("p_size")
    return t.part.select("p_partkey", x.bitwiseAND(12).alias("a"), x.bitwiseOR(3).alias("o"), x.bitwiseXOR(5).alias("x"))


@query("abs_concat", "SELECT p_partkey, abs(p_size - 25) AS d, p_brand || '/' || p_type AS label FROM part")
def _(t):
    return t.part.select("p_partkey", F.abs(F.col("p_size") - 25).alias("d"), F.concat("p_brand", F.lit("/"), "p_type").alias("label"))


@query("casts", "SELECT p_partkey, CAST(p_size AS SMALLINT) AS s, CAST(p_partkey AS INTEGER) AS i, CAST(p_size AS BIGINT) AS b, TRY_CAST(p_brand AS INTEGER) AS bad FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_size").cast("smallint").alias("s"), F.col("p_partkey").cast("int").alias("i"), F.col("p_size").cast("bigint").alias("b"), S.safe_cast(F.col("p_brand"), "int").alias("bad"))


@query("decimal_literals", "SELECT p_partkey, CAST(p_size * 1.25 AS DECIMAL(20,2))::DOUBLE AS x, CAST(0.1 + 0.2 AS DECIMAL(10,1))::DOUBLE AS y FROM part")
def _(t):
    return t.part.selectExpr("p_partkey", "CAST(CAST(p_size * 1.25BD AS DECIMAL(20,2)) AS DOUBLE) AS x", "CAST(CAST(0.1BD + 0.2BD AS DECIMAL(10,1)) AS DOUBLE) AS y")


@query("temporal", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m, CAST(extract(day FROM o_orderdate) AS INTEGER) AS d, o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AS late, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < DATE '1998-01-01'")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.filter(d < F.expr("timestamp_ntz '1998-01-01 00:00:00'")).select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), (d >= F.expr("timestamp_ntz '1996-01-01 00:00:00'")).alias("late"), d.cast("date").alias("day"))


@query("temporal_extract_literal", "SELECT n_nationkey, CAST(extract(year FROM DATE '2024-02-29') AS INTEGER) AS y, CAST(extract(month FROM DATE '2024-02-29') AS INTEGER) AS m, CAST(extract(day FROM DATE '2024-02-29') AS INTEGER) AS d FROM nation")
def _(t):
    return t.nation.selectExpr("n_nationkey", "year(date'2024-02-29') AS y", "month(date'2024-02-29') AS m", "day(date'2024-02-29') AS d")


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("values_table", "SELECT * FROM (VALUES (1, 10), (1, 10), (2, 20), (3, NULL), (NULL, 10), (4, -5)) v(id, amount)")
def _(t):
    return t.values("SELECT * FROM VALUES (1, 10), (1, 10), (2, 20), (3, NULL), (NULL, 10), (4, -5) AS v(id, amount)")


@query("derived_table", "SELECT brand, n FROM (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand) d WHERE n > 1")
def _(t):
    return t.part.groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("unnest_plain", "SELECT p_partkey, unnest([p_size, p_size + 1, NULL]) AS v FROM part")
def _(t):
    df = t.part.select("p_partkey", F.array(F.col("p_size"), F.col("p_size") + 1, F.lit(None).cast("int")).alias("a"))
    return shapes.unnest(df, "a", "v")


@query("unnest_offset", "SELECT p_partkey, i - 1 AS off, a[i] AS v FROM (SELECT p_partkey, a, unnest(range(1, 4)) AS i FROM (SELECT p_partkey, [p_size, 7, NULL] AS a FROM part))")
def _(t):
    df = t.part.select("p_partkey", F.array(F.col("p_size"), F.lit(7), F.lit(None).cast("int")).alias("a"))
    return shapes.unnest(df, "a", "v", offset="off")


@query("unnest_ordinality", "SELECT p_partkey, i AS ord, a[i] AS v FROM (SELECT p_partkey, a, unnest(range(1, 4)) AS i FROM (SELECT p_partkey, [p_size, 7, NULL] AS a FROM part))")
def _(t):
    df = t.part.select("p_partkey", F.array(F.col("p_size"), F.lit(7), F.lit(None).cast("int")).alias("a"))
    return shapes.unnest(df, "a", "v", offset="ord", first=1)


@query("unnest_joined_grouped", "SELECT v AS tag, count(*) AS n FROM (SELECT unnest([p_size % 3, p_size % 5]) AS v FROM part) JOIN (VALUES (0), (1), (2)) k(x) ON v = x GROUP BY v")
def _(t):
    tags = shapes.unnest(t.part.select(F.array(F.col("p_size") % 3, F.col("p_size") % 5).alias("a")), "a", "tag")
    return tags.join(t.values("SELECT * FROM VALUES (0), (1), (2) AS k(x)"), F.col("tag") == F.col("x")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("pivot_sum", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber END)::BIGINT AS o, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber END)::BIGINT AS f FROM lineitem GROUP BY l_returnflag")
def _(t):
    return shapes.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", ["O", "F"], F.sum("l_linenumber"), ["o", "f"])


@query("unpivot", f"SELECT p_partkey, 's' AS k, {SIZE} AS v FROM part WHERE {SIZE} IS NOT NULL UNION ALL SELECT p_partkey, 'p_size', p_size FROM part")
def _(t):
    return shapes.unpivot(parts(t).select("p_partkey", "s", "p_size"), ["p_partkey"], ["s", "p_size"], "k", "v")


@query("unpivot_nulls", f"SELECT p_partkey, 's' AS k, {SIZE} AS v FROM part UNION ALL SELECT p_partkey, 'p_size', p_size FROM part")
def _(t):
    return shapes.unpivot(parts(t).select("p_partkey", "s", "p_size"), ["p_partkey"], ["s", "p_size"], "k", "v", include_nulls=True)


@query("sample_bernoulli")
def _(t):
    """Membership is the engine's own choice; the seed makes it repeatable."""
    return t.part.sample(fraction=0.5, seed=11).select("p_partkey")
