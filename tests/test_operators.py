"""Operators on small bags with nulls, repeated rows, ties and no rows."""

import pytest
from pyspark.sql import functions as F

from bagwright.operators import aggregates, joins, pages, sets, shapes, subqueries, truth, windows, writes
from tests.conftest import bag

ORDERS = [(1, 10), (1, 10), (2, 20), (3, None), (None, 10), (4, -5)]
CUSTOMERS = [(1, 10), (1, 10), (2, 100), (5, -5), (None, 10)]


@pytest.fixture()
def orders(spark):
    return spark.createDataFrame(ORDERS, "id int, amount int")


@pytest.fixture()
def customers(spark):
    return spark.createDataFrame(CUSTOMERS, "cid int, limit int")


def test_truth_partition_loses_no_row(orders):
    got = {r["truth"]: r["n"] for r in truth.truth_counts(orders, F.col("amount") > 5).collect()}
    assert got == {"TRUE": 4, "FALSE": 1, "UNKNOWN": 1}


def test_safe_prefix():
    assert truth.safe_prefix("ab%") == ("ab", False)
    assert truth.safe_prefix("a\\_b%") == ("a_b", False)
    assert truth.safe_prefix("abc") == ("abc", True)
    assert truth.safe_prefix("a_c%") is None and truth.safe_prefix("%a") is None


def test_right_semi_keeps_repeated_rows(orders, customers):
    on = F.col("id") == F.col("cid")
    assert sorted(map(tuple, joins.right_semi(orders, customers, on).collect())) == [(1, 10), (1, 10), (2, 100)]
    assert len(joins.right_anti(orders, customers, on).collect()) == 2


def test_null_safe_join_matches_nulls(orders, customers):
    assert joins.null_safe(orders, customers, [("id", "cid")]).count() == 6


FEW_LEFT = [(1, 1), (1, 1), (1, 2), (2, 3), (None, 4), (3, None)]
FEW_RIGHT = [(1, 7, "x"), (1, 7, "x"), (1, None, None), (None, 8, "y"), (4, 9, "z"), (3, None, "w")]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("columns", [["k", "w"], ["k", "w", "z"]])
def test_few_keys_is_the_join(spark, how, columns):
    left = spark.createDataFrame(FEW_LEFT, "k int, v int")
    right = spark.createDataFrame(FEW_RIGHT, "k int, w int, z string").select(*columns)
    for a, b in ((left, right), (left.limit(0), right), (left, right.limit(0))):
        got = joins.few_keys(a, b, ["k"], how)
        assert got.columns == ["k", "v", *columns[1:]] and bag(got) == bag(a.join(b, ["k"], how))
        loud = b.withColumnRenamed("k", "k2")
        want = joins.null_safe(a, loud, [("k", "k2")], how).select(F.coalesce("k", "k2").alias("k"), "v", *columns[1:])
        assert bag(joins.few_keys(a, b, ["k"], how, null_safe=True)) == bag(want)


def test_few_keys_spreads_one_key(spark):
    """A key's pairs are made by many tasks, none of which makes them all."""
    got = joins.few_keys(spark.range(4000).selectExpr("id DIV 4000 AS k", "id AS v"), spark.range(50).selectExpr("id DIV 50 AS k", "id AS w"), ["k"])
    made = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(made) == 200_000 and len(made) >= 8 and max(made) < 60_000


def test_asof_ties_nulls_and_empty(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (None, 5, "c"), (2, 1, "d")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 3, 1), (1, 5, 2), (1, 5, 7), (1, 6, 9), (None, 1, 4)], "k int, u int, v int")
    got = {r["x"]: r["v"] for r in joins.asof(left, right, ["k"], "t", "u", ["v"], "v").collect()}
    assert got == {"a": 7, "b": None, "c": None, "d": None}
    assert joins.asof(left, right.limit(0), ["k"], "t", "u", ["v"], "v").count() == 4
    assert joins.asof(left, right, ["k"], "t", "u", ["v"], "v", how="inner").count() == 1


def test_set_laws_agree_with_operations(spark, orders, customers):
    right = customers.toDF("id", "amount")
    for kind in sets.LAWS:
        law = sets.multiplicities(kind, orders, right).filter("n > 0").select("id", "amount", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")
        assert bag(law) == bag(sets.apply(kind, orders, right)), kind


def test_union_by_name_needs_equal_names(orders, customers):
    with pytest.raises(ValueError):
        sets.union_by_name(orders, customers)


def test_ties_and_nulls_at_the_edge(spark, orders):
    got = pages.first_with_ties(orders, [("amount", "asc")], 2)
    assert sorted(r["amount"] for r in got.collect()) == [-5, 10, 10, 10]
    assert pages.first_with_ties(orders, [("amount", "asc")], 6).count() == 6
    assert pages.first_with_ties(orders, [("amount", "desc")], 1).collect()[0]["amount"] == 20
    assert pages.first_with_ties(orders.limit(0), [("amount", "asc")], 2).count() == 0


IN_CASES = [([1, 2], [1]), ([1, None], [1, None]), ([None], []), ([], [1]), ([2], [None])]


@pytest.mark.parametrize("outer,inner", IN_CASES)
def test_in_three_valued(spark, outer, inner):
    o = spark.createDataFrame([(x,) for x in outer], "x int")
    i = spark.createDataFrame([(x,) for x in inner], "y int")
    got = {r["x"]: r["_in"] for r in subqueries.with_in(o, ["x"], i, ["y"]).collect()}
    for x in outer:
        want = False if not inner else (True if x is not None and x in inner else None if x is None or None in inner else False)
        assert got[x] is want


def test_tuple_in_three_valued(spark):
    values = [None, 0, 1]
    pairs = [(a, b) for a in values for b in values]
    o = spark.createDataFrame(pairs, "a int, b int")
    for inner in ([(0, 0)], [(0, None)], [(None, None)], [(0, 1), (None, 0)], []):
        i = spark.createDataFrame(inner, "c int, d int")
        for r in subqueries.with_in(o, ["a", "b"], i, ["c", "d"]).collect():
            want = False
            for c, d in inner:
                parts = [None if None in p else p[0] == p[1] for p in ((r["a"], c), (r["b"], d))]
                hit = False if False in parts else None if None in parts else True
                want = True if want is True or hit is True else None if want is None or hit is None else False
            assert r["_in"] is want, (tuple(r), inner)


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("quantifier", ["ANY", "ALL"])
def test_quantified_three_valued(spark, op, quantifier):
    import operator

    f = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    rows = [(g, x) for g in range(5) for x in (None, 1, 2, 3)]
    inner = {0: [], 1: [2], 2: [2, None], 3: [None], 4: [1, 3]}
    o = spark.createDataFrame(rows, "g int, x int")
    i = spark.createDataFrame([(g, v) for g, vs in inner.items() for v in vs], "h int, y int")
    for r in subqueries.with_quantified(o, "x", op, quantifier, i, "y", [("g", "h")]).collect():
        each = [None if r["x"] is None or v is None else f(r["x"], v) for v in inner[r["g"]]]
        want = (True if True in each else None if None in each else False) if quantifier == "ANY" else (False if False in each else None if None in each else True)
        assert r["_q"] is want, tuple(r)


def test_scalar_subquery_raises_on_two_rows(spark, orders, customers):
    assert subqueries.scalar(orders, customers.filter("cid = 2"), F.col("limit"), [("id", "cid")], "v").filter("id = 2").collect()[0]["v"] == 100
    with pytest.raises(Exception, match="more than one row"):
        subqueries.scalar(orders, customers, F.col("limit"), [("id", "cid")], "v").collect()


def test_fixpoint_ends(spark):
    got = subqueries.fixpoint(spark.sql("SELECT 1 AS n"), lambda d: d.select(((F.col("n") * 3) % 7).cast("int").alias("n")))
    assert sorted(r["n"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]


def test_groups_frame(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 0, 20), (4, 0, 30), (5, 0, None), (6, 1, 7), (7, 1, None)], "id int, k int, x int")
    got = windows.groups_frame(df, ["k"], [F.asc_nulls_last("x")], -1, 0, {"s": F.sum("x")})
    assert {r["id"]: r["s"] for r in got.collect()} == {1: 20, 2: 20, 3: 40, 4: 50, 5: 30, 6: 7, 7: 7}


def test_contributors_of_groups(spark, orders):
    df = orders.withColumn("rid", F.monotonically_increasing_id())
    groups, rows = aggregates.groups_with_contributors(df, ["id"], "rid", [F.sum("amount").alias("s")], F.col("s") > 5)
    assert {r["id"]: r["_truth"] for r in groups.collect()} == {1: "TRUE", 2: "TRUE", 3: "UNKNOWN", None: "TRUE", 4: "FALSE"}
    assert sorted(str(r["id"]) for r in rows.collect()) == ["1", "1", "2", "None"]


def test_star_and_unnest(spark, orders):
    with pytest.raises(ValueError):
        shapes.star(orders, exclude=["nope"])
    df = spark.createDataFrame([(1, [5, None]), (2, []), (3, None)], "id int, a array<int>")
    assert [tuple(r) for r in shapes.unnest(df, "a", "v", offset="o", first=1).orderBy("id", "o").collect()] == [(1, 1, 5), (1, 2, None)]
    assert shapes.unnest(df, "a", "v", outer=True).count() == 4


KEYED = [(1, 10), (2, 20), (3, None)]


def keyed(spark):
    return writes.State({"t": writes.Relation(spark.createDataFrame(KEYED, "id int, amount int"), constraints=(writes.Constraint("primary_key", ("id",)),))})


def test_merge_with_two_matches_raises(spark):
    src = spark.createDataFrame([(1, 5), (1, 6)], "sid int, v int")
    moved = writes.merge(keyed(spark), "t", src, [("id", "sid")], [writes.Branch("matched", "update", {"amount": F.col("v")})])
    with pytest.raises(Exception, match="more than one match"):
        moved.after["t"].rows.collect()


def test_merge_null_keys_do_not_match(spark):
    src = spark.createDataFrame([(None, 5), (2, 6), (9, 7)], "sid int, v int")
    moved = writes.merge(keyed(spark), "t", src, [("id", "sid")], [writes.Branch("matched", "update", {"amount": F.col("v")}), writes.Branch("not_matched", "insert", {"id": F.col("sid"), "amount": F.col("v")}, F.col("sid").isNotNull())])
    assert sorted(map(tuple, moved.after["t"].rows.fillna(-1).collect())) == [(1, 10), (2, 6), (3, -1), (9, 7)]
    assert moved.affected.count() == 2


def test_update_from_with_two_matches_raises(spark):
    src = spark.createDataFrame([(1, 5), (1, 6)], "sid int, v int")
    moved = writes.update(keyed(spark), "t", {"amount": F.col("v")}, source=src, on=F.col("id") == F.col("sid"), row_id=["id"])
    with pytest.raises(Exception, match="more than one match"):
        moved.after["t"].rows.collect()


def test_script_keeps_constraints_and_rolls_back(spark):
    new = spark.createDataFrame([(1, 1)], "id int, amount int")
    with pytest.raises(writes.ConstraintError):
        writes.script(keyed(spark), [lambda s: writes.insert(s, "t", new)])
    steps = ["BEGIN", lambda s: writes.delete(s, "t"), "ROLLBACK", lambda s: writes.insert(s, "t", new, on_conflict=["id"])]
    out = writes.script(keyed(spark), steps)
    assert out[-1].after["t"].rows.count() == 3 and out[-1].affected.count() == 0
    with pytest.raises(ValueError):
        writes.script(keyed(spark), ["COMMIT"])


def test_script_cuts_lineage(spark):
    steps = [lambda s: writes.update(s, "t", {"amount": F.col("amount") + 1})] * 9
    assert sorted(map(tuple, writes.script(keyed(spark), steps, check=False)[-1].after["t"].rows.fillna(0).collect())) == [(1, 19), (2, 29), (3, 0)]


def test_ddl(spark):
    s = writes.create(keyed(spark), "u", "a int, b string", spark).after
    assert s["u"].rows.count() == 0
    with pytest.raises(ValueError):
        writes.create(s, "u", "a int", spark)
    with pytest.raises(KeyError):
        writes.drop(s, "nope")
    assert "u" not in writes.drop(s, "u").after and writes.drop(s, "nope", if_exists=True).after["u"]
    with pytest.raises(ValueError):
        writes.drop_column(s, "t", "id")
    assert writes.rename_column(s, "t", "id", "key").after["t"].constraints[0].columns == ("key",)


def test_salted_join_and_histogram(spark, orders, customers):
    a, b = orders.withColumnRenamed("id", "k"), customers.withColumnRenamed("cid", "k")
    assert joins.salted(a, b, "k", 3).count() == 5
    h = joins.key_histogram(orders, customers, "id", "cid").agg(F.sum("pairs")).collect()[0][0]
    assert h == 5


def test_temporal_theta_joins_every_customer(spark, tmp_path):
    from datetime import datetime, timedelta

    from bagwright import queries

    queries.load_all()
    day = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(8)]
    events = [(i, None if i % 13 == 0 else 15 + i % 12, None if i % 11 == 0 else day[i % 7]) for i in range(60)]
    placed = [(i, None if i % 17 == 0 else 15 + i % 11, None if i % 19 == 0 else day[i % 8]) for i in range(50)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(placed, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted((e, o) for e, u, ts in events for o, c, at in placed if None not in (u, ts, at) and u == c and at >= ts)
    assert any(placed[o][1] > 20 for _, o in want)
    assert sorted(map(tuple, queries.QUERIES["join_temporal_theta"](spark, str(tmp_path)).collect())) == want


def test_window_over_groups_ranks_every_group(spark, data):
    from bagwright import queries

    queries.load_all()
    ranked = queries.QUERIES["win_over_group"](spark, data)
    placed = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey").distinct().count()
    assert placed > 20 and ranked.count() == placed == ranked.select("o_custkey").distinct().count()


def _relation(spark):
    from bagwright.operators import writes as W

    rows = spark.createDataFrame([(1, 5, 10), (2, 6, 12), (2, 6, 12)], "id int, v int, g int")
    return W, W.Relation(rows, defaults={"v": F.lit(9)}, generated={"g": F.col("v") * 2})


def test_ambiguous_update_raises_and_generated_columns_follow(spark):
    W, rel = _relation(spark)
    state = W.State({"t": rel})
    two = spark.createDataFrame([(1, 7), (1, 8)], "sid int, w int")
    with pytest.raises(Exception, match="more than one match"):
        W.update(state, "t", {"v": F.col("w")}, source=two, on=F.col("id") == F.col("sid")).after["t"].rows.collect()
    one = W.update(state, "t", {"v": F.col("w")}, source=two.limit(1), on=F.col("id") == F.col("sid")).after["t"].rows
    assert sorted(map(tuple, one.collect())) == [(1, 7, 14), (2, 6, 12), (2, 6, 12)]
    merged = W.merge(state, "t", spark.createDataFrame([(1, 50)], "id int, w int"), [("id", "id")], [W.Branch("matched", "update", {"v": F.col("source.w")})])
    assert (1, 50, 100) in set(map(tuple, merged.after["t"].rows.collect()))
    with pytest.raises(ValueError, match="generated"):
        W.insert(state, "t", spark.createDataFrame([(3, 3)], "id int, g int"))


def test_renames_and_drops_keep_declarations(spark):
    W, rel = _relation(spark)
    child = W.Relation(spark.createDataFrame([(1,)], "ref int"), constraints=(W.Constraint("foreign_key", ("ref",), "t", ("id",)),))
    state = W.State({"t": rel, "c": child})
    moved = W.rename_column(state, "t", "id", "key").after
    assert moved["c"].constraints[0].parent_columns == ("key",) and moved.checked("t")
    assert W.rename(moved, "t", "u").after.checked("u")["c"].constraints[0].parent == "u"
    with pytest.raises(ValueError, match="generated"):
        W.rename_column(state, "t", "v", "w")
    plain = W.drop_column(state, "t", "g").after
    renamed = W.rename_column(plain, "t", "v", "w").after
    assert (4, 9) in set(map(tuple, W.insert(renamed, "t", spark.createDataFrame([(4,)], "id int")).after["t"].rows.collect()))
    with pytest.raises(ValueError, match="refers"):
        W.drop_column(state, "t", "id")
    assert not plain["t"].generated and W.rename_column(state, "t", "g", "h").after["t"].generated.keys() == {"h"}


def test_identity_numbers_are_dense_over_many_tasks(spark):
    W, _ = _relation(spark)
    state = W.State({"t": W.Relation(spark.createDataFrame([], "no long, v long"), identity={"no": W.Identity(3, 2)})})
    for part in (range(50, 100), range(50)):
        state = W.insert(state, "t", spark.createDataFrame([(i,) for i in part], "v long").repartition(7)).after
    got = sorted(map(tuple, state["t"].rows.collect()))
    assert [n for n, _ in got] == [3 + 2 * i for i in range(100)] and [v for _, v in got] == [*range(50, 100), *range(50)]


def test_sql_of_writes_says_what_it_cannot_read(spark):
    from bagwright.operators import writes as W
    from bagwright.sources.statements import execute

    state = W.State({"t": spark.createDataFrame([(1, 2)], "a int, b int")})
    for text in ("VACUUM t", "MERGE INTO t USING t AS s ON t.a > s.a WHEN MATCHED THEN DELETE", "INSERT INTO t (a) VALUES (1, 2)", "INSERT INTO t VALUES (1, 2) ON CONFLICT (a) DO UPDATE SET b = 1"):
        with pytest.raises(ValueError):
            execute(spark, state, text)
    made = execute(spark, state, "CREATE TABLE u (id INT PRIMARY KEY, v INT DEFAULT 4 CHECK (v > 3), w INT GENERATED ALWAYS AS (v * 2) STORED, r INT REFERENCES t (a)); INSERT INTO u (id, r) VALUES (1, 1)")
    assert [tuple(r) for r in made[-1].after["u"].rows.collect()] == [(1, 4, 8, 1)]
    for text in ("INSERT INTO u (id, v) VALUES (2, 1)", "INSERT INTO u (id) VALUES (1)", "INSERT INTO u (id, r) VALUES (3, 77)"):
        with pytest.raises(W.ConstraintError):
            execute(spark, made[-1].after, text)
    empty = execute(spark, made[-1].after, "INSERT INTO t DEFAULT VALUES")[-1].after["t"].rows.collect()
    assert sorted(map(str, map(tuple, empty))) == ["(1, 2)", "(None, None)"]


def test_sliced_asof_equals_the_plain_one(spark):
    from bagwright.operators import joins as J

    left = spark.createDataFrame([(k, i, i * 7 % 41) for i, k in enumerate([1, 1, 1, 2, None, 3] * 8)], "k int, n int, at int")
    right = spark.createDataFrame([(k, i * 5 % 37, i) for i, k in enumerate([1, 1, 2, None] * 6)], "k int, at int, e int")
    plain = J.asof(left, right, ["k"], "at", "at", ["e"], "e")
    for how in ("left", "inner"):
        whole = J.asof(left, right, ["k"], "at", "at", ["e"], "e", how)
        sliced = J.asof(left, right, ["k"], "at", "at", ["e"], "e", how, slices=lambda c: F.floor(c / 10))
        assert sorted(map(str, whole.collect())) == sorted(map(str, sliced.collect()))
    assert plain.count() == left.count()
