"""Writes as before and after states, and constraint checks."""

from pyspark.sql import functions as F

from bagwright.operators import writes as W
from bagwright.queries import ORACLES, query

ACC = "(SELECT c_custkey AS id, c_nationkey AS k, nullif(c_custkey % 5, 0) AS amount FROM customer)"
SRC = "(SELECT s_suppkey * 3 AS sid, s_nationkey AS sk, nullif(s_suppkey % 4, 0) AS add_amount FROM supplier)"
KEY = (W.Constraint("primary_key", ("id",)),)


def state(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.expr("nullif(c_custkey % 5, 0)").alias("amount"))
    return W.State({"acc": W.Relation(rows, constraints=KEY, defaults={"amount": F.lit(7)})})


def source(t):
    return t.supplier.select((F.col("s_suppkey") * 3).alias("sid"), F.col("s_nationkey").alias("sk"), F.expr("nullif(s_suppkey % 4, 0)").alias("add_amount"))


def after(moved, name="acc"):
    return moved.after[name].rows


@query("dml_insert_select", f"SELECT id, k, amount FROM {ACC} UNION ALL SELECT sid + 1000000, sk, 7 FROM {SRC}")
def _(t):
    return after(W.insert(state(t), "acc", source(t).select((F.col("sid") + 1000000).alias("id"), F.col("sk").alias("k"))))


@query("dml_insert_values", f"SELECT id, k, amount FROM {ACC} UNION ALL SELECT * FROM (VALUES (-1, 3, NULL), (-2, NULL, 5))")
def _(t):
    return after(W.insert(state(t), "acc", t.values("SELECT * FROM VALUES (-1, 3, CAST(NULL AS INT)), (-2, NULL, 5) AS v(id, k, amount)")))


@query("dml_insert_default_values", f"SELECT id, k, amount FROM {ACC} UNION ALL SELECT -9, NULL, 7")
def _(t):
    return after(W.insert(state(t), "acc", t.values("SELECT -9 AS id")))


@query("dml_returning", "SELECT sid + 1000000 AS id, 7::BIGINT AS amount FROM " + SRC)
def _(t):
    return W.insert(state(t), "acc", source(t).select((F.col("sid") + 1000000).alias("id"), F.col("sk").alias("k")), returning=["id", "amount"]).returning


@query("dml_conflict", f"SELECT id, k, amount FROM {ACC} UNION ALL SELECT sid, sk, 7 FROM {SRC} WHERE sid NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    return after(W.insert(state(t), "acc", source(t).select(F.col("sid").alias("id"), F.col("sk").alias("k")), on_conflict=["id"]))


@query("dml_update", f"SELECT id, k, CASE WHEN coalesce(amount > 2, FALSE) THEN amount * 10 + k ELSE amount END AS amount FROM {ACC}")
def _(t):
    return after(W.update(state(t), "acc", {"amount": F.col("amount") * 10 + F.col("k")}, F.col("amount") > 2))


@query("dml_update_from", f"SELECT id, k, CASE WHEN sid IS NOT NULL THEN amount + add_amount ELSE amount END AS amount FROM {ACC} LEFT JOIN {SRC} ON id = sid")
def _(t):
    return after(W.update(state(t), "acc", {"amount": F.col("amount") + F.col("add_amount")}, source=source(t), on=F.col("id") == F.col("sid"), row_id=["id"]))


@query("dml_delete", f"SELECT id, k, amount FROM {ACC} WHERE NOT coalesce(amount > 2, FALSE)")
def _(t):
    return after(W.delete(state(t), "acc", F.col("amount") > 2))


@query("dml_delete_using", f"SELECT id, k, amount FROM {ACC} a WHERE NOT EXISTS (SELECT 1 FROM {SRC} WHERE sid = a.id AND add_amount > 1)")
def _(t):
    return after(W.delete(state(t), "acc", using=source(t), on=(F.col("id") == F.col("sid")) & (F.col("add_amount") > 1)))


@query("dml_delete_affected", f"SELECT id FROM {ACC} WHERE amount > 2")
def _(t):
    return W.delete(state(t), "acc", F.col("amount") > 2, returning=["id"]).returning


@query(
    "dml_merge",
    f"SELECT coalesce(id, sid) AS id, CASE WHEN id IS NULL THEN sk ELSE k END AS k, CASE WHEN id IS NULL THEN add_amount WHEN sid IS NOT NULL THEN add_amount ELSE amount END AS amount FROM {ACC} FULL JOIN {SRC} ON id = sid WHERE NOT (id IS NOT NULL AND sid IS NOT NULL AND coalesce(add_amount = 1, FALSE)) AND NOT (sid IS NULL AND coalesce(amount = 4, FALSE))",
)
def _(t):
    branches = [
        W.Branch("matched", "delete", condition=F.col("add_amount") == 1),
        W.Branch("matched", "update", {"amount": F.col("add_amount")}),
        W.Branch("not_matched", "insert", {"id": F.col("sid"), "k": F.col("sk"), "amount": F.col("add_amount")}),
        W.Branch("not_matched_by_source", "delete", condition=F.col("amount") == 4),
    ]
    return after(W.merge(state(t), "acc", source(t), [("id", "sid")], branches))


@query("dml_alter", f"SELECT id, k::VARCHAR AS nation, 5 AS extra FROM {ACC}")
def _(t):
    s = W.add_column(state(t), "acc", "extra", "int", F.lit(5)).after
    s = W.rename_column(s, "acc", "k", "nation").after
    s = W.set_type(s, "acc", "nation", "string").after
    return after(W.drop_column(s, "acc", "amount"))


@query("dml_truncate", f"SELECT id, k, amount FROM {ACC} WHERE FALSE")
def _(t):
    return after(W.truncate(state(t), "acc"))


@query("dml_ctas_rename", f"SELECT k, count(*) AS n FROM {ACC} GROUP BY k")
def _(t):
    s = W.create(state(t), "counts", state(t)["acc"].rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))).after
    return after(W.rename(W.drop(s, "acc").after, "counts", "acc"))


@query("dml_generated", f"SELECT id, k, amount, abs(coalesce(amount, 0) - 3) AS g FROM (SELECT id, k, amount FROM {ACC} UNION ALL SELECT sid + 1000000, sk, add_amount FROM {SRC})")
def _(t):
    rule = F.abs(F.coalesce("amount", F.lit(0)) - 3)
    rel = W.Relation(state(t)["acc"].rows.withColumn("g", rule), generated={"g": rule})
    return after(W.insert(W.State({"acc": rel}), "acc", source(t).select((F.col("sid") + 1000000).alias("id"), F.col("sk").alias("k"), F.col("add_amount").alias("amount"))))


@query("dml_script", f"SELECT id, k, amount + 1 AS amount FROM {ACC} WHERE NOT coalesce(amount = 3, FALSE)")
def _(t):
    steps = [lambda s: W.delete(s, "acc", F.col("amount") == 3), lambda s: W.update(s, "acc", {"amount": F.col("amount") + 1})]
    return after(W.script(state(t), steps)[-1])


@query("dml_rollback", f"SELECT id, k, amount FROM {ACC} WHERE NOT coalesce(amount = 3, FALSE)")
def _(t):
    steps = [lambda s: W.delete(s, "acc", F.col("amount") == 3), "BEGIN", lambda s: W.truncate(s, "acc"), "ROLLBACK"]
    return after(W.script(state(t), steps)[-1])


def checked(t, constraint, rows=None):
    rel = W.Relation(rows if rows is not None else t.orders, constraints=(constraint,))
    return W.violations(rel, W.State({"o": rel, "customer": t.customer.filter("c_custkey % 50 <> 0"), "nation": t.nation}))


@query("chk_pk", "SELECT 'primary_key(o_custkey)' AS \"constraint\", o_custkey::VARCHAR AS detail, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(t):
    return checked(t, W.Constraint("primary_key", ("o_custkey",)))


@query("chk_unique", "SELECT 'unique(n_regionkey, n_name)' AS \"constraint\", n_regionkey || ', ' || n_name AS detail, count(*) AS n FROM nation GROUP BY n_regionkey, n_name HAVING count(*) > 1")
def _(t):
    return checked(t, W.Constraint("unique", ("n_regionkey", "n_name")), t.nation)


@query("chk_fk", "SELECT 'foreign_key(o_custkey)' AS \"constraint\", o_custkey::VARCHAR AS detail, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) GROUP BY o_custkey")
def _(t):
    return checked(t, W.Constraint("foreign_key", ("o_custkey",), "customer", ("c_custkey",)))


@query("chk_not_null", "SELECT 'not_null(k)' AS \"constraint\", 'NULL' AS detail, count(*) AS n FROM customer WHERE c_nationkey % 5 = 0 HAVING count(*) > 0")
def _(t):
    return checked(t, W.Constraint("not_null", ("k",)), t.customer.select(F.expr("nullif(c_nationkey % 5, 0)").alias("k")))


@query("chk_accepted", "SELECT 'accepted_values(o_orderstatus)' AS \"constraint\", o_orderstatus AS detail, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 2")
def _(t):
    return checked(t, W.Constraint("accepted_values", ("o_orderstatus",), values=("F", "O")))


@query("chk_check", "SELECT 'check(k > 1)' AS \"constraint\", 'k > 1' AS detail, count(*) AS n FROM (SELECT nullif(c_nationkey % 5, 0) AS k FROM customer) WHERE NOT k > 1 HAVING count(*) > 0")
def _(t):
    return checked(t, W.Constraint("check", check="k > 1"), t.customer.select(F.expr("nullif(c_nationkey % 5, 0)").alias("k")))


@query("dml_nested", "SELECT p_partkey AS id, array_to_string([p_size, p_size + 1], ',') AS sizes, p_brand AS brand FROM part UNION ALL SELECT -1, '9', 'new'")
def _(t):
    """Arrays and structs in a written relation."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.array("p_size", F.col("p_size") + 1).alias("sizes"), F.struct(F.col("p_brand").alias("brand")).alias("info"))
    new = t.values("SELECT -1 AS id, array(9) AS sizes, named_struct('brand', 'new') AS info")
    shown = after(W.insert(W.State({"n": rows}), "n", new), "n")
    return shown.select("id", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"), F.col("info.brand").alias("brand"))


def sql(t, text, dialect="generic"):
    """The state after a script of SQL text; src is the source relation."""
    from bagwright.sources.statements import execute

    begin = W.State({"acc": state(t)["acc"], "src": W.Relation(source(t))})
    return execute(t.spark, begin, text, dialect)


@query("dml_sql_insert", f"SELECT id, k, amount FROM {ACC} UNION ALL SELECT sid + 1000000, sk, 7 FROM {SRC} UNION ALL VALUES (-1, 3, NULL), (-2, NULL, 5)")
def _(t):
    return after(sql(t, "INSERT INTO acc (id, k) SELECT sid + 1000000, sk FROM src; INSERT INTO acc VALUES (-1, 3, NULL), (-2, NULL, 5)")[-1])


@query("dml_sql_insert_with", f"SELECT id, k, amount FROM {ACC} UNION ALL SELECT max(sid) + 1000000, count(*)::INTEGER, 1 FROM {SRC}")
def _(t):
    return after(sql(t, "INSERT INTO acc WITH m AS (SELECT max(sid) + 1000000 AS id, count(*) AS n FROM src) SELECT id, n, 1 FROM m")[-1])


@query("dml_sql_conflict", "SELECT sid AS id, 7::BIGINT AS amount FROM " + SRC + " WHERE sid NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    return sql(t, "INSERT INTO acc (id, k) SELECT sid, sk FROM src ON CONFLICT (id) DO NOTHING RETURNING id, amount")[-1].returning


@query("dml_sql_update", f"SELECT id, CASE WHEN coalesce(amount > 2, FALSE) THEN 7 ELSE k END AS k, CASE WHEN coalesce(amount > 2, FALSE) THEN amount * 10 + k ELSE amount END AS amount FROM {ACC}")
def _(t):
    return after(sql(t, "UPDATE acc SET amount = amount * 10 + acc.k, k = 7 WHERE acc.amount > 2")[-1])


@query("dml_sql_update_from", f"SELECT id, k, CASE WHEN sid IS NOT NULL THEN amount + add_amount ELSE amount END AS amount FROM {ACC} LEFT JOIN {SRC} ON id = sid")
def _(t):
    return after(sql(t, "UPDATE acc AS a SET amount = a.amount + s.add_amount FROM src s WHERE a.id = s.sid")[-1])


@query("dml_sql_update_cte", f"SELECT id, k, CASE WHEN k IN (SELECT sk FROM {SRC}) THEN (SELECT max(sid) FROM {SRC}) ELSE amount END AS amount FROM {ACC}")
def _(t):
    return after(sql(t, "WITH m AS (SELECT DISTINCT sk FROM src) UPDATE acc SET amount = (SELECT max(sid) FROM src) WHERE k IN (SELECT sk FROM m)")[-1])


@query("dml_sql_delete_using", f"SELECT id, k, amount FROM {ACC} a WHERE NOT EXISTS (SELECT 1 FROM {SRC} WHERE sid = a.id AND add_amount > 1)")
def _(t):
    return after(sql(t, "DELETE FROM acc USING src WHERE acc.id = src.sid AND add_amount > 1")[-1])


@query("dml_sql_delete_cte", f"SELECT id FROM {ACC} WHERE k NOT IN (SELECT sk FROM {SRC} WHERE sk IS NOT NULL)")
def _(t):
    return sql(t, "WITH m AS (SELECT sk FROM src WHERE sk IS NOT NULL) DELETE FROM acc WHERE k NOT IN (SELECT sk FROM m) RETURNING id")[-1].returning


@query("dml_sql_merge", ORACLES["dml_merge"])
def _(t):
    text = """
    MERGE INTO acc AS a USING src AS s ON a.id = s.sid
    WHEN MATCHED AND s.add_amount = 1 THEN DELETE
    WHEN MATCHED THEN UPDATE SET amount = s.add_amount
    WHEN NOT MATCHED THEN INSERT (id, k, amount) VALUES (s.sid, s.sk, s.add_amount)
    WHEN NOT MATCHED BY SOURCE AND a.amount = 4 THEN DELETE
    """
    return after(sql(t, text)[-1])


@query("dml_sql_transaction", f"SELECT id, k, amount FROM {ACC} WHERE NOT coalesce(amount = 3, FALSE) UNION ALL SELECT -1, 1, 1")
def _(t):
    return after(sql(t, "DELETE FROM acc WHERE amount = 3; BEGIN TRANSACTION; TRUNCATE TABLE acc; ROLLBACK; BEGIN; INSERT INTO acc VALUES (-1, 1, 1); COMMIT")[-1])


@query("dml_sql_alter", f"SELECT id, k::VARCHAR AS nation, 5 AS extra FROM {ACC} UNION ALL SELECT -1, '3', 5")
def _(t):
    text = "ALTER TABLE acc ADD COLUMN extra INT DEFAULT 5; ALTER TABLE acc RENAME COLUMN k TO nation; ALTER TABLE acc ALTER COLUMN nation SET DATA TYPE STRING; ALTER TABLE acc DROP COLUMN amount; INSERT INTO acc (id, nation) VALUES (-1, '3')"
    return after(sql(t, text)[-1])


@query("dml_sql_select_into", f"SELECT k, count(*) AS n FROM {ACC} GROUP BY k")
def _(t):
    return after(sql(t, "SELECT k, count(*) AS n INTO counts FROM acc GROUP BY k; ALTER TABLE counts RENAME TO totals")[-1], "totals")


@query("dml_identity", f"SELECT 10 + 5 * (row_number() OVER (ORDER BY sid) - 1) AS no, sid AS v FROM {SRC} UNION ALL SELECT 10 + 5 * (SELECT count(*) FROM {SRC}), -1")
def _(t):
    text = "CREATE TABLE log (no BIGINT GENERATED ALWAYS AS IDENTITY (START WITH 10 INCREMENT BY 5), v BIGINT); INSERT INTO log SELECT sid FROM src; INSERT INTO log (v) VALUES (-1)"
    return after(sql(t, text)[-1], "log")


@query("dml_merge_generated", f"SELECT coalesce(id, sid) AS id, coalesce(add_amount, amount) AS amount, 2 * coalesce(add_amount, amount) AS g FROM {ACC} FULL JOIN {SRC} ON id = sid")
def _(t):
    rel = W.Relation(state(t)["acc"].rows.select("id", "amount").withColumn("g", 2 * F.col("amount")), generated={"g": 2 * F.col("amount")})
    src = source(t).withColumnRenamed("sid", "id")
    branches = [W.Branch("matched", "update", {"amount": F.expr("coalesce(s.add_amount, a.amount)")}), W.Branch("not_matched", "insert", {"id": F.expr("s.id"), "amount": F.expr("add_amount")})]
    return after(W.merge(W.State({"acc": rel}), "acc", src, [("id", "id")], branches, "a", "s"))


@query("view_materialized", f"SELECT 1 AS step, count(*) AS n FROM {ACC} UNION ALL SELECT 2, count(*) FROM {ACC} WHERE NOT coalesce(amount = 3, FALSE)")
def _(t):
    """A materialized view shows its rows of before until it is refreshed."""
    text = "CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM acc; DELETE FROM acc WHERE amount = 3; SELECT n FROM m; REFRESH MATERIALIZED VIEW m; SELECT n FROM m"
    moved = sql(t, text)
    shown = [m.returning for m in moved if m.returning is not None]
    return shown[0].select(F.lit(1).alias("step"), "n").unionAll(shown[1].select(F.lit(2).alias("step"), "n"))


@query("dml_select_between", f"SELECT count(*) AS n FROM {ACC} WHERE NOT coalesce(amount = 3, FALSE)")
def _(t):
    """What a read between two writes sees."""
    count = lambda s: s["acc"].rows.agg(F.count(F.lit(1)).alias("n"))
    steps = [lambda s: W.delete(s, "acc", F.col("amount") == 3), lambda s: W.select(s, "acc", count), lambda s: W.truncate(s, "acc")]
    return W.script(state(t), steps)[1].returning
