"""Subquery predicates as joins and one-row summaries, with the full three-valued logic.

IN, ANY and ALL give a column that is TRUE, FALSE or NULL, so they can be negated and combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists(outer: DataFrame, inner: DataFrame, on, negate: bool = False) -> DataFrame:
    return outer.join(inner, on, "left_anti" if negate else "left_semi")


def with_in(outer: DataFrame, cols: Sequence[str], inner: DataFrame, inner_cols: Sequence[str], name: str = "_in") -> DataFrame:
    """outer with the truth of (cols) IN (SELECT inner_cols FROM inner).

    A tuple whose comparison with some inner row is UNKNOWN and with none is TRUE gives NULL. Inner
    rows without null decide by an equi-join; those with nulls, and outer tuples with nulls, are
    compared on the columns that are known: one equi-join per pattern of nulls that inner tuples have.
    """
    ids = [f"_k{i}" for i in range(len(cols))]
    keys = inner.select(*[F.col(c).alias(k) for c, k in zip(inner_cols, ids, strict=True)]).distinct()
    solid = keys.na.drop("any")
    out = outer.join(solid.withColumn("_hit", F.lit(True)), [outer[c] == solid[k] for c, k in zip(cols, ids, strict=True)], "left").drop(*ids)
    if len(cols) == 1:
        facts = inner.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(inner_cols[0]).isNull(), 1)).alias("_nulls"))
        out = out.crossJoin(F.broadcast(facts))  # one row
        value = F.when(F.col("_hit"), True).when(F.col("_n") == 0, False).when(F.col(cols[0]).isNull() | (F.col("_nulls") > 0), F.lit(None)).otherwise(False)
        return out.withColumn(name, value).drop("_hit", "_n", "_nulls")
    # Whether some inner tuple agrees on all columns where both are known: one null-safe equi-join for each
    # pattern of nulls that inner tuples have, whose tuples come once for each pattern an outer one may have.
    n, every = len(cols), range(1 << len(cols))
    mask = sum((F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(ids)), F.lit(0))
    own = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    maybe = F.lit(False)
    for m in sorted(r[0] for r in keys.select(mask).distinct().collect()):  # at most 2 to the number of columns
        holes = F.explode(F.array(*[F.lit(h) for h in every if m or h])).alias("_p")
        some = keys.filter(mask == m).select("*", holes)
        known = [F.when(F.col("_p").bitwiseAND(1 << i) == 0, F.col(ids[i])).alias(f"_p{i}") for i in range(n) if not m >> i & 1]
        some = some.select("_p", *known).distinct().withColumn(f"_m{m}", F.lit(True))
        on = own == F.col("_p")
        for i in range(n):
            if not m >> i & 1:
                on = on & F.col(cols[i]).eqNullSafe(F.col(f"_p{i}"))
        out = out.join(some, on, "left").drop("_p", *[f"_p{i}" for i in range(n)])
        maybe = maybe | F.col(f"_m{m}").isNotNull()
    flags = [c for c in out.columns if c.startswith("_m")]
    return out.withColumn(name, F.when(F.col("_hit"), True).when(maybe, F.lit(None)).otherwise(False)).drop("_hit", *flags)


def with_quantified(outer: DataFrame, value: str, op: str, quantifier: str, inner: DataFrame, inner_value: str, on: Sequence[tuple[str, str]] = (), name: str = "_q") -> DataFrame:
    """outer with the truth of `value op ANY|ALL (SELECT inner_value FROM inner WHERE inner.b = outer.a)`.

    The inner side is reduced to count, nulls, least and greatest value per key before it meets the
    outer one, so the join never multiplies rows. `= ANY` and `<> ALL` are IN and NOT IN.
    """
    every = quantifier.upper() == "ALL"
    keys = [F.col(b).alias(f"_b{i}") for i, (_, b) in enumerate(on)]
    facts = [F.count(F.lit(1)).alias("_n"), F.count(inner_value).alias("_known"), F.min(inner_value).alias("_lo"), F.max(inner_value).alias("_hi")]
    summary = inner.groupBy(*keys).agg(*facts)
    if on:
        out = outer.join(summary, [outer[a] == F.col(f"_b{i}") for i, (a, _) in enumerate(on)], "left").drop(*[f"_b{i}" for i in range(len(on))])
    else:
        out = outer.crossJoin(F.broadcast(summary))  # one row
    x, lo, hi = F.col(value), F.col("_lo"), F.col("_hi")
    some = {"<": x < hi, "<=": x <= hi, ">": x > lo, ">=": x >= lo, "<>": ~((x == lo) & (x == hi))}
    each = {"<": x < lo, "<=": x <= lo, ">": x > hi, ">=": x >= hi, "=": (x == lo) & (x == hi)}
    if (op == "=" and not every) or (op == "<>" and every):
        seen = inner.select(*[F.col(b).alias(f"_s{i}") for i, (_, b) in enumerate(on)], F.col(inner_value).alias("_v")).na.drop("any").distinct().withColumn("_hit", F.lit(True))
        out = out.join(seen, [F.col(value) == F.col("_v"), *[F.col(a) == F.col(f"_s{i}") for i, (a, _) in enumerate(on)]], "left").drop("_v", *[f"_s{i}" for i in range(len(on))])
        some["="], each["<>"] = F.col("_hit").isNotNull(), F.col("_hit").isNull()
    empty = F.coalesce(F.col("_n"), F.lit(0)) == 0
    gap = F.col("_known") < F.col("_n")
    if every:
        test = each[op]
        truth = F.when(empty, True).when(x.isNull() | (F.col("_known") == 0), F.lit(None)).when(~test, False).when(gap, F.lit(None)).otherwise(True)
    else:
        test = some[op]
        truth = F.when(empty, False).when(x.isNull() | (F.col("_known") == 0), F.lit(None)).when(test, True).when(gap, F.lit(None)).otherwise(False)
    return out.withColumn(name, truth).drop("_n", "_known", "_lo", "_hi", *(["_hit"] if "_hit" in out.columns else []))


def scalar(outer: DataFrame, inner: DataFrame, value: Column, on: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """outer with the one value of inner per key; NULL without one. More than one row raises as the query runs."""
    keys = [F.col(b).alias(f"_b{i}") for i, (_, b) in enumerate(on)]
    one = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(name))
    message = F.lit("a scalar subquery gave more than one row")
    checked = one.withColumn(name, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(name))).drop("_n")
    if not on:
        return outer.crossJoin(F.broadcast(checked))  # one row
    return outer.join(checked, [outer[a] == F.col(f"_b{i}") for i, (a, _) in enumerate(on)], "left").drop(*[f"_b{i}" for i in range(len(on))])


def fixpoint(seed: DataFrame, step, most: int = 1000) -> DataFrame:
    """Recursive UNION (distinct): adds step(new rows) until nothing new comes. Each round is written out."""
    from bagwright.operators.scratch import write_out

    total = new = write_out(seed.distinct())
    for _ in range(most):
        new = write_out(step(new).distinct().subtract(total))
        if new.isEmpty():
            return total
        total = total.unionAll(new)
    raise RuntimeError(f"no fixpoint within {most} rounds")
