"""Laws of row counts and value distributions, and goals held against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEASIBLE, UNSATISFIABLE, RESIDUAL = "Feasible", "Unsatisfiable", "Residual"


def histogram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(cols, n): copies of each tuple; NULL is a value."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame, col: str) -> DataFrame:
    """Rows, known values, nulls, distinct values, duplicates and the fraction of nulls of a column."""
    rows, known = F.count(F.lit(1)), F.count(col)
    out = df.agg(rows.alias("rows"), known.alias("known"), F.countDistinct(col).alias("distinct_values"))
    out = out.withColumns({"nulls": F.col("rows") - F.col("known"), "duplicates": F.col("known") - F.col("distinct_values")})
    out = out.withColumn("null_fraction", F.round(F.col("nulls") / F.nullif("rows", F.lit(0)), 6))
    return out.select("rows", "known", "nulls", "distinct_values", "duplicates", "null_fraction")


def inverted_histogram(df: DataFrame, col: str, scale: int, shift: int) -> DataFrame:
    """The histogram of scale * col + shift, with the source value of each output value."""
    if scale == 0:
        raise ValueError("a constant projection has no inverse")
    counted = histogram(df, [col])
    return counted.select(F.col(col).alias("source_value"), (F.col(col) * scale + shift).alias("output_value"), "n")


def predicted_counts(left: DataFrame, right: DataFrame, key: str, page: int) -> DataFrame:
    """One row: result counts of UNION ALL, equi-join, GROUP BY and LIMIT, from counts and key histograms alone."""
    from bagwright.operators.joins import key_histogram

    a = left.agg(F.count(F.lit(1)).alias("a"))
    b = right.agg(F.count(F.lit(1)).alias("b"))
    pairs = key_histogram(left, right, key, key).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("equijoin"))
    groups = left.select(key).distinct().agg(F.count(F.lit(1)).alias("groups"))
    row = a.crossJoin(b).crossJoin(pairs).crossJoin(groups)  # one row each
    return row.select((F.col("a") + F.col("b")).alias("union_all"), "equijoin", "groups", F.least("a", F.lit(page)).alias("page"))


def row_goal(df: DataFrame, at_least: int = 0, at_most: int | None = None) -> DataFrame:
    """Whether df's row count meets a goal."""
    if at_most is not None and at_most < at_least:
        return df.sparkSession.createDataFrame([("rows", UNSATISFIABLE)], "goal string, outcome string")
    n = F.count(F.lit(1))
    good = (n >= at_least) & ((n <= at_most) if at_most is not None else F.lit(True))
    return df.agg(F.when(good, FEASIBLE).otherwise(UNSATISFIABLE).alias("outcome")).select(F.lit("rows").alias("goal"), "outcome")


class Counts:
    """Least and greatest row count of a relation, and how operators carry them; None is unbounded."""

    def __init__(self, least: int, most: int | None):
        if most is not None and most < least:
            raise ValueError("empty interval")
        self.least, self.most = least, most

    def __eq__(self, other):
        return isinstance(other, Counts) and (self.least, self.most) == (other.least, other.most)

    def __repr__(self):
        return f"Counts({self.least}, {self.most})"

    def _top(self, other: Counts, f):
        return None if self.most is None or other.most is None else f(self.most, other.most)

    def filter(self) -> Counts:
        return Counts(0, self.most)

    def project(self) -> Counts:
        return self

    def distinct(self) -> Counts:
        return Counts(min(self.least, 1), self.most)

    group = distinct

    def aggregate(self) -> Counts:
        return Counts(1, 1)

    def limit(self, n: int, offset: int = 0) -> Counts:
        most = n if self.most is None else min(n, max(0, self.most - offset))
        return Counts(min(n, max(0, self.least - offset)), most)

    def union_all(self, other: Counts) -> Counts:
        return Counts(self.least + other.least, self._top(other, int.__add__))

    def union(self, other: Counts) -> Counts:
        return self.union_all(other).distinct()

    def intersect_all(self, other: Counts) -> Counts:
        tops = [x for x in (self.most, other.most) if x is not None]
        return Counts(0, min(tops) if tops else None)

    def except_all(self, other: Counts) -> Counts:
        return Counts(0 if other.most is None else max(0, self.least - other.most), self.most)

    def cross(self, other: Counts) -> Counts:
        return Counts(self.least * other.least, 0 if 0 in (self.most, other.most) else self._top(other, int.__mul__))

    def join(self, other: Counts, how: str) -> Counts:
        pairs = self.cross(other).most
        if how == "inner":
            return Counts(0, pairs)
        if how in ("left_semi", "left_anti"):
            return Counts(0, self.most)
        kept = {"left": (self,), "right": (other,), "full": (self, other)}[how]
        least = max(k.least for k in kept)
        tops = [k.most for k in kept]
        if None in tops:
            return Counts(least, None)
        if pairs is None:  # the side that is not kept is open: one partner may match all rows
            return Counts(least, None if any(tops) else 0)
        # Of the kept rows each has a partner or stands alone: m rows a side make at most m * n pairs.
        return Counts(least, max(pairs, sum(tops)))


def write_counts(action: str, target: Counts, source: Counts | None = None) -> dict[str, Counts]:
    """Bounds of the rows that a write affects and of the rows after it. source: the rows inserted, or matched against."""
    some = Counts(0, target.most)
    if action == "insert":
        return {"affected": source, "after": target.union_all(source)}
    if action == "insert_ignore":
        return {"affected": Counts(0, source.most), "after": Counts(target.least, target.union_all(source).most)}
    if action == "update":
        return {"affected": some, "after": target}
    if action == "delete":
        return {"affected": some, "after": some}
    if action == "truncate":
        return {"affected": target, "after": Counts(0, 0)}
    if action == "merge":
        both = target.union_all(source).most
        return {"affected": Counts(0, both), "after": Counts(0, both)}
    raise ValueError(f"unknown action {action}")


def joint_goals(df: DataFrame, goals: dict[str, tuple[Sequence[str], int, int | None]]) -> DataFrame:
    """(goal, n, outcome): goals on one relation, met together. goals: name to (SQL conditions, at least, at most).

    A goal counts the rows for which all its conditions are TRUE; all counts come from one scan. Bounds that
    contradict themselves or a goal that includes them are Unsatisfiable whatever the rows are; a goal that
    the rows at hand miss but bounds allow is Residual.
    """
    counts = [F.count(F.when(F.expr(" AND ".join(f"({c})" for c in conditions) or "TRUE"), 1)).alias(name) for name, (conditions, _, _) in goals.items()]
    row = df.agg(*counts)
    outcome = []
    for name, (conditions, low, high) in goals.items():
        # A goal with more conditions counts a part of the rows of one with fewer.
        ceiling = min((h for c, _, h in goals.values() if h is not None and set(c) <= set(conditions)), default=None)
        impossible = ceiling is not None and ceiling < low
        good = (F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high)
        value = F.lit(UNSATISFIABLE) if impossible else F.when(good, FEASIBLE).otherwise(RESIDUAL)
        outcome.append(F.struct(F.lit(name).alias("goal"), F.col(name).alias("n"), value.alias("outcome")))
    return row.select(F.explode(F.array(*outcome)).alias("x")).select("x.*")
