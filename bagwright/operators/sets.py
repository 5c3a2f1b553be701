"""Set operations by their multiplicity laws; NULL equals NULL, tuple by tuple."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of a tuple in the result, of l copies on the left and r on the right.
LAWS = {
    "UNION ALL": lambda l, r: l + r,
    "UNION": lambda l, r: F.when((l > 0) | (r > 0), 1).otherwise(0),
    "INTERSECT ALL": lambda l, r: F.least(l, r),
    "INTERSECT": lambda l, r: F.when((l > 0) & (r > 0), 1).otherwise(0),
    "EXCEPT ALL": lambda l, r: F.greatest(l - r, F.lit(0)),
    "EXCEPT": lambda l, r: F.when((l > 0) & (r == 0), 1).otherwise(0),
}


def union_by_name(left: DataFrame, right: DataFrame, distinct: bool = False) -> DataFrame:
    """UNION [ALL] BY NAME over exactly the same names."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"names differ: {left.columns} and {right.columns}")
    out = left.unionByName(right)
    return out.distinct() if distinct else out


def apply(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """One of LAWS as a DataFrame operation."""
    return {
        "UNION ALL": lambda: left.unionAll(right),
        "UNION": lambda: left.union(right).distinct(),
        "INTERSECT ALL": lambda: left.intersectAll(right),
        "INTERSECT": lambda: left.intersect(right),
        "EXCEPT ALL": lambda: left.exceptAll(right),
        "EXCEPT": lambda: left.subtract(right),
    }["EXCEPT" + kind.removeprefix("MINUS") if kind.startswith("MINUS") else kind]()


def tree(node) -> DataFrame:
    """A nested set expression: a DataFrame or (kind, left, right)."""
    return node if isinstance(node, DataFrame) else apply(node[0], tree(node[1]), tree(node[2]))


def multiplicities(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Every tuple of either side with its copies left_n and right_n and those of the result, n."""
    names = left.columns
    both = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(right.toDF(*names).select("*", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counted = both.groupBy(*names).agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))
    return counted.withColumn("n", LAWS[kind](F.col("left_n"), F.col("right_n")).cast("long"))


def member(df: DataFrame, values: Sequence) -> Column:
    """Whether a row equals the tuple `values`, null-safely."""
    out = F.lit(True)
    for c, v in zip(df.columns, values, strict=True):
        out = out & df[c].eqNullSafe(F.lit(v))
    return out
