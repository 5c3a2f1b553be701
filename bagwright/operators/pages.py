"""Ordered pages: LIMIT and OFFSET, WITH TIES, DISTINCT ON, LIMIT BY, pages of pages.

Orders have to be total where a page's rows shall be determined; ties() tells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def first_with_ties(df: DataFrame, order: Sequence[tuple[str, str]], n: int, by: Sequence[str] = ()) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES, by group or over all; order: (column, "asc" or "desc"), nulls last.

    Over all rows a top-n finds the n-th row without a global sort or a one-task rank; the rows that tie
    with it come by a null-safe join on the order's values, of which there is one.
    """
    sort = [F.asc_nulls_last(c) if way == "asc" else F.desc_nulls_last(c) for c, way in order]
    if by:
        return df.withColumn("_rank", F.rank().over(Window.partitionBy(*by).orderBy(*sort))).filter(F.col("_rank") <= n).drop("_rank")
    back = [F.desc_nulls_first(c) if way == "asc" else F.asc_nulls_first(c) for c, way in order]
    values = [F.col(c).alias(f"_{c}") for c, _ in order]
    top = df.orderBy(*sort).limit(n)
    edge = top.orderBy(*back).limit(1).select(*values)
    # One row at most on the right side: the n-th row's values.
    same, before = F.lit(True), F.lit(False)
    for c, way in order:
        x, e = F.col(c), F.col(f"_{c}")
        less = (x < e) if way == "asc" else (x > e)
        earlier = F.coalesce(less, F.lit(False)) | (x.isNotNull() & e.isNull())
        before = before | (same & earlier)
        same = same & x.eqNullSafe(e)
    return df.join(F.broadcast(edge), before | same, "inner").select(*df.columns)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order`; null keys are a key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def limit_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """LIMIT n BY keys."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def ties(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Values of the order's columns that several rows share."""
    return df.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
