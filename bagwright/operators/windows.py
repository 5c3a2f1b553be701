"""Window forms that Spark SQL lacks: QUALIFY, GROUPS frames, EXCLUDE, DISTINCT counts, and audits of ties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, windows: Mapping[str, Column], condition: str | Column, keep: bool = True) -> DataFrame:
    """Filters on window results. A rank bound is pushed below the shuffle by the planner."""
    out = df.withColumns(dict(windows)).filter(condition)
    return out if keep else out.drop(*windows)


def groups_frame(df: DataFrame, by: Sequence[str], order: Sequence[Column], start: int | None, end: int | None, aggregates: Mapping[str, Column]) -> DataFrame:
    """GROUPS BETWEEN start AND end (peers counted from the current row's; None is unbounded).

    The dense rank numbers peer groups; a RANGE frame over it is the GROUPS frame.
    """
    ranked = df.withColumn("_peers", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    lo = Window.unboundedPreceding if start is None else start
    hi = Window.unboundedFollowing if end is None else end
    frame = Window.partitionBy(*by).orderBy("_peers").rangeBetween(lo, hi)
    return ranked.withColumns({name: a.over(frame) for name, a in aggregates.items()}).drop("_peers")


def tied(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by, order, n) of peer groups with several rows: where ROW_NUMBER would not be determined."""
    return df.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def excluding(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, exclude: str, name: str) -> DataFrame:
    """df with SUM(value) over the whole partition without the row itself, its peers or its other peers.

    exclude: "current row", "group" or "ties". Sums of the partition, of peers and of the row are combined,
    so nothing is read twice; a frame that is left without known values sums to NULL.
    """
    whole, peers = Window.partitionBy(*by), Window.partitionBy(*by, *order)

    def parts(w) -> tuple[Column, Column]:
        return F.coalesce(F.sum(value).over(w), F.lit(0)), F.count(value).over(w)

    own = (F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long"))
    total, group = parts(whole), parts(peers)
    if exclude == "current row":
        left = [t - o for t, o in zip(total, own, strict=True)]
    elif exclude == "group":
        left = [t - g for t, g in zip(total, group, strict=True)]
    elif exclude == "ties":
        left = [t - g + o for t, g, o in zip(total, group, own, strict=True)]
    else:
        raise ValueError(f"unknown exclusion {exclude}")
    return df.withColumn(name, F.when(left[1] > 0, left[0]))


def distinct_count(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with COUNT(DISTINCT value) over the partition: the greatest dense rank of its known values."""
    rank = F.when(F.col(value).isNotNull(), F.dense_rank().over(Window.partitionBy(*by, F.col(value).isNull()).orderBy(value)))
    ranked = df.withColumn("_rank", rank)
    return ranked.withColumn(name, F.coalesce(F.max("_rank").over(Window.partitionBy(*by)), F.lit(0)).cast("long")).drop("_rank")
