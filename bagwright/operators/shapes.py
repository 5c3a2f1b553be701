"""Shape changes: star edits, pivots and unnesting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(df: DataFrame, exclude: Sequence[str] = (), replace: Mapping[str, Column] | None = None, rename: Mapping[str, str] | None = None) -> DataFrame:
    """`* EXCLUDE (…) REPLACE (…) RENAME (…)`: one ordered edit of the columns."""
    replace, rename = replace or {}, rename or {}
    if missing := (set(exclude) | set(replace) | set(rename)) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*[replace.get(c, df[c]).alias(rename.get(c, c)) for c in df.columns if c not in exclude])


def pivot(df: DataFrame, keys: Sequence[str], by: str, values: Sequence, aggregate: Column, names: Sequence[str]) -> DataFrame:
    """PIVOT with fixed keys: no pass to find them."""
    out = df.groupBy(*keys).pivot(by, list(values)).agg(aggregate)
    return out.toDF(*keys, *names)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str, include_nulls: bool = False) -> DataFrame:
    out = df.unpivot(list(ids), list(values), name, value)
    return out if include_nulls else out.filter(F.col(value).isNotNull())


def unnest(df: DataFrame, array: str, value: str, offset: str | None = None, first: int = 0, outer: bool = False) -> DataFrame:
    """UNNEST [WITH OFFSET | ORDINALITY]: offsets begin at `first`."""
    keep = [F.col(c) for c in df.columns if c != array]
    if offset is None:
        return df.select(*keep, (F.explode_outer if outer else F.explode)(array).alias(value))
    out = df.select(*keep, (F.posexplode_outer if outer else F.posexplode)(array).alias(offset, value))
    return out.withColumn(offset, (F.col(offset) + first).cast("long"))
