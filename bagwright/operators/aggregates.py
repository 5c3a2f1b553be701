"""Aggregation: grouping sets, conditional aggregates, and groups with their contributors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The aggregates that SQL text is analysed for, by name.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "ANY_VALUE": F.any_value,
    "ARRAY_AGG": F.array_agg,
    "AVG": F.avg,
    "BIT_AND": F.bit_and,
    "BIT_OR": F.bit_or,
    "BIT_XOR": F.bit_xor,
    "BOOL_AND": F.bool_and,
    "BOOL_OR": F.bool_or,
    "CORR": F.corr,
    "COUNT": F.count,
    "COVAR_POP": F.covar_pop,
    "COVAR_SAMP": F.covar_samp,
    "EVERY": F.every,
    "MAX": F.max,
    "MIN": F.min,
    "STDDEV": F.stddev,
    "STDDEV_POP": F.stddev_pop,
    "STDDEV_SAMP": F.stddev_samp,
    "STRING_AGG": F.string_agg,
    "SUM": F.sum,
    "VAR_POP": F.var_pop,
    "VAR_SAMP": F.var_samp,
    "VARIANCE": F.variance,
}


def where(value: Column, condition: Column) -> Column:
    """The argument of an aggregate with FILTER (WHERE condition); only TRUE rows contribute."""
    return F.when(condition, value)


def grouping_sets(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    return df.groupingSets([[df[c] for c in s] for s in sets], *[df[c] for c in keys]).agg(*aggregates)


def exact_sum(value: Column) -> Column:
    """A sum that cannot overflow 64 bits: DECIMAL(38, 0)."""
    return F.sum(value.cast("decimal(38,0)"))


def groups_with_contributors(df: DataFrame, keys: Sequence[str], row_id: str, aggregates: Sequence[Column], having: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups with their truth under HAVING, and (keys, row id) of the rows that contribute to a TRUE group.

    Contributors stay rows of their own: no list grows with a group.
    """
    groups = df.groupBy(*keys).agg(*aggregates)
    verdict = F.lit("TRUE") if having is None else F.when(having, "TRUE").when(~having, "FALSE").otherwise("UNKNOWN")
    groups = groups.withColumn("_truth", verdict)
    kept = groups.filter("_truth = 'TRUE'").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(kept[f"_{k}"])
    return groups, df.join(kept, same, "left_semi").select(*keys, row_id)
