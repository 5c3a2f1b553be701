"""Three-valued truth of predicates: every source row is TRUE, FALSE or UNKNOWN, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE, FALSE, UNKNOWN = "TRUE", "FALSE", "UNKNOWN"


def truth(predicate: Column) -> Column:
    return F.when(predicate, TRUE).when(~predicate, FALSE).otherwise(UNKNOWN)


def with_truth(df: DataFrame, predicate: Column, name: str = "_truth") -> DataFrame:
    """df with each row's truth under predicate: an audit instead of a filter."""
    return df.withColumn(name, truth(predicate))


def truth_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """(truth, n): sizes of the partition that predicate makes; one pass, reduced before the shuffle."""
    return df.groupBy(truth(predicate).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


def is_true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def is_false(p: Column) -> Column:
    return F.coalesce(~p, F.lit(False))


def is_unknown(p: Column) -> Column:
    return p.isNull()


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def escape_like(text: str) -> str:
    """text as a LIKE pattern that matches itself alone, with backslash as the escape."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def safe_prefix(pattern: str, escape: str = "\\") -> tuple[str, bool] | None:
    """(prefix, exact) of a LIKE pattern that is a literal or a literal followed by one %; None for others."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            out.append(pattern[i + 1])
            i += 2
            continue
        if c == "_":
            return None
        if c == "%":
            return ("".join(out), False) if i == len(pattern) - 1 else None
        out.append(c)
        i += 1
    return "".join(out), True
