"""Scalar functions whose dialect spelling or law differs from Spark's."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def simple_case(value: Column, arms: Mapping, default=None) -> Column:
    out = F
    for k, v in arms.items():
        out = out.when(value == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def integer_divide(a: Column, b: Column) -> Column:
    """Division of integers that truncates towards zero, exact for all of them; NULL by zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def safe_cast(value: Column, kind: str) -> Column:
    """TRY_CAST and SAFE_CAST: NULL where CAST would raise."""
    return value.try_cast(kind)


def half_up(value: Column, kind: str) -> Column:
    """CAST of a fraction to an integer type that rounds half away from zero, as some dialects do."""
    return F.round(value).cast(kind)
