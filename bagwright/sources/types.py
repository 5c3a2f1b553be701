"""Column types by their dialect spellings."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Spellings of types, by the Spark type that holds them.
NAMES: dict[str, T.DataType] = {
    **dict.fromkeys(("bool", "boolean"), T.BooleanType()),
    **dict.fromkeys(("tinyint", "int1", "byteint", "int8_t"), T.ByteType()),
    **dict.fromkeys(("smallint", "int2", "utinyint", "uint8", "smallserial", "short"), T.ShortType()),
    **dict.fromkeys(("int", "integer", "int4", "mediumint", "usmallint", "uint16", "serial", "int32"), T.IntegerType()),
    **dict.fromkeys(("bigint", "int8", "long", "uinteger", "uint32", "bigserial", "int64"), T.LongType()),
    **dict.fromkeys(("ubigint", "uint64"), T.DecimalType(20, 0)),
    **dict.fromkeys(("hugeint", "int128"), T.DecimalType(38, 0)),
    **dict.fromkeys(("float4", "real", "float32"), T.FloatType()),
    **dict.fromkeys(("double", "float8", "float64", "double precision", "float"), T.DoubleType()),
    **dict.fromkeys(("string", "text", "clob", "uuid", "bpchar", "nvarchar", "nchar", "name", "enum", "geometry", "regclass", "tsvector", "tsquery", "interval"), T.StringType()),
    **dict.fromkeys(("binary", "varbinary", "blob", "bytea", "bytes", "bit", "varbit"), T.BinaryType()),
    **dict.fromkeys(("json", "jsonb", "variant", "super"), T.VariantType()),
    "date": T.DateType(),
    **dict.fromkeys(("timestamp", "datetime", "timestamp_ntz", "timestamp without time zone", "datetime2"), T.TimestampNTZType()),
    **dict.fromkeys(("timestamptz", "timestamp_tz", "timestamp_ltz", "timestamp with time zone"), T.TimestampType()),
}


class TypeTextError(ValueError):
    pass


def _split(text: str) -> list[str]:
    """Parts of a comma-separated list, commas in brackets aside."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<[") - (c in ")>]")
        if c == "," and not depth:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


def parse(text: str) -> T.DataType:
    """The Spark type of a dialect's type; raises TypeTextError where none holds its values."""
    low = " ".join(text.strip().lower().split())
    if low.endswith("[]"):
        return T.ArrayType(parse(low[:-2]))
    m = re.fullmatch(r"(\w+)\s*[<(](.*)[>)]", low)
    if m:
        head, inside = m.groups()
        if head in ("array", "list"):
            return T.ArrayType(parse(inside))
        if head == "nullable":
            return parse(inside)
        if head == "map":
            k, v = _split(inside)
            return T.MapType(parse(k), parse(v))
        if head in ("struct", "row", "tuple"):
            fields = []
            for part in _split(inside):
                name, kind = re.split(r"[:\s]\s*", part, maxsplit=1)
                fields.append(T.StructField(name, parse(kind)))
            return T.StructType(fields)
        if head == "union":
            return T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(*_field(p)) for p in _split(inside))])
        if head in ("decimal", "numeric", "number", "dec"):
            p, *s = (int(x) for x in inside.split(","))
            if p > 38:
                raise TypeTextError(f"{text}: more than 38 digits")
            return T.DecimalType(p, s[0] if s else 0)
        if head in ("varchar", "character varying", "nvarchar", "varchar2"):
            return T.VarcharType(int(inside)) if inside.isdigit() else T.StringType()
        if head in ("char", "character", "nchar"):
            return T.CharType(int(inside))
        if head == "set":
            return T.ArrayType(T.StringType())
        if head == "enum":
            return T.StringType()
        if head == "time":
            return T.TimeType(int(inside))
        low = head
    if low in ("decimal", "numeric", "number"):
        return T.DecimalType(38, 10)
    if low in ("varchar", "char", "character varying"):
        return T.StringType()
    if low == "time":
        return T.TimeType(6)
    if low in NAMES:
        return NAMES[low]
    raise TypeTextError(f"unknown type {text}")


def _field(part: str) -> tuple[str, T.DataType]:
    name, kind = re.split(r"[:\s]\s*", part, maxsplit=1)
    return name, parse(kind)
