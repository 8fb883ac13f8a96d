"""Result types of Arrow UDFs that are made before there is a session to parse them."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType())}


def record(fields: str) -> T.StructType:
    """A struct from 'name kind, name kind'."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in map(str.split, fields.split(", "))])
