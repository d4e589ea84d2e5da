"""Type names of the dialect, their Spark types, and how they unify."""

from __future__ import annotations

from pyspark.sql import types as T

from tessel.errors import SqlError

#: Aliases of type names.
ALIASES = {
    "int": "int4", "integer": "int4", "smallint": "int2", "bigint": "int8", "serial": "int4", "bigserial": "int8", "smallserial": "int2", "serial4": "int4", "serial8": "int8",
    "decimal": "numeric", "dec": "numeric", "real": "float4", "float": "float8", "double": "float8", "boolean": "bool", "string": "text", "character": "bpchar", "char": "bpchar",
}
SPARK = {
    "bool": "BOOLEAN", "int2": "SMALLINT", "int4": "INT", "int8": "BIGINT", "float4": "FLOAT", "float8": "DOUBLE", "numeric": "DECIMAL(38,10)", "money": "DECIMAL(19,2)",
    "text": "STRING", "varchar": "STRING", "bpchar": "STRING", "name": "STRING", "uuid": "STRING", "json": "STRING", "jsonb": "STRING", "bytea": "BINARY", "date": "DATE",
    "timestamp": "TIMESTAMP_NTZ", "timestamptz": "TIMESTAMP", "time": "STRING", "timetz": "STRING", "interval": "STRUCT<months: INT, days: INT, micros: BIGINT>",
    "bit": "STRING", "varbit": "STRING", "tsvector": "STRING", "tsquery": "STRING", "jsonpath": "STRING", "inet": "STRING", "regclass": "STRING", "regtype": "STRING", "regproc": "STRING", "oid": "BIGINT",
    "unknown": "STRING", "null": "STRING", "void": "STRING", "record": "STRING",
}
INTS = ("int2", "int4", "int8")
LADDER = (*INTS, "numeric", "float4", "float8")
TEXTS = ("text", "varchar", "bpchar", "name", "unknown")
DISPLAY = {
    "int2": "smallint", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "bool": "boolean", "varchar": "character varying", "bpchar": "character",
    "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone", "time": "time without time zone", "timetz": "time with time zone", "varbit": "bit varying",
}


def canonical(name: str, known: dict | None = None) -> str:
    name = ALIASES.get(name, name)
    if name in SPARK or known and name in known:
        return name
    raise SqlError("42704", f'type "{name}" does not exist')


def spark_type(kind: str | None, mods: list[int] | None = None) -> str:
    if kind is None:
        return "STRING"
    if kind.endswith("[]"):
        return f"ARRAY<{spark_type(kind[:-2], mods)}>"
    if kind == "numeric" and mods:
        return f"DECIMAL({min(38, mods[0])},{mods[1] if len(mods) > 1 else 0})"
    return SPARK.get(kind, "STRING")


def of_spark(d: T.DataType) -> str:
    """The dialect's type of a Spark column."""
    simple = {T.BooleanType: "bool", T.ByteType: "int2", T.ShortType: "int2", T.IntegerType: "int4", T.LongType: "int8", T.FloatType: "float4", T.DoubleType: "float8", T.StringType: "text", T.BinaryType: "bytea", T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.NullType: "unknown"}
    if isinstance(d, T.DecimalType):
        return "numeric"
    if isinstance(d, T.ArrayType):
        return of_spark(d.elementType) + "[]"
    if isinstance(d, T.StructType):
        return "interval" if d.fieldNames() == ["months", "days", "micros"] else "record"
    return simple.get(type(d), "text")


def unified(kinds: list[str | None]) -> str | None:
    """The common type of operands, by the numeric ladder; unknown literals give way."""
    found = [k for k in kinds if k not in (None, "unknown", "null")]
    if not found:
        return kinds[0] if kinds else None
    if all(k in LADDER for k in found):
        return max(found, key=LADDER.index)
    if set(found) <= {"date", "timestamp", "timestamptz"}:
        return max(found, key=("date", "timestamp", "timestamptz").index)
    if len(set(found)) > 1 and all(k in TEXTS for k in found):
        return "text"
    return found[0]
