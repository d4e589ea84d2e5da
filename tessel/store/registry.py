"""What a session knows: tables, views, sequences, types, functions, by schema. Copying is cheap: DataFrames are immutable."""

from __future__ import annotations

import copy
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.dialect.parser import N
from tessel.errors import SqlError

#: Rows of a table version that is kept as a local relation; larger ones are written.
LOCAL_ROWS = 1000


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that the cluster names; one on this machine only where all runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that all machines share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tessel-store/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df computed once: a local relation if it is small, else a Parquet table in the cluster's shared folder."""
    spark = df.sparkSession
    rows = df.take(LOCAL_ROWS + 1)
    if len(rows) <= LOCAL_ROWS:
        return spark.createDataFrame(rows, df.schema, verifySchema=False) if rows else spark.createDataFrame([], df.schema)
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(df with a column of gapless numbers from 0, how many): a row's place in its partition after the rows of those before.

    No shuffle of the rows: what reaches the driver, and goes out again, is a count for each partition.
    """
    at = f"__at_{uuid.uuid4().hex}"
    held = stored(df.withColumn(at, F.monotonically_increasing_id()))
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    first, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in held.groupBy(part.alias("p")).count().collect()):
        first.append((p, total))
        total += n
    before = df.sparkSession.createDataFrame(first, "__p long, __first long")
    return held.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn(name, F.col("__first") + place).drop("__p", "__first", at), total


@dataclass
class Sequence:
    name: str
    increment: int = 1
    start: int = 1
    min: int = 1
    max: int = 2**63 - 1
    cycle: bool = False
    last: int | None = None
    called: bool = False

    def next(self, n: int = 1) -> int:
        """The first of the next n values."""
        first = self.start if self.last is None else self.last + self.increment if self.called else self.last
        if not self.min <= first <= self.max:
            if not self.cycle:
                raise SqlError("2200H", f'nextval: reached {"maximum" if self.increment > 0 else "minimum"} value of sequence "{self.name}"')
            first = self.min if self.increment > 0 else self.max
        self.last, self.called = first + (n - 1) * self.increment, True
        return first


@dataclass
class Table:
    name: str
    cols: list[tuple[str, str | None]]
    df: DataFrame
    mods: dict[str, list[int]] = field(default_factory=dict)
    not_null: set[str] = field(default_factory=set)
    defaults: dict[str, N] = field(default_factory=dict)
    generated: dict[str, N] = field(default_factory=dict)
    identity: dict[str, str] = field(default_factory=dict)
    sequences: dict[str, str] = field(default_factory=dict)
    constraints: list[N] = field(default_factory=list)
    triggers: list[N] = field(default_factory=list)

    def names(self) -> list[str]:
        return [c for c, _ in self.cols]

    def but(self, **fields: Any) -> Table:
        t = copy.copy(self)
        for k in ("mods", "not_null", "defaults", "generated", "identity", "sequences", "constraints", "triggers", "cols"):
            setattr(t, k, copy.copy(getattr(self, k)))
        for k, v in fields.items():
            setattr(t, k, v)
        return t


@dataclass
class View:
    name: str
    query: N
    columns: list[str]
    materialized: bool = False
    df: DataFrame | None = None
    cols: list[tuple[str, str | None]] = field(default_factory=list)


@dataclass
class Registry:
    relations: dict[tuple[str, str], Table | View] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=lambda: {"public"})
    path: list[str] = field(default_factory=lambda: ["public"])
    sequences: dict[str, Sequence] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    domains: dict[str, N] = field(default_factory=dict)
    functions: dict[str, list[N]] = field(default_factory=dict)
    indexes: dict[str, N] = field(default_factory=dict)

    def copy(self) -> Registry:
        r = Registry()
        for k, v in self.__dict__.items():
            setattr(r, k, {a: copy.copy(b) if isinstance(b, (list, Sequence)) else b for a, b in v.items()} if isinstance(v, dict) else copy.copy(v))
        return r

    def key(self, path: list[str]) -> tuple[str, str]:
        """Where a new relation of this name goes."""
        schema = path[-2] if len(path) > 1 else self.path[0]
        if schema not in self.schemas:
            raise SqlError("3F000", f'schema "{schema}" does not exist')
        return schema, path[-1]

    def find(self, path: list[str]) -> Table | View | None:
        for schema in [path[-2]] if len(path) > 1 else self.path:
            if (schema, path[-1]) in self.relations:
                return self.relations[schema, path[-1]]
        return None

    def where(self, path: list[str]) -> tuple[str, str]:
        for schema in [path[-2]] if len(path) > 1 else self.path:
            if (schema, path[-1]) in self.relations:
                return schema, path[-1]
        raise SqlError("42P01", f'relation "{".".join(path)}" does not exist')

    def put(self, path: list[str], relation: Table | View) -> None:
        self.relations[self.key(path)] = relation

    def table(self, path: list[str]) -> Table:
        t = self.find(path)
        if t is None:
            raise SqlError("42P01", f'relation "{".".join(path)}" does not exist')
        if isinstance(t, View):
            raise SqlError("42809", f'"{path[-1]}" is not a table')
        return t

    def sequence(self, name: str) -> Sequence:
        name = name.split(".")[-1].strip('"')
        if name not in self.sequences:
            raise SqlError("42P01", f'relation "{name}" does not exist')
        return self.sequences[name]
