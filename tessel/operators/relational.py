"""The dialect's operators that Spark lacks, as plain functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a top-n whose keys are sent to all executors, at most.
FEW = 100_000


def ordered(column: str | Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """A sort key with the dialect's placing of NULL: last ascending, first descending."""
    c = F.col(column) if isinstance(column, str) else column
    first = descending if nulls_first is None else nulls_first
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last())


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: one shuffle by the key, whose groups are cut before it is written."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def with_ties(df: DataFrame, n: int, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first n rows and all that tie with the last: a top-n, then a semi join with its keys, of which there are n at most.

    They are sent to all executors only where n is small; beyond that the join is left to the optimizer.
    """
    keys = [c for c, _ in order]
    first = df.select(*[F.col(c).alias(f"__{c}") for c in keys]).orderBy(*[ordered(f"__{c}", d) for c, d in order]).limit(n).distinct()
    first = F.broadcast(first) if n <= FEW else first
    on = [df[c].eqNullSafe(first[f"__{c}"]) for c in keys]
    return df.join(first, on, "left_semi").orderBy(*[ordered(c, d) for c, d in order])


def groups_frame(value: Column, partition: Sequence[str], order: str, before: int, after: int, df: DataFrame, name: str) -> DataFrame:
    """An aggregate over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: a RANGE frame over the peers' rank."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(ordered(order))))
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition).orderBy("__peer").rangeBetween(-before, after))).drop("__peer")


def rollup_with_total(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """ROLLUP, with its total row also for an empty input."""
    grouped = df.rollup(*keys).agg(*aggregates)
    total = df.limit(0).agg(*aggregates).select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], "*")
    empty = df.limit(1).agg(F.count("*").alias("__n")).filter("__n = 0")
    return grouped.unionByName(total.join(F.broadcast(empty), how="cross").drop("__n"))


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], update: dict[str, Column] | None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO NOTHING (update: None) or DO UPDATE SET; old and new name the two rows in update."""
    old, fresh = table.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    inserted = new.join(table.select(*keys), list(keys), "left_anti").select(table.columns)
    if update is None:
        return table.unionByName(inserted)
    hit = F.col(f"new.{keys[0]}").isNotNull()
    merged = old.join(fresh, on, "left").select(*[F.when(hit, update[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in update else F.col(f"old.{c}").alias(c) for c in table.columns])
    return merged.unionByName(inserted)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], split: int = 32) -> DataFrame:
    """For each left row the right row of its keys with the latest time not after its own: one union, one window, no join of rows.

    A key with very many rows is dealt out by time, at about `split` quantiles of all times: the window runs over a key's rows of
    one stretch, and what comes before it is one row for each key and stretch.
    """
    both = left.withColumn("__left", F.lit(True)).unionByName(right.select(*keys, time, *columns).withColumn("__left", F.lit(False)), allowMissingColumns=True)
    bounds = both.agg(F.percentile_approx(time, [i / split for i in range(1, split)], 1000)).first()[0] if split > 1 else None
    kind = both.schema[time].dataType

    def stretch_of(t: Column) -> Column:  # sums of plain comparisons: how many bounds a time has reached
        return F.coalesce(sum((F.when(t >= F.lit(b).cast(kind), 1).otherwise(0) for b in dict.fromkeys(bounds or ())), F.lit(0)), F.lit(0))

    both = both.withColumn("__part", stretch_of(F.col(time)))
    within = Window.partitionBy(*keys, "__part").orderBy(F.col(time), F.col("__left")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("__row", F.last(F.when(~F.col("__left"), F.struct(*columns)), ignorenulls=True).over(within)).filter("__left")
    if bounds:
        stretch = right.select(*keys, time, *columns).withColumn("__part", stretch_of(F.col(time))).groupBy(*keys, "__part").agg(F.max_by(F.struct(*columns), time).alias("__end"))
        asked = both.select(*keys, "__part").distinct().withColumn("__end", F.lit(None).cast(stretch.schema["__end"].dataType)).withColumn("__asked", F.lit(True))
        seen = stretch.withColumn("__asked", F.lit(False)).unionByName(asked)
        earlier = Window.partitionBy(*keys).orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
        carried = seen.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).filter("__asked").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), "__before")
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__part") == F.col("__p")]
        both = both.join(carried, on, "left").withColumn("__row", F.coalesce("__row", "__before"))
    return both.select(*left.columns, *[F.col(f"__row.{c}").alias(c) for c in columns])
