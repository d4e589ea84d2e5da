"""Recursion to a fixed point, with a global set of rows seen: safe on cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessel.errors import SqlError
from tessel.store.registry import stored


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 200_000) -> DataFrame:
    """base, and the rows that step makes from the last round's new rows, until there are none. Rows are distinct.

    Each round's new rows are stored, so lineage does not grow; rows are new if a null-safe anti join says so.
    """
    frontier = stored(base.distinct())
    parts = [frontier]
    for _ in range(most):
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        new = stored(step(frontier).distinct().subtract(seen))
        if new.isEmpty():
            return seen
        parts.append(new)
        if len(parts) > 16:  # few, larger parts keep the plan small
            parts = [stored(seen.unionByName(new))]
        frontier = new
    raise SqlError("54001", "recursion limit reached")
