"""A session's tables and definitions as a folder: Parquet per table, and a manifest of the rest."""

from __future__ import annotations

import base64
import pickle
from typing import Any

from tessel.errors import SqlError
from tessel.store.registry import Table

VERSION = 1


def save(session: Any, path: str) -> None:
    """Through Spark's writers only, so any file system that Spark reaches will do."""
    r = session.registry.copy()
    for (schema, name), t in r.relations.items():
        df = t.df
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/data/{schema}.{name}")
            t = t.but(df=None) if isinstance(t, Table) else type(t)(t.name, t.query, t.columns, t.materialized, None, t.cols)
            r.relations[schema, name] = t
    blob = base64.b64encode(pickle.dumps((VERSION, r, session.settings))).decode()
    session.spark.createDataFrame([(blob,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


class _Reader(pickle.Unpickler):
    """Only this package's own classes and plain containers."""

    def find_class(self, module: str, name: str) -> Any:
        if module.startswith("tessel.") or (module, name) in (("builtins", "set"), ("decimal", "Decimal")):
            return super().find_class(module, name)
        raise SqlError("22P03", f"snapshot holds {module}.{name}")


def load(session: Any, path: str) -> None:
    import io

    blob = session.spark.read.text(f"{path}/manifest").first()[0]
    version, r, settings = _Reader(io.BytesIO(base64.b64decode(blob))).load()
    if version != VERSION:
        raise SqlError("22P03", f"snapshot version {version}")
    for (schema, name), t in r.relations.items():
        if isinstance(t, Table) or t.materialized:
            t.df = session.spark.read.parquet(f"{path}/data/{schema}.{name}")
    session.registry, session.settings = r, settings
