"""pg_catalog and information_schema, as relations built from the registry's metadata."""

from __future__ import annotations

import zlib
from typing import Any

from tessel.dialect import types as ty
from tessel.store.registry import Table, View


def _oid(name: str) -> int:
    return 16384 + zlib.crc32(name.encode()) % 10**6


def _tables(session: Any) -> list[tuple[str, str, Table | View]]:
    return [(s, n, t) for (s, n), t in sorted(session.registry.relations.items())]


def _columns(session: Any) -> list[tuple]:
    out = []
    for s, n, t in _tables(session):
        for j, (c, k) in enumerate(t.cols, 1):
            real = isinstance(t, Table)
            out.append((s, n, c, j, k or "text", "NO" if real and c in t.not_null else "YES", (t.mods.get(c) or [None])[0] if real else None, real and (c in t.defaults or c in t.sequences), real and c in t.generated, t.identity.get(c) if real else None))
    return out


def _constraints(session: Any) -> list[tuple]:
    return [(s, n, c) for s, n, t in _tables(session) if isinstance(t, Table) for c in t.constraints]


def _kind(t: Table | View) -> str:
    return "r" if isinstance(t, Table) else "m" if t.materialized else "v"


def relation(session: Any, path: list[str]) -> tuple[str, list[tuple[str, str]]] | None:
    schema, name = (path[-2], path[-1]) if len(path) > 1 else ("pg_catalog", path[-1])
    build = BUILD.get((schema, name))
    if build is None:
        return None
    ddl, rows = build(session)
    df = session.spark.createDataFrame(rows, ddl)
    return session.viewed(df), [(f.name, ty.of_spark(f.dataType)) for f in df.schema.fields]


_RULE = {"cascade": "c", "set null": "n", "set default": "d", "restrict": "r", "no action": "a"}
_TYPE = {"unique": lambda c: "PRIMARY KEY" if c.primary else "UNIQUE", "check": lambda c: "CHECK", "foreign": lambda c: "FOREIGN KEY"}

BUILD = {
    ("information_schema", "tables"): lambda s: ("table_catalog string, table_schema string, table_name string, table_type string", [("postgres", a, n, "BASE TABLE" if isinstance(t, Table) else "VIEW") for a, n, t in _tables(s) if _kind(t) != "m"]),
    ("information_schema", "columns"): lambda s: ("table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, character_maximum_length int, udt_name string, is_generated string, is_identity string", [("postgres", a, n, c, j, "ARRAY" if k.endswith("[]") else ty.DISPLAY.get(k, k), null, m if k in ("varchar", "bpchar") else None, k, "ALWAYS" if g else "NEVER", "YES" if i else "NO") for a, n, c, j, k, null, m, _, g, i in _columns(s)]),
    ("information_schema", "schemata"): lambda s: ("catalog_name string, schema_name string, schema_owner string", [("postgres", x, "postgres") for x in sorted(s.registry.schemas | {"pg_catalog", "information_schema"})]),
    ("information_schema", "views"): lambda s: ("table_catalog string, table_schema string, table_name string, view_definition string", [("postgres", a, n, getattr(t.query, "source_text", None)) for a, n, t in _tables(s) if isinstance(t, View) and not t.materialized]),
    ("information_schema", "table_constraints"): lambda s: ("constraint_schema string, constraint_name string, table_schema string, table_name string, constraint_type string", [(a, c.name, a, n, _TYPE[c.kind](c)) for a, n, c in _constraints(s)]),
    ("information_schema", "key_column_usage"): lambda s: ("constraint_schema string, constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int", [(a, c.name, a, n, k, j) for a, n, c in _constraints(s) for j, k in enumerate(getattr(c, "columns", []), 1)]),
    ("information_schema", "referential_constraints"): lambda s: ("constraint_schema string, constraint_name string, delete_rule string, update_rule string", [(a, c.name, c.on_delete.upper(), c.on_update.upper()) for a, _, c in _constraints(s) if c.kind == "foreign"]),
    ("information_schema", "sequences"): lambda s: ("sequence_catalog string, sequence_schema string, sequence_name string, increment string", [("postgres", "public", q.name, str(q.increment)) for q in s.registry.sequences.values()]),
    ("pg_catalog", "pg_namespace"): lambda s: ("oid bigint, nspname string", [(_oid(x), x) for x in sorted(s.registry.schemas | {"pg_catalog", "information_schema"})]),
    ("pg_catalog", "pg_class"): lambda s: ("oid bigint, relname string, relnamespace bigint, relkind string, reltuples float, relhasindex boolean", [(_oid(n), n, _oid(a), _kind(t), -1.0, isinstance(t, Table) and any(c.kind == "unique" for c in t.constraints)) for a, n, t in _tables(s)] + [(_oid(i), i, _oid("public"), "i", 0.0, False) for i in s.registry.indexes] + [(_oid(q), q, _oid("public"), "S", 1.0, False) for q in s.registry.sequences]),
    ("pg_catalog", "pg_attribute"): lambda s: ("attrelid bigint, attname string, atttypid bigint, attnum smallint, attnotnull boolean, atthasdef boolean, attisdropped boolean, attidentity string", [(_oid(n), c, _oid(k), j, null == "NO", d, False, {"always": "a", "by default": "d"}.get(i, "")) for _, n, c, j, k, null, _, d, _, i in _columns(s)]),
    ("pg_catalog", "pg_type"): lambda s: ("oid bigint, typname string, typtype string, typnamespace bigint", [(_oid(k), k, "b", _oid("pg_catalog")) for k in ty.SPARK] + [(_oid(k), k, "e", _oid("public")) for k in s.registry.enums] + [(_oid(k), k, "d", _oid("public")) for k in s.registry.domains]),
    ("pg_catalog", "pg_enum"): lambda s: ("enumtypid bigint, enumsortorder float, enumlabel string", [(_oid(k), float(j), v) for k, vs in s.registry.enums.items() for j, v in enumerate(vs, 1)]),
    ("pg_catalog", "pg_constraint"): lambda s: ("oid bigint, conname string, contype string, conrelid bigint, confrelid bigint, confdeltype string, confupdtype string", [(_oid(c.name), c.name, {"PRIMARY KEY": "p", "UNIQUE": "u", "CHECK": "c", "FOREIGN KEY": "f"}[_TYPE[c.kind](c)], _oid(n), _oid(c.path[-1]) if c.kind == "foreign" else 0, _RULE[c.on_delete] if c.kind == "foreign" else " ", _RULE[c.on_update] if c.kind == "foreign" else " ") for _, n, c in _constraints(s)]),
    ("pg_catalog", "pg_index"): lambda s: ("indexrelid bigint, indrelid bigint, indisunique boolean, indisprimary boolean", [(_oid(i.name), _oid(i.table), i.unique, False) for i in s.registry.indexes.values()] + [(_oid(c.name), _oid(n), True, c.primary) for _, n, c in _constraints(s) if c.kind == "unique" and not getattr(c, "index", False)]),
    ("pg_catalog", "pg_indexes"): lambda s: ("schemaname string, tablename string, indexname string, indexdef string", [("public", i.table, i.name, f"CREATE {'UNIQUE ' if i.unique else ''}INDEX {i.name} ON {i.table}") for i in s.registry.indexes.values()] + [(a, n, c.name, f"CREATE UNIQUE INDEX {c.name} ON {n}") for a, n, c in _constraints(s) if c.kind == "unique" and not getattr(c, "index", False)]),
    ("pg_catalog", "pg_tables"): lambda s: ("schemaname string, tablename string, tableowner string", [(a, n, "postgres") for a, n, t in _tables(s) if isinstance(t, Table)]),
    ("pg_catalog", "pg_views"): lambda s: ("schemaname string, viewname string, viewowner string", [(a, n, "postgres") for a, n, t in _tables(s) if isinstance(t, View) and not t.materialized]),
    ("pg_catalog", "pg_matviews"): lambda s: ("schemaname string, matviewname string, ispopulated boolean", [(a, n, t.df is not None) for a, n, t in _tables(s) if isinstance(t, View) and t.materialized]),
    ("pg_catalog", "pg_sequences"): lambda s: ("schemaname string, sequencename string, start_value bigint, increment_by bigint, last_value bigint", [("public", q.name, q.start, q.increment, q.last) for q in s.registry.sequences.values()]),
    ("pg_catalog", "pg_proc"): lambda s: ("oid bigint, proname string, pronamespace bigint, pronargs smallint", [(_oid(k), k, _oid("public"), len(f.args)) for k, fs in s.registry.functions.items() for f in fs]),
    ("pg_catalog", "pg_trigger"): lambda s: ("oid bigint, tgname string, tgrelid bigint", [(_oid(g.name), g.name, _oid(n)) for _, n, t in _tables(s) if isinstance(t, Table) for g in t.triggers]),
    ("pg_catalog", "pg_settings"): lambda s: ("name string, setting string", sorted(s.settings.items())),
    ("pg_catalog", "pg_database"): lambda s: ("oid bigint, datname string", [(1, "postgres")]),
    ("pg_catalog", "pg_roles"): lambda s: ("oid bigint, rolname string", [(10, "postgres")]),
    ("pg_catalog", "pg_description"): lambda s: ("objoid bigint, description string", []),
    ("pg_catalog", "pg_attrdef"): lambda s: ("adrelid bigint, adnum smallint", [(_oid(n), j) for _, n, _, j, _, _, _, d, _, _ in _columns(s) if d]),
}
