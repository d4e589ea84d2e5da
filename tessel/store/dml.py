"""INSERT, UPDATE and DELETE as new versions of tables, with constraints checked on the whole version before it is swapped in."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.dialect import types as ty
from tessel.dialect.parser import N
from tessel.dialect.translate import Scope, Translator, Var, tick
from tessel.errors import SqlError
from tessel.functions import library
from tessel.functions.library import E
from tessel.store import procedural
from tessel.store.registry import numbered, stored, Table


def assigned(x: E, kind: str | None, mods: list[int], tr: Translator) -> str:
    """SQL of an expression assigned to a column: too long a text is an error, not cut."""
    k = kind or "text"
    if k in ("varchar", "bpchar") and mods:
        s = library.as_text(x) if x.type != "null" else "CAST(NULL AS STRING)"
        return f"CASE WHEN char_length(rtrim({s})) > {mods[0]} THEN raise_error('22001: value too long for type character varying({mods[0]})') ELSE {s} END"
    t = N("type", name=k.removesuffix("[]"), mods=mods, dims=1 if k.endswith("[]") else 0)
    if k in tr.session.enums():
        return x.sql if x.type != "null" else "CAST(NULL AS STRING)"
    return tr.final(tr.cast(x, t)).sql


def _typed(t: Table, name: str) -> str:
    kind = dict(t.cols)[name]
    return ty.spark_type(kind, t.mods.get(name))


def _default(session: Any, t: Table, name: str, tr: Translator, serial: str | None) -> str:
    if name in t.sequences and serial:
        return serial
    if name in t.defaults:
        return assigned(tr.ex(t.defaults[name], Scope()), dict(t.cols)[name], t.mods.get(name, []), tr)
    return f"CAST(NULL AS {_typed(t, name)})"


def _frame(session: Any, sql: str) -> DataFrame:
    return session.spark.sql(sql)


def _with_generated(session: Any, t: Table, df: DataFrame, tr: Translator) -> DataFrame:
    if not t.generated:
        return df
    view = session.viewed(df)
    scope = Scope(vars=[Var(t.name, [(c, k, f"__n.{tick(c)}") for c, k in t.cols])])
    cells = [f"{assigned(tr.ex(t.generated[c], scope), k, t.mods.get(c, []), tr)} AS {tick(c)}" if c in t.generated else f"__n.{tick(c)}" for c, k in t.cols]
    return _frame(session, f"SELECT {', '.join(cells)} FROM {view} AS __n")


def insert(session: Any, n: N, tr: Translator) -> tuple[int, DataFrame | None]:
    t = session.registry.table(n.path)
    tr_ctes = Scope()
    head = tr.with_(n.ctes, tr_ctes)
    target = n.columns or t.names()
    for c in target:
        if c not in t.names():
            raise SqlError("42703", f'column "{c}" of relation "{t.name}" does not exist')
        if c in t.generated and n.columns:
            raise SqlError("428C9", f'cannot insert a non-DEFAULT value into column "{c}"')
    given: list[str] = []
    parts: list[str] = []
    serials = {c: s for c, s in t.sequences.items()}
    serials |= {c: tr.ex(d.args[0], Scope()).value for c, d in t.defaults.items() if c not in serials and d.kind == "call" and d.name == "nextval"}
    if n.query is None:
        rows_sql, given = "SELECT 1 AS __one", []
        sources = [(rows_sql, {})]
    else:
        sources = []
        query = n.query
        if query.kind == "values" and not query.order and query.limit is None:
            if any(len(r) > len(target) for r in query.rows):
                raise SqlError("42601", "INSERT has more expressions than target columns")
            if n.columns and any(len(r) < len(n.columns) for r in query.rows):
                raise SqlError("42601", "INSERT has more target columns than expressions")
            scope = Scope(tr_ctes)
            for row in query.rows:
                cells = {}
                for c, e in zip(target, row):
                    if e.kind != "default":
                        if t.identity.get(c) == "always" and n.overriding != "system":
                            raise SqlError("428C9", f'cannot insert a non-DEFAULT value into column "{c}"')
                        cells[c] = assigned(tr.ex(e, scope), dict(t.cols)[c], t.mods.get(c, []), tr)
                sources.append(("", cells))
        else:
            query, marks = session.without_nextval(query, tr)
            q = tr.query(query, tr_ctes)
            serials |= {c: marks[name] for c, (name, _) in zip(target, q.cols) if name in marks}
            if len(q.cols) > len(target):
                raise SqlError("42601", "INSERT has more expressions than target columns")
            if n.columns and len(q.cols) < len(n.columns):
                raise SqlError("42601", "INSERT has more target columns than expressions")
            names = [f"q{j}" for j in range(len(q.cols))]
            cells = {c: assigned(E(f"__q.{x}", k), dict(t.cols)[c], t.mods.get(c, []), tr) for c, x, (name, k) in zip(target, names, q.cols) if name not in marks}
            sources.append((f"FROM ({q.sql}) AS __q({', '.join(names)})", cells))
    for from_sql, cells in sources:
        out = []
        for c, _ in t.cols:
            if c in cells:
                out.append(f"CAST({cells[c]} AS {_typed(t, c)}) AS {tick(c)}" if not (dict(t.cols)[c] == "numeric" and not t.mods.get(c)) else f"CAST({cells[c]} AS DECIMAL(38,10)) AS {tick(c)}")
            elif c in serials:
                value = f"CAST({session.nextval(serials[c])} AS {_typed(t, c)})" if not from_sql else f"CAST(NULL AS {_typed(t, c)})"
                out.append(f"{value} AS {tick(c)}")
            else:
                out.append(f"CAST({_default(session, t, c, tr, None)} AS {_typed(t, c)}) AS {tick(c)}")
        parts.append(f"SELECT {', '.join(out)} {from_sql if from_sql.startswith('FROM') else ''}")
    new = stored(_frame(session, head + " UNION ALL ".join(parts)))
    if late := {c: s for c, s in serials.items() if any(f.startswith("FROM") and c not in cells for f, cells in sources)}:
        new, count = numbered(new, "__nth")
        for c, s in late.items() if count else ():
            first, by = session.nextval(s, count), session.registry.sequence(s).increment
            new = new.withColumn(c, F.expr(f"{first} + __nth * {by}").cast(new.schema[c].dataType))
        new = stored(new.drop("__nth"))
    new = _with_generated(session, t, new, tr)
    new = procedural.before(session, t, new, None, "insert", tr)
    touched = new
    base = t.df
    if n.conflict is not None:
        base, new, touched = _conflict(session, t, n, base, new, tr)
    version = stored(base.unionByName(new))
    touched = stored(touched)
    changed = t.but(df=version)
    check(session, changed, tr, n.path)
    session.registry.relations[session.registry.where(n.path)] = changed
    procedural.after(session, t, touched, None, "insert", tr)
    return touched.count(), returning(session, n, t, touched, tr)


def _keys(t: Table, conflict: N) -> list[str] | None:
    uniques = [c for c in t.constraints if c.kind == "unique"]
    if conflict.constraint:
        hit = [c for c in uniques if c.name == conflict.constraint]
        if not hit:
            raise SqlError("42704", f'constraint "{conflict.constraint}" for table "{t.name}" does not exist')
        return hit[0].columns
    if conflict.keys:
        if not any(sorted(c.columns) == sorted(conflict.keys) for c in uniques):
            raise SqlError("42P10", "there is no unique or exclusion constraint matching the ON CONFLICT specification")
        return conflict.keys
    return None


def _conflict(session: Any, t: Table, n: N, base: DataFrame, new: DataFrame, tr: Translator) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table without what changes, rows to add, rows inserted or updated)."""
    keys = _keys(t, n.conflict)
    if n.conflict.sets is None:
        for ks in [keys] if keys else [c.columns for c in t.constraints if c.kind == "unique"]:
            known = new.filter(" OR ".join(f"{tick(k)} IS NULL" for k in ks))
            rest = new.filter(" AND ".join(f"{tick(k)} IS NOT NULL" for k in ks)).dropDuplicates(ks)
            new = stored(rest.join(base.select(*ks), ks, "left_anti").select(*t.names()).unionByName(known))
        return base, new, new
    if keys is None:
        raise SqlError("42601", "ON CONFLICT DO UPDATE requires inference specification or constraint name")
    if not new.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise SqlError("21000", "ON CONFLICT DO UPDATE command cannot affect row a second time")
    alias = n.alias or t.name
    old_view, new_view = session.viewed(base), session.viewed(new)
    scope = Scope(vars=[Var(alias, [(c, k, f"{tick(alias)}.{tick(c)}") for c, k in t.cols]), Var("excluded", [(c, k, f"excluded.{tick(c)}") for c, k in t.cols], set(t.names()))])
    sets = _sets(session, t, n.conflict.sets, scope, tr)
    on = " AND ".join(f"{tick(alias)}.{tick(k)} = excluded.{tick(k)}" for k in keys)
    where = f" WHERE {tr.condition(n.conflict.where, scope)}" if n.conflict.where is not None else ""
    cells = [f"{sets[c] if c in sets else f'{tick(alias)}.{tick(c)}'} AS {tick(c)}" for c, _ in t.cols]
    old_keys = ", ".join(f"{tick(alias)}.{tick(k)} AS __k{j}" for j, k in enumerate(keys))
    updated = stored(_frame(session, f"SELECT {', '.join(cells)}, {old_keys} FROM {old_view} AS {tick(alias)} JOIN {new_view} AS excluded ON {on}{where}"))
    inserted = new.join(base.select(*keys), keys, "left_anti").select(*t.names())
    gone = updated.select(*[F.col(f"__k{j}").alias(k) for j, k in enumerate(keys)])
    rest = base.join(gone, keys, "left_anti").select(*t.names())
    changed = _with_generated(session, t, updated.select(*t.names()), tr)
    both = stored(inserted.unionByName(changed))
    return rest, both, both


def _sets(session: Any, t: Table, sets: list[tuple[list[str], N]], scope: Scope, tr: Translator) -> dict[str, str]:
    out: dict[str, str] = {}
    for cols, e in sets:
        for c in cols:
            if c not in t.names():
                raise SqlError("42703", f'column "{c}" of relation "{t.name}" does not exist')
            if c in t.generated and e.kind != "default":
                raise SqlError("428C9", f'column "{c}" can only be updated to DEFAULT')
        if len(cols) == 1:
            x = None if e.kind == "default" else tr.ex(e, scope)
            sql = _default(session, t, cols[0], tr, None) if x is None else assigned(x, dict(t.cols)[cols[0]], t.mods.get(cols[0], []), tr)
            out[cols[0]] = f"CAST({sql} AS {_typed(t, cols[0])})"
        elif e.kind == "row":
            for c, x in zip(cols, e.items):
                out |= _sets(session, t, [([c], x)], scope, tr)
        elif e.kind == "scalar":
            for j, c in enumerate(cols):
                item = e.query.items[j]
                out |= _sets(session, t, [([c], N("scalar", query=e.query.but(items=[item])))], scope, tr)
        else:
            raise SqlError("42601", "source for a multiple-column UPDATE item must be a sub-SELECT or ROW() expression")
    return out


def _matched(session: Any, n: N, t: Table, tr: Translator, cells: Any) -> tuple[DataFrame, DataFrame]:
    """(the table with row numbers, the rows that the statement's condition finds: cells(scope) of each, first match only)."""
    outer = Scope()
    head = tr.with_(n.ctes, outer)
    base = stored(t.df.withColumn("__rid", F.monotonically_increasing_id()))
    view = session.viewed(base)
    alias = n.alias or t.name
    scope = Scope(outer, vars=[Var(alias, [(c, k, f"{tick(alias)}.{tick(c)}") for c, k in t.cols])])
    source = "".join(", " + tr.item(s, scope) for s in n.source)
    where = f" WHERE {tr.condition(n.where, scope)}" if n.where is not None else ""
    out = cells(scope, alias)
    extra = [f"{x.sql} AS __s{j}" for j, x in enumerate(_extras(n, scope, tr))]
    sql = f"{head}SELECT {tick(alias)}.__rid AS __rid, {', '.join(out + extra)} FROM {view} AS {tick(alias)}{source}{where}"
    found = _frame(session, sql)
    return base, stored(found.dropDuplicates(["__rid"]) if n.source else found)


def _extras(n: N, scope: Scope, tr: Translator) -> list[E]:
    """Columns of FROM items that RETURNING may name."""
    return [E(sql, k) for v in scope.vars[1:] for _, k, sql in v.cols] if n.returning and n.source else []


def update(session: Any, n: N, tr: Translator) -> tuple[int, DataFrame | None]:
    t = session.registry.table(n.path)
    vars_: list[Var] = []

    def cells(scope: Scope, alias: str) -> list[str]:
        vars_.extend(scope.vars)
        sets = _sets(session, t, n.sets, scope, tr)
        return [f"{sets[c] if c in sets else f'{tick(alias)}.{tick(c)}'} AS {tick(c)}" for c in t.names()]

    base, found = _matched(session, n, t, tr, cells)
    new = _with_generated(session, t, found, tr).select(*t.names()) if t.generated else found.select(*t.names())
    old = base.join(found.select("__rid"), "__rid", "left_semi")
    if t.triggers:
        new = procedural.before(session, t, found.select("__rid", *t.names()), old, "update", tr).select(*t.names())
    rest = base.join(found.select("__rid"), "__rid", "left_anti").select(*t.names())
    changed = t.but(df=stored(rest.unionByName(new)))
    where = session.registry.where(n.path)
    session.registry.relations[where] = changed
    _on_update(session, where[1], old, found, tr)
    check(session, changed, tr, n.path, referenced=True)
    procedural.after(session, t, new, old, "update", tr)
    return found.count(), returning(session, n, t, found, tr, vars_)


def delete(session: Any, n: N, tr: Translator) -> tuple[int, DataFrame | None]:
    t = session.registry.table(n.path)
    vars_: list[Var] = []

    def cells(scope: Scope, alias: str) -> list[str]:
        vars_.extend(scope.vars)
        return [f"{tick(alias)}.{tick(c)} AS {tick(c)}" for c in t.names()]

    base, found = _matched(session, n, t, tr, cells)
    rest = base.join(found.select("__rid"), "__rid", "left_anti").select(*t.names())
    where = session.registry.where(n.path)
    session.registry.relations[where] = t.but(df=stored(rest))
    on_delete(session, where[1], found.select(*t.names()), tr)
    procedural.after(session, t, None, found.select(*t.names()), "delete", tr)
    return found.count(), returning(session, n, t, found, tr, vars_)


def returning(session: Any, n: N, t: Table, rows: DataFrame, tr: Translator, vars_: list[Var] | None = None) -> DataFrame | None:
    if not n.returning:
        return None
    view = session.viewed(rows)
    alias = n.alias or t.name
    scope = Scope(vars=[Var(alias, [(c, k, f"__n.{tick(c)}") for c, k in t.cols])])
    j = 0
    for v in (vars_ or [])[1:]:
        scope.vars.append(Var(v.alias, [(c, k, f"__n.__s{j + i}") for i, (c, k, _) in enumerate(v.cols)]))
        j += len(v.cols)
    items = tr.expanded(n.returning, scope)
    cells = [f"{tr.final(tr.ex(e, scope)).sql} AS {tick(name)}" for name, e in items]
    return stored(_frame(session, f"SELECT {', '.join(cells)} FROM {view} AS __n"))


# -- constraints -----------------------------------------------------------------------------------------------------


def check(session: Any, t: Table, tr: Translator, path: list[str], referenced: bool = False) -> None:
    """Every constraint of the table, over the whole version; NOT NULL and CHECK in one pass."""
    scope = Scope(vars=[Var(t.name, [(c, k, f"__n.{tick(c)}") for c, k in t.cols])])
    view = session.viewed(t.df)
    tests = [(f"count(CASE WHEN __n.{tick(c)} IS NULL THEN 1 END)", "23502", f'null value in column "{c}" of relation "{t.name}" violates not-null constraint') for c in t.names() if c in t.not_null]
    tests += [(f"count(CASE WHEN NOT ({tr.condition(c.expr, scope)}) THEN 1 END)", "23514", f'new row for relation "{t.name}" violates check constraint "{c.name}"') for c in t.constraints if c.kind == "check"]
    if tests:
        got = session.spark.sql(f"SELECT {', '.join(f'{sql} AS c{j}' for j, (sql, _, _) in enumerate(tests))} FROM {view} AS __n").first()
        for count, (_, state, message) in zip(got, tests):
            if count:
                raise SqlError(state, message)
    for c in t.constraints:
        if c.kind == "unique":
            exprs = [tr.ex(e, scope).sql for e in c.exprs] if getattr(c, "exprs", None) else [f"__n.{tick(k)}" for k in c.columns]
            where = [f"{e} IS NOT NULL" for e in exprs] if c.nulls_distinct else []
            if getattr(c, "where", None) is not None:
                where.append(tr.condition(c.where, scope))
            cond = f" WHERE {' AND '.join(where)}" if where else ""
            if not session.spark.sql(f"SELECT 1 FROM {view} AS __n{cond} GROUP BY {', '.join(exprs)} HAVING count(*) > 1").isEmpty():
                raise SqlError("23505", f'duplicate key value violates unique constraint "{c.name}"')
        elif c.kind == "foreign" and not (c.deferred and session.stack):
            parent = session.registry.table(c.path)
            to = c.to or next(u.columns for u in parent.constraints if u.kind == "unique" and u.primary)
            keys = t.df.select(*[F.col(tick(a)).alias(b) for a, b in zip(c.columns, to)])
            some = keys.dropna(how="any")
            if c.full and not keys.filter(" OR ".join(f"{tick(k)} IS NULL" for k in to)).dropna(how="all").isEmpty():
                raise SqlError("23503", f'insert or update on table "{t.name}" violates foreign key constraint "{c.name}"')
            if not some.join(parent.df.select(*to), to, "left_anti").isEmpty():
                raise SqlError("23503", f'insert or update on table "{t.name}" violates foreign key constraint "{c.name}"')
    if referenced:
        for _, child, fk in children(session, t.name):
            check(session, child.but(constraints=[fk], not_null=set()), tr, path)


def children(session: Any, name: str) -> list[tuple[tuple[str, str], Table, N]]:
    return [(w, x, c) for w, x in session.registry.relations.items() if isinstance(x, Table) for c in x.constraints if c.kind == "foreign" and c.path[-1] == name]


def _targets(session: Any, fk: N) -> list[str]:
    parent = session.registry.table(fk.path)
    return fk.to or next(u.columns for u in parent.constraints if u.kind == "unique" and u.primary)


def on_delete(session: Any, name: str, gone: DataFrame, tr: Translator, depth: int = 0) -> None:
    if depth > 64:
        raise SqlError("54001", "foreign key actions nest too deeply")
    if gone.isEmpty():
        return
    for where, _, fk in children(session, name):
        child = session.registry.relations[where]
        to = _targets(session, fk)
        keys = gone.select(*[F.col(tick(b)).alias(a) for a, b in zip(fk.columns, to)]).distinct()
        hit = stored(child.df.join(keys, fk.columns, "left_semi").select(*child.names()))
        if hit.isEmpty():
            continue
        rest = child.df.join(keys, fk.columns, "left_anti").select(*child.names())
        if fk.on_delete == "cascade":
            session.registry.relations[where] = child.but(df=stored(rest))
            on_delete(session, where[1], hit, tr, depth + 1)
        elif fk.on_delete in ("set null", "set default"):
            session.registry.relations[where] = changed = child.but(df=stored(rest.unionByName(_blanked(session, child, hit, fk, fk.on_delete, tr))))
            check(session, changed, tr, [where[1]])
        else:
            raise SqlError("23503", f'update or delete on table "{name}" violates foreign key constraint "{fk.name}" on table "{child.name}"')


def _blanked(session: Any, child: Table, hit: DataFrame, fk: N, how: str, tr: Translator) -> DataFrame:
    for c in fk.columns:
        value = F.expr(_default(session, child, c, tr, None)) if how == "set default" else F.lit(None)
        hit = hit.withColumn(c, value.cast(hit.schema[c].dataType))
    return hit


def _on_update(session: Any, name: str, old: DataFrame, new: DataFrame, tr: Translator) -> None:
    """Children follow a changed key, by each foreign key's ON UPDATE."""
    for where, _, fk in children(session, name):
        to = _targets(session, fk)
        a = old.select("__rid", *[F.col(tick(k)).alias(f"__o{j}") for j, k in enumerate(to)])
        b = new.select("__rid", *[F.col(tick(k)).alias(f"__n{j}") for j, k in enumerate(to)])
        moved = stored(a.join(b, "__rid").filter(" OR ".join(f"NOT (__o{j} <=> __n{j})" for j in range(len(to)))).drop("__rid"))
        if moved.isEmpty():
            continue
        child = session.registry.relations[where]
        keys = moved.select(*[F.col(f"__o{j}").alias(c) for j, c in enumerate(fk.columns)])
        hit = stored(child.df.join(keys, fk.columns, "left_semi").select(*child.names()))
        if hit.isEmpty():
            continue
        rest = child.df.join(keys, fk.columns, "left_anti").select(*child.names())
        if fk.on_update == "cascade":
            on = [F.col(tick(c)) == F.col(f"__o{j}") for j, c in enumerate(fk.columns)]
            got = hit.join(moved, on)
            for j, c in enumerate(fk.columns):
                got = got.withColumn(c, F.col(f"__n{j}").cast(hit.schema[c].dataType))
            got = got.select(*child.names())
        elif fk.on_update in ("set null", "set default"):
            got = _blanked(session, child, hit, fk, fk.on_update, tr)
        else:
            continue  # the check over the new version decides
        session.registry.relations[where] = child.but(df=stored(rest.unionByName(got)))


