"""The function library: names of the dialect to typed Spark SQL.

An entry maps typed argument expressions to a typed expression. Built-ins with the same meaning are one line; others are
compositions; names with the prefix pg_ are the Arrow UDFs of tessel.functions.udfs.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from tessel.dialect import types as ty
from tessel.dialect.parser import N
from tessel.errors import SqlError
from tessel.functions import intervals as iv
from tessel.functions import regex


class E:
    """SQL of an expression, its dialect type, its value where it is a constant, and whether jsonb text is not yet canonical."""

    __slots__ = ("sql", "type", "value", "raw")

    def __init__(self, sql: str, type: str | None, value: Any = None, raw: bool = False):
        self.sql, self.type, self.value, self.raw = sql, type, value, raw


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


def value(v: Any) -> E:
    """A host value as a literal."""
    match v:
        case None:
            return E("NULL", "null")
        case bool():
            return E("true" if v else "false", "bool", v)
        case int():
            return E(str(v), "int4", v) if -(2**31) <= v < 2**31 else E(f"{v}L" if -(2**63) <= v < 2**63 else f"{v}BD", "int8" if -(2**63) <= v < 2**63 else "numeric", v)
        case float():
            return E(f"CAST('{v}' AS DOUBLE)", "float8", v)
        case decimal.Decimal():
            return E(f"{format(v, 'f')}BD", "numeric", v)
        case datetime.datetime():
            return E(f"TIMESTAMP '{v.isoformat(' ')}'", "timestamptz") if v.tzinfo else E(f"TIMESTAMP_NTZ '{v.isoformat(' ')}'", "timestamp")
        case datetime.date():
            return E(f"DATE '{v.isoformat()}'", "date")
        case bytes():
            return E(f"X'{v.hex()}'", "bytea")
        case uuid.UUID():
            return E(quoted(str(v)), "uuid")
        case list() | tuple():
            xs = [value(x) for x in v]
            kind = ty.unified([x.type for x in xs]) if xs else "text"
            kind = "text" if kind in ("unknown", "null") else kind
            return E("array(" + ", ".join(x.sql for x in xs) + ")", f"{kind}[]")
        case dict():
            from tessel.functions.udfs import jsonb_text

            return E(quoted(jsonb_text(json.dumps(v))), "jsonb")
    return E(quoted(str(v)), "unknown", str(v))


# -- casts -----------------------------------------------------------------------------------------------------------


def as_text(x: E) -> str:
    if x.type in (*ty.TEXTS, "uuid", "json", None):
        return x.sql
    if x.type == "jsonb":
        return f"pg_jsonb({x.sql})" if x.raw else x.sql
    if x.type in ("float8", "float4"):
        return f"pg_float_text(CAST({x.sql} AS DOUBLE))" if x.type == "float8" else f"regexp_replace(CAST({x.sql} AS STRING), '[.]0$', '')"
    if x.type == "interval":
        return f"pg_interval_text(({x.sql}).months, ({x.sql}).days, ({x.sql}).micros)"
    if x.type == "bytea":
        return f"concat('\\\\x', lower(hex({x.sql})))"
    if x.type and x.type.endswith("[]"):
        return f"pg_array_text(to_json(struct({x.sql} AS v)))"
    return f"CAST({x.sql} AS STRING)"


def cast(x: E, t: N, tr: Any = None) -> E:
    enums = tr.session.enums() if tr else {}
    domains = tr.session.domains() if tr else {}
    name = t.name
    if name in enums:
        if x.value is not None and x.type == "unknown" and x.value not in enums[name]:
            raise SqlError("22P02", f'invalid input value for enum {name}: "{x.value}"')
        return E(x.sql, name, x.value)
    if name in domains:
        return tr.session.domain_cast(name, cast(x, domains[name].type, tr), tr)
    kind = ty.canonical(name)
    if t.dims:
        if x.type in ("unknown", "text") and x.value is not None:
            from tessel.functions.udfs import array_items

            items = [E("NULL", "null") if v is None else cast(E(quoted(v), "unknown", v), t.__class__("type", name=name, mods=t.mods, dims=0), tr) for v in array_items(x.value)]
            return E(f"CAST(array({', '.join(i.sql for i in items)}) AS {ty.spark_type(kind + '[]', t.mods)})", kind + "[]")
        if x.type == "null":
            return E(f"CAST(NULL AS {ty.spark_type(kind + '[]')})", kind + "[]")
        if x.type in ("text", "varchar"):
            return E(f"CAST(pg_array_items({x.sql}) AS {ty.spark_type(kind + '[]', t.mods)})", kind + "[]")
        return E(f"CAST({x.sql} AS {ty.spark_type(kind + '[]', t.mods)})", kind + "[]")
    return _cast(x, kind, t.mods)


def _constant_text(x: E) -> str | None:
    return x.value if x.type == "unknown" and isinstance(x.value, str) else None


def _cast(x: E, kind: str, mods: list[int]) -> E:
    spark, text = ty.spark_type(kind, mods), _constant_text(x)
    if x.type == "null":
        return E(f"CAST(NULL AS {spark})", kind)
    if kind in ty.INTS:
        if text is not None:
            try:
                n = int(text.strip().replace("_", ""), 0) if text.strip().lower().startswith(("0x", "0b", "0o")) else int(text)
            except ValueError:
                raise SqlError("22P02", f'invalid input syntax for type {ty.DISPLAY[kind]}: "{text}"') from None
            return E(f"CAST({n}{'L' if abs(n) >= 2**31 else ''} AS {spark})", kind, n)
        if x.type in ("float4", "float8"):
            return E(f"CAST(bround({x.sql}) AS {spark})", kind)  # half to even
        if x.type == "numeric":
            return E(f"CAST(round({x.sql}, 0) AS {spark})", kind)
        if x.type in ("text", "varchar", "bpchar"):
            return E(f"CAST(trim({x.sql}) AS {spark})", kind)
        if x.type == "bytea":
            return E(f"CAST(conv(hex({x.sql}), 16, 10) AS {spark})", kind)
        if x.type in ("jsonb", "json"):
            return E(f"CAST(round(CAST({x.sql} AS DECIMAL(38,10)), 0) AS {spark})", kind)
        if x.type in ("date", "timestamp", "timestamptz"):
            raise SqlError("42846", f"cannot cast type {ty.DISPLAY.get(x.type, x.type)} to {ty.DISPLAY[kind]}")
    if kind == "bool":
        if x.type in ("text", "unknown", "varchar", "bpchar"):
            s = f"lower(trim({x.sql}))"
            bad = f"raise_error(concat('22P02: invalid input syntax for type boolean: ', {x.sql}))"
            return E(f"CASE WHEN {s} IN ('t','true','tr','tru','y','yes','ye','on','1') THEN true WHEN {s} IN ('f','false','fa','fal','fals','n','no','off','of','0') THEN false WHEN {x.sql} IS NULL THEN NULL ELSE CAST({bad} AS BOOLEAN) END", kind)
        return E(f"({x.sql} <> 0)", kind) if x.type in ty.INTS else E(f"CAST({x.sql} AS BOOLEAN)", kind)
    if kind in ("text", "varchar", "bpchar", "name"):
        s = as_text(x)
        if mods and kind in ("varchar", "bpchar"):
            s = f"left({s}, {mods[0]})" if kind == "varchar" else f"rtrim(left({s}, {mods[0]}))"
        elif kind == "bpchar":
            s = f"left({s}, 1)"
        return E(s, kind, x.value if text is not None and not mods else None)
    if kind in ("json", "jsonb"):
        from tessel.functions.udfs import jsonb_text

        if text is not None:
            try:
                return E(quoted(jsonb_text(text) if kind == "jsonb" else text), kind, text) if json.loads(text) is not ... else x
            except ValueError:
                raise SqlError("22P02", "invalid input syntax for type json") from None
        if x.type in ("json", "jsonb"):
            return E(x.sql, kind, raw=x.raw or kind == "jsonb" and x.type == "json")
        return E(x.sql, kind, raw=kind == "jsonb") if x.type in ("text", "varchar") else E(json_of(x), kind, raw=kind == "jsonb")
    if kind == "interval":
        if text is not None:
            v = iv.parsed(text)
            return E(iv.literal(v), kind, v)
        return x if x.type == "interval" else E(f"pg_interval({x.sql})", kind)
    if kind == "bytea":
        if text is not None:
            return E(f"X'{text[2:]}'", kind) if text.startswith("\\x") else E(f"CAST({x.sql} AS BINARY)", kind)
        if x.type in ty.INTS:
            return E(f"unhex(lpad(hex({x.sql}), { {'int2': 4, 'int4': 8, 'int8': 16}[x.type]}, '0'))", kind)
        return E(f"CASE WHEN startswith({x.sql}, '\\\\x') THEN unhex(substring({x.sql}, 3)) ELSE pg_decode_escape({x.sql}) END" if x.type in ("text", "varchar") else f"CAST({x.sql} AS BINARY)", kind)
    if kind in ("tsvector", "tsquery"):
        from tessel.functions import textsearch as ts

        return E(quoted(ts.vector_in(text) if kind == "tsvector" else ts.query_in(text)) if text is not None else f"pg_{kind}_in({x.sql})", kind, text)
    if kind in ("date", "timestamp", "timestamptz") and x.type in ("text", "unknown", "varchar"):
        if text is not None and text.strip().lower() in ("now", "today", "tomorrow", "yesterday", "epoch"):
            base = {"now": "current_timestamp()", "today": "current_date()", "tomorrow": "date_add(current_date(), 1)", "yesterday": "date_sub(current_date(), 1)", "epoch": "TIMESTAMP_NTZ '1970-01-01 00:00:00'"}
            return E(f"CAST({base[text.strip().lower()]} AS {spark})", kind)
        if text is not None and re.search(r"\d [+-]?\d*.*[+-]\d\d$", text):
            return E(f"CAST({quoted(text + ':00')} AS {spark})", kind)
        if kind == "date" and text is not None and len(text) > 10:
            return E(f"CAST(left({x.sql}, 10) AS DATE)", kind)
        return E(f"CAST({x.sql} AS {spark})", kind)
    if kind == "numeric":
        if text is not None and not mods:
            try:
                d = decimal.Decimal(text.strip())
                return E(f"{format(d, 'f')}BD", kind, d) if d.is_finite() else E("CAST(NULL AS DECIMAL(38,10))", kind)
            except decimal.InvalidOperation:
                raise SqlError("22P02", f'invalid input syntax for type numeric: "{text}"') from None
        if not mods and x.type in ty.INTS:
            return E(f"CAST({x.sql} AS DECIMAL({ {'int2': 5, 'int4': 10, 'int8': 19}[x.type]},0))", kind)
        return x if x.type == "numeric" and not mods else E(f"CAST({x.sql} AS {spark})", kind)
    if kind in ("uuid",):
        return E(f"lower({x.sql})", kind)
    if kind in ("time", "timetz") and x.type in ("timestamp", "timestamptz"):
        return E(f"date_format({x.sql}, 'HH:mm:ss')", kind)
    if kind in ("float4", "float8") and text is not None:
        special = {"inf": "Infinity", "infinity": "Infinity", "-inf": "-Infinity", "-infinity": "-Infinity", "nan": "NaN"}.get(text.strip().lower(), text.strip())
        try:
            float(special)
        except ValueError:
            raise SqlError("22P02", f'invalid input syntax for type {ty.DISPLAY[kind]}: "{text}"') from None
        return E(f"CAST('{special}' AS {spark})", kind)
    return E(f"CAST({x.sql} AS {spark})", kind, x.value if text is not None else None)


# -- operators -------------------------------------------------------------------------------------------------------


def _numeric_pair(a: E, b: E, tr: Any) -> tuple[E, E]:
    return tr.pair(a, b) if "unknown" in (a.type, b.type) else (a, b)


def divided(a: str, b: str) -> str:
    """A quotient of numerics with 16 decimals. Spark's own type keeps 6 for wide operands, so they are narrowed where they fit."""
    narrow = f"try_cast({b} AS DECIMAL(22,6))"
    return f"coalesce(CAST(try_cast({a} AS DECIMAL(26,10)) / (CASE WHEN {narrow} = {b} THEN {narrow} END) AS DECIMAL(38,16)), CAST({a} / {b} AS DECIMAL(38,16)))"


def operator(op: str, a: E, b: E, tr: Any) -> E:
    ka, kb = a.type, b.type
    if op in ("+", "-"):
        if (x := _time_arithmetic(op, a, b, tr)) is not None:
            return x
    if op == "-" and ka == "jsonb":
        if kb and kb.endswith("[]"):
            return E(f"pg_jsonb_delete_keys({a.sql}, {b.sql})", "jsonb")
        return E(f"pg_jsonb_delete({a.sql}, {as_text(b)}, {'true' if kb in ty.INTS else 'false'})", "jsonb")
    if op in ("+", "-", "*", "/", "%"):
        if ka == "interval" and op in ("*", "/") or kb == "interval" and op == "*":
            i, n = (a, b) if ka == "interval" else (b, a)
            f = f"CAST({n.sql} AS DOUBLE)" if op == "*" else f"(1D / CAST({n.sql} AS DOUBLE))"
            months, days = f"({i.sql}).months * {f}", f"({i.sql}).days * {f}"
            more = f"({months} - CAST({months} AS INT)) * 30"
            whole = f"({days} + {more})"
            return E(iv.built(months, whole, f"round(({i.sql}).micros * {f} + ({whole} - CAST({whole} AS INT)) * 86400000000)"), "interval")
        a, b = _numeric_pair(a, b, tr)
        kind = ty.unified([a.type, b.type])
        if op == "/" and a.type in ty.INTS and b.type in ty.INTS:
            return E(f"CAST(({a.sql} DIV {b.sql}) AS {ty.spark_type(kind)})", kind)
        if kind == "numeric":
            fix = lambda x: f"CAST({x.sql} AS DECIMAL({ {'int2': 5, 'int4': 10, 'int8': 19}[x.type]},0))" if x.type in ty.INTS and x.value is None else x.sql
            return E(divided(fix(a), fix(b)) if op == "/" else f"({fix(a)} {op} {fix(b)})", kind)
        return E(f"({a.sql} {op} {b.sql})", kind)
    if op == "^":
        a, b = _numeric_pair(a, b, tr)
        return E(f"power({a.sql}, {b.sql})", "float8")
    if op == "||":
        return _concat(a, b, tr)
    if op in ("&", "|", "#", "<<", ">>"):
        if ka in ("bit", "varbit"):
            return E(f"pg_bit_op({quoted(op)}, {a.sql}, CAST({b.sql} AS STRING))", "bit")
        if op == "<<":
            return E(f"shiftleft({a.sql}, {b.sql})", ka)
        if op == ">>":
            return E(f"shiftright({a.sql}, {b.sql})", ka)
        return E(f"({a.sql} {'^' if op == '#' else op} {b.sql})", ty.unified([ka, kb]))
    if op in ("~", "~*", "!~", "!~*"):
        flags = "i" if op.endswith("*") else ""
        pattern = quoted(regex.posix(b.value, flags)) if isinstance(b.value, str) else f"concat({quoted('(?i)' if flags else '')}, {b.sql})"
        return E(f"({'NOT ' if op[0] == '!' else ''}({as_text(a)} RLIKE {pattern}))", "bool")
    if op in ("~~", "~~*", "!~~", "!~~*"):
        return E(f"({'NOT ' if op[0] == '!' else ''}({a.sql} {'ILIKE' if op.endswith('*') else 'LIKE'} {b.sql}))", "bool")
    if op in ("->", "->>"):
        return json_get(a, b, op == "->>")
    if op in ("#>", "#>>"):
        path = cast(b, N("type", name="text", mods=[], dims=1), tr) if b.type == "unknown" else b
        got = E(f"pg_json_path({a.sql}, {path.sql}, {'true' if op == '#>>' else 'false'})", "text" if op == "#>>" else "jsonb")
        return got
    if op == "?":
        return E(f"coalesce(array_contains(json_object_keys({a.sql}), {b.sql}), pg_json_has({a.sql}, {b.sql}))", "bool")
    if op in ("?|", "?&"):
        keys = cast(b, N("type", name="text", mods=[], dims=1), tr) if b.type == "unknown" else b
        return E(f"pg_json_has_{'any' if op == '?|' else 'all'}({a.sql}, {keys.sql})", "bool")
    if op in ("@>", "<@", "&&"):
        array = next((t for t in (ka, kb) if t and t.endswith("[]")), None)
        if array:
            t = N("type", name=array[:-2], mods=[], dims=1)
            a, b = (cast(x, t, tr) if x.type == "unknown" else x for x in (a, b))
            if op == "&&":
                return E(f"exists({a.sql}, e -> coalesce(array_contains({b.sql}, e), false))", "bool")
            big, small = (a, b) if op == "@>" else (b, a)
            return E(f"forall({small.sql}, e -> coalesce(array_contains({big.sql}, e), false))", "bool")
        if op != "&&":
            big, small = (a, b) if op == "@>" else (b, a)
            return E(f"pg_jsonb_contains({big.sql}, {small.sql})", "bool")
    if op == "#-":
        path = cast(b, N("type", name="text", mods=[], dims=1), tr) if b.type == "unknown" else b
        return E(f"pg_jsonb_delete_path({a.sql}, {path.sql})", "jsonb")
    if op == "@@":
        v, q = (a, b) if kb == "tsquery" or ka == "tsvector" else (b, a)
        if v.type != "tsvector":
            v = call("to_tsvector", [v])
        if q.type != "tsquery":
            q = call("plainto_tsquery", [q])
        return E(f"pg_ts_match({v.sql}, {q.sql})", "bool")
    raise SqlError("42883", f"operator does not exist: {ka} {op} {kb}")


def _concat(a: E, b: E, tr: Any) -> E:
    ka, kb = a.type or "text", b.type or "text"
    if ka.endswith("[]") or kb.endswith("[]"):
        kind = ka if ka.endswith("[]") and ka != "unknown[]" else kb if kb.endswith("[]") else ka
        t = N("type", name=kind[:-2], mods=[], dims=1)
        if ka.endswith("[]") and kb.endswith("[]"):
            return E(f"concat({a.sql}, {b.sql})", kind)
        if "unknown" in (ka, kb):
            x = b if kb == "unknown" else a
            if isinstance(x.value, str) and x.value.startswith("{"):
                x = cast(x, t, tr)
                return E(f"concat({(a if x.type == kind and kb == 'unknown' else x).sql}, {(x if kb == 'unknown' else b).sql})", kind)
        return E(f"array_append({a.sql}, {tr.coerced(b, kind[:-2])})" if ka.endswith("[]") else f"array_prepend({b.sql}, {tr.coerced(a, kind[:-2])})", kind)
    if "jsonb" in (ka, kb) and {ka, kb} <= {"jsonb", "unknown"}:
        return E(f"pg_jsonb_concat({a.sql}, {b.sql})", "jsonb")
    if ka == kb and ka in ("bytea", "bit", "tsvector"):
        return E(f"concat({a.sql}, {b.sql})" if ka != "tsvector" else f"pg_ts_concat({a.sql}, {b.sql})", ka)
    return E(f"concat({as_text(a)}, {as_text(b)})", "text")


def _time_arithmetic(op: str, a: E, b: E, tr: Any) -> E | None:
    times = ("date", "timestamp", "timestamptz")
    if a.type in times and b.type == "unknown":
        b = cast(b, N("type", name="interval" if op == "+" or not b.value[:4].isdigit() else a.type, mods=[], dims=0), tr)
    elif a.type == "unknown" and b.type in times:
        a = cast(a, N("type", name=b.type, mods=[], dims=0), tr)
    elif a.type == "interval" and b.type == "unknown":
        b = cast(b, N("type", name="interval", mods=[], dims=0), tr)
    ka, kb = a.type, b.type
    if ka == "interval" and kb == "interval":
        f = lambda x: f"({a.sql}).{x} {op} ({b.sql}).{x}"
        return E(iv.built(f("months"), f("days"), f("micros")), "interval")
    if kb == "interval" and ka in times:
        base = f"CAST({a.sql} AS TIMESTAMP_NTZ)" if ka == "date" else a.sql
        return E(f"({base} + {iv.native(b.sql, '-' if op == '-' else '')})", "timestamp" if ka == "date" else ka)
    if ka == "interval" and kb in times and op == "+":
        return _time_arithmetic("+", b, a, tr)
    if {ka, kb} == {"date", "time"} and op == "+":
        d, t = (a, b) if ka == "date" else (b, a)
        return E(f"CAST(concat(CAST({d.sql} AS STRING), ' ', {t.sql}) AS TIMESTAMP_NTZ)", "timestamp")
    if ka == "date" and kb in ty.INTS:
        return E(f"date_{'add' if op == '+' else 'sub'}({a.sql}, CAST({b.sql} AS INT))", "date")
    if ka in ty.INTS and kb == "date" and op == "+":
        return E(f"date_add({b.sql}, CAST({a.sql} AS INT))", "date")
    if op == "-" and ka == "date" and kb == "date":
        return E(f"datediff({a.sql}, {b.sql})", "int4")
    if op == "-" and ka in times and kb in times:
        us = f"timestampdiff(MICROSECOND, CAST({b.sql} AS TIMESTAMP_NTZ), CAST({a.sql} AS TIMESTAMP_NTZ))"
        return E(iv.built("0", f"{us} DIV 86400000000", f"{us} % 86400000000"), "interval")
    return None


# -- JSON ------------------------------------------------------------------------------------------------------------


def json_of(x: E) -> str:
    """JSON text of a value of any type."""
    if x.type in ("json", "jsonb"):
        return f"coalesce({x.sql}, 'null')"
    if x.type == "null":
        return "'null'"
    inner = f"to_json(named_struct('v', {as_text(x) if x.type in ('interval', 'timestamptz') else x.sql}))"
    return f"CASE WHEN {x.sql} IS NULL THEN 'null' ELSE substring({inner}, 6, length({inner}) - 6) END"


def json_key(sql: str) -> str:
    """A JSON string of a text."""
    array = f"to_json(array({sql}))"
    return f"substring({array}, 2, length({array}) - 2)"


def json_get(j: E, key: E, text: bool = False) -> E:
    """-> and ->>: JVM-side for constant keys."""
    kind = "text" if text else (j.type if j.type in ("json", "jsonb") else "jsonb")
    if key.value is not None and not isinstance(key.value, bool):
        k = key.value
        if isinstance(k, int):
            if k >= 0:
                path = f"$[{k}]"
            else:
                return E(f"pg_json_path({j.sql}, array({quoted(str(k))}), {'true' if text else 'false'})", kind)
        elif str(k).isidentifier():
            path = f"$.{k}"
        else:
            return E(f"pg_json_path({j.sql}, array({quoted(str(k))}), {'true' if text else 'false'})", kind)
        if text:
            return E(f"get_json_object({j.sql}, '{path}')", kind)
        return E(f"pg_json_path({j.sql}, array({quoted(str(k))}), false)", kind)
    return E(f"pg_json_path({j.sql}, array(CAST({key.sql} AS STRING)), {'true' if text else 'false'})", kind)


# -- scalar functions ------------------------------------------------------------------------------------------------

F: dict[str, Callable[..., E]] = {}


def _same(names: str, spark: str | None, kind: str | None, text: bool = False) -> None:
    for name in names.split():
        F[name] = lambda *a, _s=spark or name, _k=kind: E(f"{_s}({', '.join(as_text(x) if text else x.sql for x in a)})", _k or a[0].type)


_same("char_length character_length", "char_length", "int4", True)
_same("bit_length ascii", None, "int4", True)
_same("lower upper lpad rpad repeat replace reverse translate md5", None, "text")
_same("strpos position", None, "int4")
_same("asin acos acosh atanh", None, "float8")
_same("degrees radians sin cos tan cot atan atan2 sinh cosh tanh asinh cbrt exp", None, "float8")
_same("num_nulls num_nonnulls", None, "int4")
_same("pi", "pi", "float8")
_same("make_date", "make_date", "date")
_same("array_reverse", "reverse", None)
_same("array_sort", "array_sort", None)
_same("gen_random_uuid uuidv4", "uuid", "uuid")
_same("sha224 sha256 sha384 sha512", "sha2", "bytea")


def fn(*names: str) -> Callable:
    def add(f: Callable[..., E]) -> Callable[..., E]:
        for name in names:
            F[name] = f
        return f

    return add


def _t(x: E) -> str:
    return as_text(x)


F["strpos"] = F["position"] = lambda h, n: E(f"locate({_t(n)}, {_t(h)})", "int4")
F["length"] = lambda x, *_: E(f"octet_length({x.sql})", "int4") if x.type == "bytea" else E(f"pg_ts_length({x.sql})", "int4") if x.type == "tsvector" else E(f"char_length({_t(x)})", "int4")
F["octet_length"] = lambda x: E(f"octet_length({x.sql if x.type == 'bytea' else _t(x)})", "int4")
F["initcap"] = lambda x: E(f"pg_initcap({_t(x)})", "text")
F["concat"] = lambda *a: E("concat_ws('', " + ", ".join(f"CASE WHEN {x.sql} THEN 't' WHEN NOT {x.sql} THEN 'f' END" if x.type == "bool" else _t(x) for x in a) + ")", "text") if a else E("''", "text")
F["concat_ws"] = lambda s, *a: E(f"CASE WHEN {s.sql} IS NOT NULL THEN concat_ws({s.sql}, {', '.join(_t(x) for x in a)}) END", "text")
F["starts_with"] = lambda s, p: E(f"startswith({_t(s)}, {_t(p)})", "bool")
F["left"] = lambda s, n: E(f"CASE WHEN {n.sql} >= 0 THEN left({_t(s)}, {n.sql}) ELSE left({_t(s)}, greatest(char_length({_t(s)}) + {n.sql}, 0)) END", "text")
F["right"] = lambda s, n: E(f"CASE WHEN {n.sql} >= 0 THEN right({_t(s)}, {n.sql}) ELSE substring({_t(s)}, 1 - ({n.sql})) END", "text")
F["ltrim"] = lambda s, c=None: E(f"ltrim({c.sql + ', ' if c else ''}{_t(s)})" if c is None else f"trim(LEADING {c.sql} FROM {_t(s)})", "text")
F["rtrim"] = lambda s, c=None: E(f"rtrim({_t(s)})" if c is None else f"trim(TRAILING {c.sql} FROM {_t(s)})", "text")
F["btrim"] = F["trim"] = lambda s, c=None: E(f"trim({_t(s)})" if c is None else f"trim(BOTH {c.sql} FROM {_t(s)})", "text")
F["split_part"] = lambda s, d, n: E(f"CASE WHEN {d.sql} = '' THEN CASE WHEN {n.sql} IN (1, -1) THEN {_t(s)} ELSE '' END ELSE split_part({_t(s)}, {d.sql}, {n.sql}) END", "text")
F["chr"] = lambda n: E(f"pg_chr({n.sql})", "text")
F["to_hex"] = lambda n: E(f"lower(hex({n.sql}))" if n.type == "int8" else f"lower(hex(CAST({n.sql} AS BIGINT) & 4294967295L))", "text")
F["quote_ident"] = lambda s: E(f"pg_quote_ident({s.sql})", "text")
F["quote_literal"] = lambda s: E(f"pg_quote_literal({_t(s)})", "text")
F["quote_nullable"] = lambda s: E(f"coalesce(pg_quote_literal({_t(s)}), 'NULL')", "text")
F["format"] = lambda f, *a: E(f"pg_format({f.sql}, array({', '.join(_t(x) if x.type != 'null' else 'CAST(NULL AS STRING)' for x in a)}))" if a else f"pg_format({f.sql}, CAST(array() AS ARRAY<STRING>))", "text")
F["unistr"] = lambda s: E(f"pg_unistr({s.sql})", "text")
F["overlay"] = lambda s, r, n, m=None: E(f"overlay({s.sql} PLACING {r.sql} FROM {n.sql}{f' FOR {m.sql}' if m else ''})", s.type if s.type == "bytea" else "text")
F["encode"] = lambda b, f: E({"hex": f"lower(hex({b.sql}))", "base64": f"base64({b.sql})"}.get(f.value, f"pg_encode_escape({b.sql})"), "text")
F["decode"] = lambda s, f: E({"hex": f"unhex({s.sql})", "base64": f"unbase64({s.sql})"}.get(f.value, f"pg_decode_escape({s.sql})"), "bytea")
F["convert_to"] = lambda s, e: E(f"encode({s.sql}, 'UTF-8')", "bytea")
F["convert_from"] = lambda b, e: E(f"decode({b.sql}, 'UTF-8')", "text")
F["get_byte"] = lambda b, n: E(f"CAST(conv(hex(substring({b.sql}, {n.sql} + 1, 1)), 16, 10) AS INT)", "int4")
F["set_byte"] = lambda b, n, v: E(f"concat(substring({b.sql}, 1, {n.sql}), unhex(lpad(hex({v.sql}), 2, '0')), substring({b.sql}, {n.sql} + 2))", "bytea")
for _bits in (224, 256, 384, 512):
    F[f"sha{_bits}"] = lambda b, _b=_bits: E(f"unhex(sha2({b.sql}, {_b}))", "bytea")


@fn("substr", "substring")
def _substring(s: E, start: E, n: E | None = None) -> E:
    if start.type in ("unknown", "text") and n is None:
        return _regexp_substr(s, start)
    x = s.sql if s.type == "bytea" else _t(s)
    kind = "bytea" if s.type == "bytea" else "text"
    if n is None:
        return E(f"substring({x}, greatest({start.sql}, 1))", kind)
    return E(f"substring({x}, greatest({start.sql}, 1), greatest({start.sql} + {n.sql} - greatest({start.sql}, 1), 0))", kind)


F["substring_similar"] = lambda s, p, e: E(f"pg_substring_similar({s.sql}, {p.sql}, {e.sql})", "text")


def _pattern(p: E, flags: E | None = None) -> str:
    """A Java pattern: translated here where it is constant."""
    f = flags.value if flags is not None and isinstance(flags.value, str) else ""
    return quoted(regex.posix(p.value, f.replace("g", ""))) if isinstance(p.value, str) else p.sql


@fn("regexp_replace")
def _regexp_replace(s: E, p: E, r: E, flags: E | None = None) -> E:
    every = flags is not None and "g" in (flags.value or "")
    if every and isinstance(p.value, str) and isinstance(r.value, str) and "\\" not in r.value and "$" not in r.value:
        return E(f"regexp_replace({_t(s)}, {_pattern(p, flags)}, {r.sql})", "text")
    return E(f"pg_regexp_replace({_t(s)}, {p.sql}, {r.sql}, {flags.sql if flags else quoted('')})", "text")


F["regexp_match"] = lambda s, p, f=None: E(f"pg_regexp_match({_t(s)}, {p.sql}, {f.sql if f else quoted('')})", "text[]")
F["regexp_count"] = lambda s, p, n=None, f=None: E(f"regexp_count({_t(s) if n is None else f'substring({_t(s)}, {n.sql})'}, {_pattern(p, f)})", "int4")
F["regexp_like"] = lambda s, p, f=None: E(f"({_t(s)} RLIKE {_pattern(p, f)})", "bool")


@fn("regexp_substr")
def _regexp_substr(s: E, p: E, start: E | None = None, n: E | None = None, f: E | None = None, group: E | None = None) -> E:
    if start is None and isinstance(p.value, str) and "(" not in p.value:
        return E(f"regexp_substr({_t(s)}, {_pattern(p, f)})", "text")
    return E(f"pg_regexp_substr({_t(s)}, {p.sql}, {start.sql if start else 1}, {n.sql if n else 1}, {f.sql if f else quoted('')})", "text")


F["regexp_instr"] = lambda s, p, a=None, n=None, e=None, f=None, *_: E(f"pg_regexp_instr({_t(s)}, {p.sql}, {a.sql if a else 1}, {n.sql if n else 1}, {e.sql if e else 0}, {f.sql if f else quoted('')})", "int4")
F["regexp_split_to_array"] = lambda s, p, f=None: E(f"pg_regexp_split({_t(s)}, {p.sql}, {f.sql if f else quoted('')})", "text[]")


@fn("string_to_array")
def _string_to_array(s: E, d: E, null: E | None = None) -> E:
    if d.type == "null":
        body = f"filter(split({_t(s)}, ''), x -> x <> '')"
    elif isinstance(d.value, str):
        body = f"CASE WHEN {_t(s)} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({_t(s)}, {quoted(chr(92) + 'Q' + d.value + chr(92) + 'E')}, -1) END" if d.value else f"array({_t(s)})"
    else:
        body = f"split({_t(s)}, concat('\\\\Q', {d.sql}, '\\\\E'), -1)"
    return E(f"transform({body}, x -> nullif(x, {null.sql}))" if null is not None else body, "text[]")


# math
def _float(x: E) -> bool:
    return x.type in ("float4", "float8")


F["abs"] = lambda x: E(f"abs({x.sql})", x.type if x.type != "unknown" else "float8")
for _name, _spark in (("ceil", "ceil"), ("ceiling", "ceil"), ("floor", "floor")):
    F[_name] = lambda x, _s=_spark: E(f"CAST({_s}({x.sql}) AS {ty.spark_type(x.type) if _float(x) else 'DECIMAL(38,0)'})", x.type if _float(x) else "numeric")
F["round"] = lambda x, n=None: E(f"rint({x.sql})", "float8") if n is None and _float(x) else E(f"round(CAST({x.sql} AS DECIMAL(38,10)), {n.sql if n else 0})" if x.type != "numeric" else f"round({x.sql}, {n.sql if n else 0})", "numeric")
F["trunc"] = lambda x, n=None: E(f"CAST(sign({x.sql}) * floor(abs({x.sql})) AS DOUBLE)", "float8") if n is None and _float(x) else E(f"CAST(sign({x.sql}) * floor(abs(CAST({x.sql} AS DECIMAL(38,10))) * CAST(power(10, {n.sql if n else 0}) AS DECIMAL(19,0))) / CAST(power(10, {n.sql if n else 0}) AS DECIMAL(19,0)) AS DECIMAL(38,10))", "numeric")
F["sign"] = lambda x: E(f"sign({x.sql})", "float8") if _float(x) else E(f"CAST(sign({x.sql}) AS DECIMAL(1,0))", "numeric")


def _guarded(name: str, bad: str, message: str, spark: str | None = None) -> None:
    F[name] = lambda x: E(f"CASE WHEN {x.sql} {bad} THEN CAST(raise_error({quoted(message)}) AS DOUBLE) ELSE {spark or name}({x.sql}) END", "float8")


_guarded("sqrt", "< 0", "2201F: cannot take square root of a negative number")
_guarded("ln", "<= 0", "2201E: cannot take logarithm of zero or a negative number")
_guarded("log10", "<= 0", "2201E: cannot take logarithm of zero or a negative number")
for _name in ("asin", "acos"):
    _guarded(_name, "NOT BETWEEN -1 AND 1", "22003: input is out of range")
_guarded("acosh", "< 1", "22003: input is out of range")
_guarded("atanh", "NOT BETWEEN -1 AND 1", "22003: input is out of range")
F["log"] = lambda x, y=None: F["log10"](x) if y is None else E(f"log({x.sql}, {y.sql})", "numeric")
F["power"] = F["pow"] = lambda a, b: E(f"power({a.sql}, {b.sql})", "float8")
F["mod"] = lambda a, b: E(f"({a.sql} % {b.sql})", ty.unified([a.type, b.type]))
F["div"] = lambda a, b: E(f"CAST(({a.sql}) DIV ({b.sql}) AS DECIMAL(38,0))", "numeric")
F["gcd"] = lambda a, b: E(f"CAST(pg_gcd({a.sql}, {b.sql}) AS {ty.spark_type(ty.unified([a.type, b.type]))})", ty.unified([a.type, b.type]))
F["lcm"] = lambda a, b: E(f"CAST(CASE WHEN {a.sql} = 0 OR {b.sql} = 0 THEN 0 ELSE abs(({a.sql} DIV pg_gcd({a.sql}, {b.sql})) * {b.sql}) END AS {ty.spark_type(ty.unified([a.type, b.type]))})", ty.unified([a.type, b.type]))
F["factorial"] = lambda n: E(f"CAST(pg_factorial({n.sql}) AS DECIMAL(38,0))", "numeric")
F["width_bucket"] = lambda v, lo, hi, n: E(f"CAST(width_bucket({v.sql}, {lo.sql}, {hi.sql}, {n.sql}) AS INT)", "int4")
F["scale"] = lambda x: E(f"pg_scale(CAST({x.sql} AS STRING), false)", "int4")
F["min_scale"] = lambda x: E(f"pg_scale(CAST({x.sql} AS STRING), true)", "int4")
F["trim_scale"] = lambda x: E(x.sql, "numeric")
F["erf"] = lambda x: E(f"pg_erf(CAST({x.sql} AS DOUBLE))", "float8")
F["erfc"] = lambda x: E(f"(1 - pg_erf(CAST({x.sql} AS DOUBLE)))", "float8")
F["isfinite"] = lambda x: E(f"(abs(CAST({x.sql} AS DOUBLE)) <> double('Infinity'))" if x.type in ty.LADDER else f"({x.sql} IS NOT NULL)", "bool")
F["num_nulls"] = lambda *a: E("(" + " + ".join(f"CAST({x.sql} IS NULL AS INT)" for x in a) + ")", "int4")
F["num_nonnulls"] = lambda *a: E("(" + " + ".join(f"CAST({x.sql} IS NOT NULL AS INT)" for x in a) + ")", "int4")
for _name in ("sin", "cos", "tan", "cot"):
    F[_name + "d"] = lambda x, _n=_name: E(f"pg_trig_degrees({quoted(_n)}, CAST({x.sql} AS DOUBLE))", "float8")
for _name in ("asin", "acos", "atan"):
    F[_name + "d"] = lambda x, _n=_name: E(f"degrees({_n}({x.sql}))", "float8")
F["atan2d"] = lambda y, x: E(f"degrees(atan2({y.sql}, {x.sql}))", "float8")
F["random"] = lambda: E("rand()", "float8")

# conditionals
F["coalesce"] = lambda *a, tr=None: _common("coalesce", a, tr)
F["greatest"] = lambda *a, tr=None: _common("greatest", a, tr)
F["least"] = lambda *a, tr=None: _common("least", a, tr)
F["nullif"] = lambda a, b, tr=None: E(f"nullif({', '.join(x.sql for x in (tr.pair(a, b) if tr else (a, b)))})", a.type if a.type != "unknown" else "text")
_TYPED = {"coalesce", "greatest", "least", "nullif", "array_append", "array_prepend", "array_remove", "array_replace", "array_position", "array_positions", "array_fill", "date_trunc", "date_part", "extract", "age", "array_cat", "date_bin", "timezone"}


def _common(name: str, a: tuple[E, ...], tr: Any) -> E:
    kind = ty.unified([x.type for x in a])
    if len(a) == 1:
        return a[0]
    return E(f"{name}({', '.join(tr.coerced(x, kind) for x in a)})", kind)


# date and time
_NOW = "current_timestamp()"
for _name in ("now", "transaction_timestamp", "statement_timestamp", "clock_timestamp", "current_timestamp"):
    F[_name] = lambda: E(_NOW, "timestamptz")
F["current_date"] = lambda: E("current_date()", "date")
F["localtimestamp"] = lambda: E("localtimestamp()", "timestamp")
F["localtime"] = F["current_time"] = lambda: E("date_format(current_timestamp(), 'HH:mm:ss.SSSSSS')", "time")


def _as_time(x: E, tr: Any) -> E:
    return cast(x, N("type", name="timestamp", mods=[], dims=0), tr) if x.type == "unknown" else x


@fn("extract", "date_part")
def _extract(field: E, x: E, tr: Any = None) -> E:
    f = str(field.value).lower().rstrip("s") if str(field.value).lower() not in ("microseconds", "milliseconds") else str(field.value).lower()
    x = _as_time(x, tr)
    s = x.sql
    if x.type == "interval":
        sql = {
            "epoch": f"(({s}).months DIV 12) * 31557600D + (({s}).months % 12) * 2592000D + ({s}).days * 86400D + ({s}).micros / 1000000D", "year": f"({s}).months DIV 12", "month": f"({s}).months % 12", "day": f"({s}).days",
            "hour": f"({s}).micros DIV 3600000000", "minute": f"({s}).micros DIV 60000000 % 60", "second": f"({s}).micros % 60000000 / 1000000D", "quarter": f"(({s}).months % 12) DIV 3 + 1",
            "microseconds": f"({s}).micros % 60000000", "milliseconds": f"({s}).micros % 60000000 / 1000D",
        }[f]
    else:
        ts = f"CAST({s} AS TIMESTAMP_NTZ)" if x.type == "date" else s
        year = f"year({s})"
        sql = {
            "dow": f"dayofweek({s}) - 1", "isodow": f"weekday({s}) + 1", "doy": f"dayofyear({s})", "week": f"weekofyear({s})", "isoyear": f"extract(YEAROFWEEK FROM {s})", "quarter": f"quarter({s})",
            "decade": f"floor({year} / 10)", "century": f"ceil({year} / 100)", "millennium": f"ceil({year} / 1000)", "year": year, "month": f"month({s})", "day": f"day({s})",
            "hour": f"hour({ts})", "minute": f"minute({ts})", "second": f"extract(SECOND FROM {ts})", "milliseconds": f"extract(SECOND FROM {ts}) * 1000", "microseconds": f"extract(SECOND FROM {ts}) * 1000000",
            "epoch": f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts if x.type != 'timestamptz' else f'convert_timezone(current_timezone(), {chr(39)}UTC{chr(39)}, CAST({s} AS TIMESTAMP_NTZ))'} AS TIMESTAMP_NTZ)) / 1000000D",
            "julian": f"datediff({s}, DATE '1970-01-01') + 2440588", "timezone": "0",
        }.get(f)
        if sql is None:
            raise SqlError("22023", f'unit "{field.value}" not recognized for type {x.type}')
    return E(f"CAST({sql} AS {'DOUBLE' if f in ('epoch', 'second', 'milliseconds') else 'DECIMAL(20,0)'})", "float8" if f in ("epoch", "second", "milliseconds") else "numeric")


F["date_part"] = lambda f, x, tr=None: E(f"CAST({_extract(f, x, tr).sql} AS DOUBLE)", "float8")


@fn("date_trunc")
def _date_trunc(field: E, x: E, zone: E | None = None, tr: Any = None) -> E:
    x = _as_time(x, tr)
    f = str(field.value).lower()
    f = f if f in ("century", "millennium") else f.rstrip("s")
    if x.type == "interval":
        unit = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 6 * 10**7, "hour": 36 * 10**8}
        s = x.sql
        if f in unit:
            return E(iv.built(f"({s}).months", f"({s}).days", f"({s}).micros DIV {unit[f]} * {unit[f]}"), "interval")
        if f == "day":
            return E(iv.built(f"({s}).months", f"({s}).days"), "interval")
        return E(iv.built(f"({s}).months DIV { {'month': 1, 'quarter': 3, 'year': 12}[f]} * { {'month': 1, 'quarter': 3, 'year': 12}[f]}"), "interval")
    kind = "timestamptz" if x.type in ("timestamptz",) else "timestamp"
    long = {"decade": 10, "century": 100, "millennium": 1000}
    if f in long:
        n = long[f]
        year = f"floor(year({x.sql}) / {n}) * {n}" if f == "decade" else f"floor((year({x.sql}) - 1) / {n}) * {n} + 1"
        out = f"make_date(CAST({year} AS INT), 1, 1)"
    else:
        out = f"date_trunc({quoted(f)}, {x.sql})"
    return E(f"CAST({out} AS {ty.spark_type(kind)})", kind)


@fn("age")
def _age(a: E, b: E | None = None, tr: Any = None) -> E:
    a = _as_time(a, tr)
    if b is None:
        a, b = E("CAST(current_date() AS TIMESTAMP_NTZ)", "timestamp"), a
    b = _as_time(b, tr)
    x, y = (f"CAST({t.sql} AS TIMESTAMP_NTZ)" for t in (a, b))
    months = f"CAST(months_between({x}, {y}) AS INT)"
    rest = f"timestampdiff(MICROSECOND, {y} + make_interval(0, {months}), {x})"
    return E(iv.built(months, f"{rest} DIV 86400000000", f"{rest} % 86400000000"), "interval")


F["make_timestamp"] = lambda y, mo, d, h, mi, s: E(f"make_timestamp_ntz({y.sql}, {mo.sql}, {d.sql}, {h.sql}, {mi.sql}, {s.sql})", "timestamp")
F["make_timestamptz"] = lambda y, mo, d, h, mi, s, z=None: E(f"make_timestamp({y.sql}, {mo.sql}, {d.sql}, {h.sql}, {mi.sql}, {s.sql}{', ' + z.sql if z else ''})", "timestamptz")
F["make_time"] = lambda h, m, s: E(f"concat_ws(':', lpad({h.sql}, 2, '0'), lpad({m.sql}, 2, '0'), lpad(regexp_replace(CAST({s.sql} AS STRING), '[.]0*$', ''), 2, '0'))", "time")


@fn("make_interval")
def _make_interval(years=None, months=None, weeks=None, days=None, hours=None, mins=None, secs=None) -> E:
    n = lambda x: x.sql if x is not None else "0"
    return E(iv.built(f"{n(years)} * 12 + {n(months)}", f"{n(weeks)} * 7 + {n(days)}", f"({n(hours)} * 3600L + {n(mins)} * 60L + {n(secs)}) * 1000000"), "interval")


F["justify_hours"] = lambda i: E(iv.built(f"({i.sql}).months", f"({i.sql}).days + ({i.sql}).micros DIV 86400000000", f"({i.sql}).micros % 86400000000"), "interval")
F["justify_days"] = lambda i: E(iv.built(f"({i.sql}).months + ({i.sql}).days DIV 30", f"({i.sql}).days % 30", f"({i.sql}).micros"), "interval")
F["justify_interval"] = lambda i: F["justify_days"](F["justify_hours"](i))
F["to_timestamp"] = lambda x, f=None: E(f"timestamp_micros(CAST({x.sql} * 1000000 AS BIGINT))", "timestamptz") if f is None else E(f"CAST(pg_to_timestamp({x.sql}, {f.sql}) AS TIMESTAMP)", "timestamptz")
F["to_date"] = lambda x, f: E(f"CAST(left(pg_to_timestamp({x.sql}, {f.sql}), 10) AS DATE)", "date")
F["to_number"] = lambda x, f: E(f"CAST(regexp_replace({x.sql}, '[^0-9.+-]', '') AS DECIMAL(38,10))", "numeric")


@fn("to_char")
def _to_char(x: E, f: E) -> E:
    if x.type in ty.LADDER:
        return E(f"pg_to_char_number(CAST({x.sql} AS STRING), {f.sql})", "text")
    if x.type == "interval":
        return E(f"pg_to_char_interval(({x.sql}).months, ({x.sql}).days, ({x.sql}).micros, {f.sql})", "text")
    return E(f"pg_to_char_time(date_format({x.sql}, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), {f.sql})", "text")


@fn("timezone")
def _timezone(zone: E, x: E | None = None, tr: Any = None) -> E:
    if x is None:  # AT LOCAL
        zone, x = E("current_timezone()", "text"), zone
    x = _as_time(x, tr)
    if x.type == "timestamptz":
        return E(f"convert_timezone(current_timezone(), {zone.sql}, CAST({x.sql} AS TIMESTAMP_NTZ))", "timestamp")
    return E(f"CAST(convert_timezone({zone.sql}, current_timezone(), CAST({x.sql} AS TIMESTAMP_NTZ)) AS TIMESTAMP)", "timestamptz")


@fn("date_bin")
def _date_bin(stride: E, x: E, origin: E, tr: Any = None) -> E:
    if stride.type == "unknown":
        stride = cast(stride, N("type", name="interval", mods=[], dims=0), tr)
    x, origin = _as_time(x, tr), _as_time(origin, tr)
    us = f"timestampdiff(MICROSECOND, CAST({origin.sql} AS TIMESTAMP_NTZ), CAST({x.sql} AS TIMESTAMP_NTZ))"
    step = f"(({stride.sql}).days * 86400000000L + ({stride.sql}).micros)"
    kind = "timestamptz" if x.type == "timestamptz" else "timestamp"
    return E(f"CAST(timestampadd(MICROSECOND, {us} - pmod({us}, {step}), CAST({origin.sql} AS TIMESTAMP_NTZ)) AS {ty.spark_type(kind)})", kind)


# JSON
F["to_json"] = lambda x, *_: E(json_of(x), "json")
F["to_jsonb"] = lambda x: E(json_of(x), "jsonb", raw=True)
F["row_to_json"] = F["array_to_json"] = lambda x, *_: E(f"to_json({x.sql}, map('ignoreNullFields', 'false'))", "json")
for _b in ("", "b"):
    _k = f"json{_b}"
    F[f"{_k}_build_array"] = lambda *a, _k=_k: E("concat('[', concat_ws(', ', " + ", ".join(json_of(x) for x in a) + "), ']')" if a else "'[]'", _k, raw=_k == "jsonb")
    F[f"{_k}_build_object"] = lambda *a, _k=_k: E("concat('{', concat_ws(', ', " + ", ".join(f"concat({json_key(as_text(k))}, ' : ', {json_of(v)})" for k, v in zip(a[::2], a[1::2])) + "), '}')" if a else "'{}'", _k, raw=_k == "jsonb")
    F[f"{_k}_object"] = lambda a, b=None, _k=_k: E(f"pg_json_object({a.sql}, {b.sql if b else 'CAST(NULL AS ARRAY<STRING>)'})", _k, raw=_k == "jsonb")
    F[f"{_k}_typeof"] = lambda j: E(f"pg_json_typeof({j.sql})", "text")
    F[f"{_k}_array_length"] = lambda j: E(f"coalesce(json_array_length({j.sql}), CASE WHEN {j.sql} IS NOT NULL THEN CAST(raise_error('22023: cannot get array length of a non-array') AS INT) END)", "int4")
    F[f"{_k}_extract_path"] = lambda j, *p, _k=_k: E(f"pg_json_path({j.sql}, array({', '.join(x.sql for x in p)}), false)", _k)
    F[f"{_k}_extract_path_text"] = lambda j, *p: E(f"pg_json_path({j.sql}, array({', '.join(x.sql for x in p)}), true)", "text")
    F[f"{_k}_strip_nulls"] = lambda j, *_, _k=_k: E(f"pg_{_k}_strip_nulls({j.sql})", _k)
F["jsonb_path_query_first"] = lambda j, p: E(f"pg_json_path({j.sql}, pg_jsonpath({p.sql}), false)", "jsonb")
F["jsonb_path_exists"] = lambda j, p: E(f"(pg_json_path({j.sql}, pg_jsonpath({p.sql}), false) IS NOT NULL)", "bool")
F["jsonb_pretty"] = lambda j: E(f"pg_jsonb_pretty({j.sql})", "text")
_path = lambda p: cast(p, N("type", name="text", mods=[], dims=1)).sql if p.type == "unknown" else p.sql
F["jsonb_set"] = lambda j, p, v, c=None: E(f"pg_jsonb_set({j.sql}, {_path(p)}, {v.sql}, {c.sql if c else 'true'})", "jsonb")
F["jsonb_set_lax"] = lambda j, p, v, c=None, t=None: E(f"pg_jsonb_set_lax({j.sql}, {_path(p)}, {v.sql if v.type != 'null' else 'CAST(NULL AS STRING)'}, {c.sql if c else 'true'}, {t.sql if t else quoted('use_json_null')})", "jsonb")
F["jsonb_insert"] = lambda j, p, v, a=None: E(f"pg_jsonb_insert({j.sql}, {_path(p)}, {v.sql}, {a.sql if a else 'false'})", "jsonb")
F["jsonb_object_keys_check"] = lambda *_: E("true", "bool")
F["json_is_valid_check"] = lambda s: E(f"(try_parse_json({s.sql}) IS NOT NULL)", "bool")

# arrays
_elem = lambda a: (a.type or "[]")[:-2] or None
F["array_length"] = F["array_upper"] = lambda a, d: E(f"CASE WHEN {d.sql} = 1 THEN nullif(size({a.sql}), 0) END", "int4")
F["array_lower"] = lambda a, d: E(f"CASE WHEN {d.sql} = 1 AND size({a.sql}) > 0 THEN 1 END", "int4")
F["array_ndims"] = lambda a: E(f"CASE WHEN size({a.sql}) > 0 THEN {max(1, (a.type or '').count('[]'))} END", "int4")
F["cardinality"] = lambda a: E(f"CASE WHEN {a.sql} IS NOT NULL THEN size({a.sql}) END", "int4")
F["array_dims"] = lambda a: E(f"CASE WHEN size({a.sql}) > 0 THEN concat('[1:', size({a.sql}), ']') END", "text")
F["array_append"] = lambda a, x, tr=None: E(f"array_append(coalesce({a.sql}, array()), {tr.coerced(x, _elem(a))})" if a.type != "null" else f"array({x.sql})", a.type if a.type not in ("null", "unknown[]") else f"{x.type}[]")
F["array_prepend"] = lambda x, a, tr=None: E(f"array_prepend(coalesce({a.sql}, array()), {tr.coerced(x, _elem(a))})" if a.type != "null" else f"array({x.sql})", a.type if a.type not in ("null", "unknown[]") else f"{x.type}[]")
F["array_cat"] = lambda a, b, tr=None: b if a.type == "null" else a if b.type == "null" else E(f"CASE WHEN {a.sql} IS NULL THEN {b.sql} WHEN {b.sql} IS NULL THEN {a.sql} ELSE concat({a.sql}, {b.sql}) END", a.type)
F["array_remove"] = lambda a, x, tr=None: E(f"filter({a.sql}, e -> NOT (e <=> {tr.coerced(x, _elem(a))}))", a.type)
F["array_replace"] = lambda a, x, y, tr=None: E(f"transform({a.sql}, e -> CASE WHEN e <=> {tr.coerced(x, _elem(a))} THEN {tr.coerced(y, _elem(a))} ELSE e END)", a.type)
F["array_positions"] = lambda a, x, tr=None: E(f"transform(filter(transform({a.sql}, (e, i) -> named_struct('e', e, 'i', i + 1)), s -> s.e <=> {tr.coerced(x, _elem(a))}), s -> s.i)", "int4[]")


@fn("array_position")
def _array_position(a: E, x: E, start: E | None = None, tr: Any = None) -> E:
    places = F["array_positions"](a, x, tr=tr).sql
    return E(f"get({places}, 0)" if start is None else f"get(filter({places}, p -> p >= {start.sql}), 0)", "int4")


F["array_fill"] = lambda x, d, *_, tr=None: E(f"array_repeat({x.sql}, get({cast(d, N('type', name='int4', mods=[], dims=1), tr).sql if d.type == 'unknown' else d.sql}, 0))", f"{x.type if x.type != 'unknown' else 'text'}[]")
F["trim_array"] = lambda a, n: E(f"slice({a.sql}, 1, size({a.sql}) - {n.sql})", a.type)
F["array_to_string"] = lambda a, s, null=None: E(f"array_join(CAST({a.sql} AS ARRAY<STRING>), {s.sql}{', ' + null.sql if null else ''})", "text") if _elem(a) in (*ty.INTS, "text", "varchar") else E(f"array_join(transform({a.sql}, e -> {as_text(E('e', 'float4' if _elem(a) == 'float8' else _elem(a)))}), {s.sql}{', ' + null.sql if null else ''})", "text")
F["array_shuffle"] = lambda a: E(f"shuffle({a.sql})", a.type)
F["array_sample"] = lambda a, n: E(f"slice(shuffle({a.sql}), 1, {n.sql})", a.type)


# text search
def _config(a: tuple[E, ...]) -> tuple[str, E]:
    return (a[0].sql, a[1]) if len(a) == 2 else (quoted("english"), a[0])


for _name in ("to_tsvector", "to_tsquery", "plainto_tsquery", "phraseto_tsquery"):
    F[_name] = lambda *a, _n=_name: E(f"pg_{_n}({_config(a)[0]}, {_t(_config(a)[1])})", "tsvector" if _n == "to_tsvector" else "tsquery")


@fn("ts_rank", "ts_rank_cd")
def _ts_rank(*a: E) -> E:
    weights = None
    if a[0].type not in ("tsvector", None) or len(a) == 4:
        weights, *a = a
    norm = a[2].sql if len(a) > 2 else "0"
    w = _path(weights).replace("ARRAY<STRING>", "ARRAY<DOUBLE>") if weights is not None else "CAST(NULL AS ARRAY<DOUBLE>)"
    return E(f"CAST(pg_ts_rank({w}, {a[0].sql}, {a[1].sql}, {norm}) AS FLOAT)", "float4")


def _headline(*a: E) -> E:
    a = list(a)
    if a[1].type != "tsquery" and len(a) > 2:
        a = a[1:]
    return E(f"pg_ts_headline({_t(a[0])}, {a[1].sql}, {a[2].sql if len(a) > 2 else quoted('')})", "text")


F["ts_headline"] = _headline
F["setweight"] = lambda v, w: E(f"pg_ts_setweight({v.sql}, {w.sql})", "tsvector")
F["strip"] = lambda v: E(f"pg_ts_strip({v.sql})", "tsvector")
F["numnode"] = lambda q: E(f"pg_ts_numnode({q.sql})", "int4")
F["ts_match_vq"] = lambda v, q: E(f"pg_ts_match({v.sql}, {q.sql})", "bool")
F["tsvector_in_check"] = lambda s: E(f"pg_tsvector_in({s.sql})", "tsvector")
F["tsvector_length"] = lambda v: E(f"pg_ts_length({v.sql})", "int4")

# constants
F["uuid_extract_version"] = lambda u: E(f"CAST(conv(substring({u.sql}, 15, 1), 16, 10) AS SMALLINT)", "int2")
F["pg_size_pretty"] = lambda n: E(f"CASE WHEN abs({n.sql}) < 10240 THEN concat({n.sql}, ' bytes') WHEN abs({n.sql}) < 10485760 THEN concat(CAST(round({n.sql} / 1024) AS BIGINT), ' kB') WHEN abs({n.sql}) < 10737418240 THEN concat(CAST(round({n.sql} / 1048576) AS BIGINT), ' MB') ELSE concat(CAST(round({n.sql} / 1073741824) AS BIGINT), ' GB') END", "text")
#: Bytes of a value of a type of fixed length.
_SIZES = {"bool": 1, "int2": 2, "int4": 4, "int8": 8, "float4": 4, "float8": 8, "date": 4, "timestamp": 8, "timestamptz": 8, "interval": 16, "uuid": 16}
F["pg_column_size"] = lambda x: E(f"CAST(CASE WHEN {x.sql} IS NOT NULL THEN {_SIZES[x.type]} END AS INT)" if x.type in _SIZES else f"octet_length({as_text(x)})", "int4")
#: The names of types by their published object ids.
_OIDS = {
    16: "boolean", 17: "bytea", 18: "\"char\"", 19: "name", 20: "bigint", 21: "smallint", 23: "integer", 25: "text", 26: "oid", 114: "json", 700: "real", 701: "double precision", 1042: "character",
    1043: "character varying", 1082: "date", 1083: "time without time zone", 1114: "timestamp without time zone", 1184: "timestamp with time zone", 1186: "interval", 1560: "bit", 1700: "numeric", 2950: "uuid",
    3614: "tsvector", 3615: "tsquery", 3802: "jsonb", 1000: "boolean[]", 1007: "integer[]", 1009: "text[]", 1016: "bigint[]", 1022: "double precision[]",
}
F["format_type"] = lambda oid, *_: E(f"CASE WHEN {oid.sql} IS NOT NULL THEN coalesce(element_at(map({', '.join(f'{k}L, {quoted(v)}' for k, v in _OIDS.items())}), CAST({oid.sql} AS BIGINT)), '???') END", "text")
F["pg_typeof"] = lambda x: E(quoted(ty.DISPLAY.get((x.type or "text").removesuffix("[]"), (x.type or "text").removesuffix("[]")) + ("[]" if (x.type or "").endswith("[]") else "")), "regtype")
for _names, _sql, _kind in (
    ("pg_get_expr obj_description col_description shobj_description inet_client_addr inet_server_addr", "CAST(NULL AS STRING)", "text"),
    ("pg_table_is_visible pg_function_is_visible pg_type_is_visible has_table_privilege has_schema_privilege has_column_privilege pg_advisory_unlock pg_try_advisory_lock pg_listening_channels_check", "true", "bool"),
    ("pg_is_in_recovery", "false", "bool"), ("pg_advisory_lock pg_advisory_unlock_all pg_sleep", "CAST(NULL AS STRING)", "void"), ("pg_notification_queue_usage", "0D", "float8"),
    ("pg_total_relation_size pg_relation_size pg_table_size pg_indexes_size pg_database_size", "8192L", "int8"), ("pg_encoding_to_char", "'UTF8'", "name"), ("pg_backend_pid", "1", "int4"),
    ("txid_current pg_current_xact_id", "1L", "int8"), ("txid_current_if_assigned", "CAST(NULL AS BIGINT)", "int8"), ("pg_postmaster_start_time pg_conf_load_time", _NOW, "timestamptz"), ("version", "'PostgreSQL 18 dialect on Spark'", "text"),
    ("pg_get_userbyid current_user session_user user current_role", "'postgres'", "name"), ("current_database current_catalog", "'postgres'", "name"),
):
    for _name in _names.split():
        F[_name] = lambda *_, _s=_sql, _k=_kind: E(_s, _k)


def call(name: str, args: list[E], named: dict[str, E] | None = None, tr: Any = None) -> E:
    f = F.get(name)
    if f is None:
        raise SqlError("42883", f"function {name}({', '.join(str(a.type) for a in args)}) does not exist")
    if name in ("ts_rank", "ts_rank_cd") and args and args[0].type == "unknown":
        args = [cast(args[0], N("type", name="float8", mods=[], dims=1), tr), *args[1:]]
    try:
        return f(*args, **(named or {}), **({"tr": tr} if name in _TYPED else {}))
    except TypeError as e:
        if "argument" in str(e):
            raise SqlError("42883", f"function {name}({', '.join(str(a.type) for a in args)}) does not exist") from None
        raise


# -- aggregates and windows ------------------------------------------------------------------------------------------

RANKING = frozenset("row_number rank dense_rank percent_rank cume_dist ntile".split())
AGGREGATES = frozenset(
    "count sum avg min max bool_and bool_or every string_agg array_agg json_agg jsonb_agg json_object_agg jsonb_object_agg bit_and bit_or bit_xor variance var_samp var_pop stddev stddev_samp stddev_pop percentile_cont percentile_disc mode corr covar_pop covar_samp regr_slope regr_intercept regr_r2 regr_count regr_avgx regr_avgy regr_sxx regr_syy regr_sxy any_value".split()
)


def ranking(name: str, args: list[E], over: str) -> E:
    if name in ("lag", "lead"):
        if len(args) > 1 and args[1].value is None:
            step = f"{'-' if name == 'lag' else ''}({args[1].sql})"
            raise SqlError("0A000", f"{name} with an offset that varies by row ({step})")
        kind = args[0].type
        default = f", {args[2].sql}" if len(args) > 2 else ""
        return E(f"{name}({args[0].sql}, {args[1].sql if len(args) > 1 else 1}{default}) {over}", kind)
    sql = f"{name}({', '.join(a.sql for a in args)}) {over}"
    if name in ("row_number", "rank", "dense_rank"):
        return E(f"CAST({sql} AS BIGINT)", "int8")
    return E(sql, "int4" if name == "ntile" else "float8")


def sorted_array(collected: str, keys: list[tuple[str, bool, bool]]) -> str:
    """v of the collected structs, sorted by their key fields (name, descending, nulls first)."""
    whens = []
    for k, desc, first in keys:
        a, b = f"l.{k}", f"r.{k}"
        whens += [f"WHEN {a} IS NULL AND {b} IS NOT NULL THEN {-1 if first else 1}", f"WHEN {a} IS NOT NULL AND {b} IS NULL THEN {1 if first else -1}", f"WHEN {a} < {b} THEN {1 if desc else -1}", f"WHEN {a} > {b} THEN {-1 if desc else 1}"]
    return f"transform(array_sort({collected}, (l, r) -> CASE {' '.join(whens)} ELSE 0 END), s -> s.v)"


def _collected(x: str, order: list[tuple[E, bool, bool]], distinct: bool, tail: str) -> str:
    if order:
        fields = ", ".join(f"'k{j}', {k.sql}" for j, (k, _, _) in enumerate(order))
        rows = f"collect_list(named_struct({fields}, 'v', {x})){tail}"
        rows = f"array_distinct({rows})" if distinct else rows
        return sorted_array(rows, [(f"k{j}", d, f) for j, (_, d, f) in enumerate(order)])
    rows = f"collect_list(named_struct('v', {x})){tail}"
    return f"transform({f'array_sort(array_distinct({rows}))' if distinct else rows}, s -> s.v)"


def aggregate(name: str, args: list[E], star: bool, distinct: bool, order: list[tuple[E, bool, bool]], within: bool, keep: str | None, over: str, tr: Any) -> E:
    d = "DISTINCT " if distinct else ""
    if over and keep is not None:  # Spark has no FILTER in a window: rows that do not pass become NULL
        args = [E(f"CASE WHEN {keep} THEN {a.sql} END", a.type, None, a.raw) for a in args]
        if star:
            return E(f"count(CASE WHEN {keep} THEN 1 END) {over}", "int8")
    tail = f" {over}" if over else (f" FILTER (WHERE {keep})" if keep is not None else "")
    x = args[0] if args else E("1", "int4")
    if x.type == "unknown" and name in ("min", "max", "sum", "avg"):
        x = E(x.sql, "text")
    one = lambda f, e=x.sql: f"{f}({d}{e}){tail}"
    match name:
        case "count":
            return E(f"count({'*' if star or not args else d + x.sql}){tail}", "int8")
        case "sum":
            if x.type == "interval":
                return E(iv.built(*(f"sum(({x.sql}).{f}){tail}" for f in ("months", "days", "micros"))), "interval")
            if x.type == "int8":
                return E(one("sum", f"CAST({x.sql} AS DECIMAL(28,0))"), "numeric")
            if x.type == "float4":
                return E(f"CAST({one('sum')} AS FLOAT)", "float4")
            return E(one("sum"), "int8" if x.type in ty.INTS else x.type)
        case "avg":
            if x.type == "interval":
                us = f"CAST({one('avg', iv.key(x.sql))} AS BIGINT)"
                return E(iv.built("0", "0", us), "interval")
            if x.type in ty.INTS:
                whole = one("sum") if x.type != "int8" else one("sum", f"CAST({x.sql} AS DECIMAL(19,0))")
                return E(f"CAST(CAST({whole} AS DECIMAL(19,0)) / CAST(nullif({one('count')}, 0) AS DECIMAL(19,0)) AS DECIMAL(38,16))", "numeric")
            return E(one("avg"), x.type if x.type == "numeric" else "float8")
        case "min" | "max":
            if x.type == "interval":
                return E(f"{name}_by({x.sql}, {iv.key(x.sql)}){tail}", "interval")
            if x.type in tr.session.enums():
                return E(f"{name}_by({x.sql}, {tr.enum_key(x)}){tail}", x.type)
            return E(one(name), x.type)
        case "bool_and" | "bool_or" | "every" | "any_value":
            return E(one(name), "bool" if name != "any_value" else x.type)
        case "bit_and" | "bit_or" | "bit_xor":
            return E(one(name), x.type)
        case "string_agg":
            sep = args[1] if len(args) > 1 else E("''", "text")
            if sep.value is None or over or order and distinct:
                return E(f"CASE WHEN count({x.sql}){tail} > 0 THEN array_join(filter({_collected(as_text(x), order, distinct, tail)}, v -> v IS NOT NULL), {sep.sql if sep.value is not None else f'any_value({sep.sql}){tail}'}) END", "text")
            by = ", ".join(f"{k.sql} {'DESC' if desc else 'ASC'} NULLS {'FIRST' if f else 'LAST'}" for k, desc, f in order)
            return E(f"listagg({d}{as_text(x)}, {sep.sql}){f' WITHIN GROUP (ORDER BY {by})' if by else ''}{tail}", "text")
        case "array_agg":
            kind = "text" if x.type in ("unknown", "null") else x.type
            return E(f"nullif({_collected(x.sql, order, distinct, tail)}, array())", f"{kind}[]")
        case "json_agg" | "jsonb_agg":
            kind = name[:-4]
            body = f"transform({_collected(x.sql if x.type not in ('json', 'jsonb') else x.sql, order, distinct, tail)}, e -> {json_of(E('e', x.type))})"
            return E(f"CASE WHEN count(*){tail} > 0 THEN concat('[', array_join({body}, ', '), ']') END", kind, raw=kind == "jsonb")
        case "json_object_agg" | "jsonb_object_agg":
            kind = name.split("_")[0]
            v = args[1]
            pair = f"named_struct('k', {as_text(x)}, 'x', {json_of(v)})"
            rows = _collected(pair, order, False, tail)
            return E(f"CASE WHEN count(*){tail} > 0 THEN concat('{{ ', array_join(transform({rows}, e -> concat({json_key('e.k')}, ' : ', e.x)), ', '), ' }}') END", kind, raw=kind == "jsonb")
        case "variance" | "stddev":
            return E(one({"variance": "var_samp", "stddev": "stddev_samp"}[name], f"CAST({x.sql} AS DOUBLE)"), "float8")
        case "var_samp" | "var_pop" | "stddev_samp" | "stddev_pop":
            return E(one(name, f"CAST({x.sql} AS DOUBLE)"), "float8")
        case "percentile_cont" | "percentile_disc" | "mode":
            if not within:
                raise SqlError("42809", f"WITHIN GROUP is required for ordered-set aggregate {name}")
            (k, desc, _), *_rest = order
            by = f"WITHIN GROUP (ORDER BY {k.sql if name != 'percentile_cont' else f'CAST({k.sql} AS DOUBLE)'}{' DESC' if desc else ''})"
            if name == "mode":
                return E(f"mode() {by}{tail}", k.type)
            if x.type and x.type.endswith("[]"):
                n = len(tr.session.constant(x.sql))
                return E("array(" + ", ".join(f"{name}({tr.session.constant(x.sql)[j]}D) {by}{tail}" for j in range(n)) + ")", "float8[]")
            sql = f"{name}({x.sql}) {by}{tail}"
            return E(sql, "float8") if name == "percentile_cont" else E(f"CAST({sql} AS {ty.spark_type(k.type)})" if k.type != "numeric" else sql, k.type)
        case "regr_count":
            return E(f"regr_count({args[0].sql}, {args[1].sql}){tail}", "int8")
    return E(f"{name}({', '.join(f'CAST({a.sql} AS DOUBLE)' for a in args)}){tail}", "float8")


def over_array(name: str, a: str, args: list[E], star: bool) -> E:
    """An aggregate over the array of a frame's rows."""
    x = args[0]
    live = f"filter({a}, v -> v IS NOT NULL)"
    match name:
        case "count":
            return E(f"CAST(size({a if star else live}) AS BIGINT)", "int8")
        case "sum" | "avg":
            kind = {"int2": "BIGINT", "int4": "BIGINT", "int8": "DECIMAL(38,0)", "numeric": "DECIMAL(38,10)"}.get(x.type or "", "DOUBLE")
            total = f"CASE WHEN size({live}) > 0 THEN aggregate({live}, CAST(0 AS {kind}), (s, v) -> CAST(s + v AS {kind})) END"
            if name == "sum":
                return E(total, "int8" if x.type in ("int2", "int4") else "numeric" if kind.startswith("DEC") else "float8")
            if kind == "DOUBLE":
                return E(f"CAST({total} AS DOUBLE) / nullif(size({live}), 0)", "float8")
            return E(divided(f"CAST({total} AS DECIMAL(38,10))", f"nullif(CAST(size({live}) AS DECIMAL(10,0)), 0)"), "numeric")
        case "min" | "max":
            return E(f"array_{name}({live})", x.type)
        case "array_agg":
            return E(f"nullif({a}, array())", f"{x.type}[]")
        case "first_value":
            return E(f"get({a}, 0)", x.type)
        case "last_value":
            return E(f"get({a}, size({a}) - 1)", x.type)
        case "string_agg":
            sep = args[1].sql if len(args) > 1 else "''"
            return E(f"CASE WHEN size({live}) > 0 THEN array_join({live}, {sep}) END", "text")
    raise SqlError("0A000", f"EXCLUDE with {name}")


# -- table functions -------------------------------------------------------------------------------------------------

TABLES: dict[str, Callable[[list[E]], tuple[str, list[tuple[str, str | None]]]]] = {}


def table(*names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for name in names:
            TABLES[name] = lambda a, _n=name: f(_n, a)
        return f

    return add


@table("generate_series")
def _series(name: str, a: list[E]) -> tuple[str, list]:
    kinds = [x.type for x in a[:2]]
    if any(k in ("timestamp", "timestamptz", "date") for k in kinds):
        kind = "timestamptz" if "timestamptz" in kinds else "timestamp"
        s, e = (f"CAST({x.sql} AS {ty.spark_type(kind)})" for x in a[:2])
        step = iv.native(a[2].sql if a[2].type == "interval" else cast(a[2], N("type", name="interval", mods=[], dims=0)).sql)
        i = a[2].value if isinstance(a[2].value, tuple) else iv.parsed(a[2].value)
        down = (i[0] * 30 + i[1]) * 86400 * 10**6 + i[2] < 0
        step = f"INTERVAL '{i[0]}' MONTH" if i[0] and not i[1] and not i[2] else f"INTERVAL '{i[1] * 86400 + i[2] / 1e6:.6f}' SECOND" if not i[0] else step
        return f"CASE WHEN {s} {'>=' if down else '<='} {e} THEN sequence({s}, {e}, {step}) ELSE CAST(array() AS ARRAY<{ty.spark_type(kind)}>) END", [(name, kind)]
    kind = ty.unified([x.type for x in a])
    if kind == "numeric":
        scale = max([-(x.value.as_tuple().exponent) if isinstance(x.value, decimal.Decimal) else 0 for x in a] + [0])
        m = 10**scale
        lo, hi, by = (f"CAST({x} * {m} AS BIGINT)" for x in (a[0].sql, a[1].sql, a[2].sql if len(a) > 2 else "1"))
        whole = f"CASE WHEN ({hi} - {lo}) * sign({by}) >= 0 THEN sequence({lo}, {hi}, {by}) ELSE CAST(array() AS ARRAY<BIGINT>) END"
        return f"transform({whole}, v -> CAST(v AS DECIMAL(38,{scale})) / {m})", [(name, kind)]
    spark = ty.spark_type(kind)
    lo, hi, by = (f"CAST({x} AS {spark})" for x in (a[0].sql, a[1].sql, a[2].sql if len(a) > 2 else "1"))
    if len(a) > 2 and a[2].value == 0:
        raise SqlError("22023", "step size cannot equal zero")
    return f"CASE WHEN (CAST({hi} AS DECIMAL(20,0)) - {lo}) * sign({by}) >= 0 THEN sequence({lo}, {hi}, {by}) ELSE CAST(array() AS ARRAY<{spark}>) END", [(name, kind)]


@table("generate_subscripts")
def _subscripts(name: str, a: list[E]) -> tuple[str, list]:
    s = f"CASE WHEN size({a[0].sql}) > 0 THEN sequence(1, size({a[0].sql})) ELSE CAST(array() AS ARRAY<INT>) END"
    return (f"reverse({s})" if len(a) > 2 and a[2].value else s), [(name, "int4")]


@table("unnest")
def _unnest(name: str, a: list[E]) -> tuple[str, list]:
    if len(a) == 1:
        return f"coalesce({a[0].sql}, array())" if a[0].type != "null" else "CAST(array() AS ARRAY<STRING>)", [(name, _elem(a[0]))]
    cols = [f"u{j}" for j in range(len(a))]
    zipped = "arrays_zip(" + ", ".join(x.sql for x in a) + ")"
    return f"transform({zipped}, z -> named_struct({', '.join(f'{quoted(c)}, z.`{j}`' for j, c in enumerate(cols))}))", [(c, _elem(x)) for c, x in zip(cols, a)]


@table("string_to_table")
def _string_to_table(name: str, a: list[E]) -> tuple[str, list]:
    return F["string_to_array"](*a).sql, [(name, "text")]


@table("regexp_split_to_table")
def _regexp_split_to_table(name: str, a: list[E]) -> tuple[str, list]:
    return F["regexp_split_to_array"](*a).sql, [(name, "text")]


@table("regexp_matches")
def _regexp_matches(name: str, a: list[E]) -> tuple[str, list]:
    return f"pg_regexp_matches({as_text(a[0])}, {a[1].sql}, {a[2].sql if len(a) > 2 else quoted('')})", [(name, "text[]")]


@table("json_array_elements", "jsonb_array_elements", "json_array_elements_text", "jsonb_array_elements_text")
def _json_elements(name: str, a: list[E]) -> tuple[str, list]:
    text = name.endswith("_text")
    return f"pg_json_elements({a[0].sql}, {'true' if text else 'false'})", [("value", "text" if text else name.split("_")[0])]


@table("json_each", "jsonb_each", "json_each_text", "jsonb_each_text")
def _json_each(name: str, a: list[E]) -> tuple[str, list]:
    text = name.endswith("_text")
    return f"pg_json_each({a[0].sql}, {'true' if text else 'false'})", [("key", "text"), ("value", "text" if text else name.split("_")[0])]


@table("json_object_keys", "jsonb_object_keys")
def _json_keys(name: str, a: list[E]) -> tuple[str, list]:
    return f"transform(pg_json_each({a[0].sql}, false), e -> e.key)", [(name, "text")]
