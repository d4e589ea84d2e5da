"""The long tail of scalar functions, as Arrow UDFs named pg_*: what Spark's built-ins cannot express."""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions import datetimes, regex
from tessel.functions import intervals as iv
from tessel.functions import textsearch as ts

# -- JSON ------------------------------------------------------------------------------------------------------------


def _loads(s: str) -> Any:
    return json.loads(s, parse_float=_Number, parse_int=int)


class _Number(float):
    """A JSON number that keeps its digits."""

    def __new__(cls, text: str):
        x = super().__new__(cls, text)
        x.text = text
        return x

    def __repr__(self) -> str:
        return self.text


def jsonb_value(v: Any, spaced: bool = True) -> str:
    """Canonical text: keys by length, then bytes; a space after colon and comma."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    if isinstance(v, dict):
        keys = sorted(v, key=lambda k: (len(k.encode()), k.encode()))
        return "{" + comma.join(json.dumps(k, ensure_ascii=False) + colon + jsonb_value(v[k], spaced) for k in keys) + "}"
    if isinstance(v, list):
        return "[" + comma.join(jsonb_value(x, spaced) for x in v) + "]"
    if isinstance(v, _Number):
        if "e" in v.text.lower():
            import decimal

            return format(decimal.Decimal(v.text), "f")
        return v.text
    return json.dumps(v, ensure_ascii=False)


def jsonb_text(s: str) -> str:
    return jsonb_value(_loads(s))


def _same(a: Any, b: Any) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def contains(a: Any, b: Any, top: bool = True) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v, False) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(contains(x, y, False) if isinstance(y, (dict, list)) else _same(x, y) for x in a) for y in b)
    if isinstance(a, list) and top and not isinstance(b, dict):
        return any(_same(x, b) for x in a)
    return not isinstance(a, (dict, list)) and not isinstance(b, (dict, list)) and _same(a, b)


def _walk(v: Any, path: list[str]) -> tuple[bool, Any]:
    for p in path:
        if isinstance(v, dict) and p in v:
            v = v[p]
        elif isinstance(v, list) and re.fullmatch(r"-?\d+", p) and -len(v) <= int(p) < len(v):
            v = v[int(p)]
        else:
            return False, None
    return True, v


def _shown(v: Any, text: bool) -> str | None:
    if text and v is None:
        return None
    return v if text and isinstance(v, str) else jsonb_value(v)


def json_path(j: str, path: list[str], text: bool) -> str | None:
    there, v = _walk(_loads(j), path)
    return _shown(v, text) if there else None


def json_set(v: Any, path: list[str], new: Any, create: bool) -> Any:
    if not path:
        return v
    p, rest = path[0], path[1:]
    if isinstance(v, dict):
        if p in v or create and not rest:
            return v | {p: json_set(v[p], rest, new, create) if rest else new}
    elif isinstance(v, list) and re.fullmatch(r"-?\d+", p):
        i = int(p)
        if -len(v) <= i < len(v):
            i %= len(v)
            return [json_set(x, rest, new, create) if rest and j == i else new if j == i else x for j, x in enumerate(v)]
        if create and not rest:
            return [*v, new] if i >= 0 else [new, *v]
    return v


def json_insert(v: Any, path: list[str], new: Any, after: bool) -> Any:
    p, rest = path[0], path[1:]
    if rest:
        if isinstance(v, dict) and p in v:
            return v | {p: json_insert(v[p], rest, new, after)}
        if isinstance(v, list) and -len(v) <= int(p) < len(v):
            i = int(p) % len(v)
            return [json_insert(x, rest, new, after) if j == i else x for j, x in enumerate(v)]
        return v
    if isinstance(v, dict):
        if p in v:
            raise ValueError("22023: cannot replace existing key")
        return v | {p: new}
    if isinstance(v, list):
        i = int(p)
        i = max(0, min(len(v), (len(v) + i if i < 0 else i) + (1 if after else 0)))
        return [*v[:i], new, *v[i:]]
    return v


def json_delete(v: Any, path: list[str]) -> Any:
    p, rest = path[0], path[1:]
    if isinstance(v, dict) and p in v:
        return v | {p: json_delete(v[p], rest)} if rest else {k: x for k, x in v.items() if k != p}
    if isinstance(v, list) and re.fullmatch(r"-?\d+", p) and -len(v) <= int(p) < len(v):
        i = int(p) % len(v)
        return [json_delete(x, rest) if j == i else x for j, x in enumerate(v) if rest or j != i]
    return v


def without_nulls(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: without_nulls(x) for k, x in v.items() if x is not None}
    return [without_nulls(x) for x in v] if isinstance(v, list) else v


def pretty(v: Any, depth: int = 0) -> str:
    pad, end = "    " * (depth + 1), "    " * depth
    if isinstance(v, dict) and v:
        keys = sorted(v, key=lambda k: (len(k.encode()), k.encode()))
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {pretty(v[k], depth + 1)}" for k in keys) + f"\n{end}}}"
    if isinstance(v, list) and v:
        return "[\n" + ",\n".join(pad + pretty(x, depth + 1) for x in v) + f"\n{end}]"
    return {dict: "{\n" + end + "}", list: "[\n" + end + "]"}.get(type(v)) or jsonb_value(v)


def jsonpath(p: str) -> list[str]:
    rest = re.sub(r"^\s*(strict|lax)?\s*\$", "", p)
    out, at = [], 0
    for m in re.finditer(r'\.(?:"((?:[^"\\]|\\.)*)"|([\w$]+))|\[(\d+)\]', rest):
        if rest[at : m.start()].strip():
            break
        out.append(m[1] if m[1] is not None else m[2] if m[2] is not None else m[3])
        at = m.end()
    if rest[at:].strip():
        raise ValueError(f"0A000: jsonpath {p}")
    return out


def _typeof(v: Any) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else {str: "string", list: "array", dict: "object"}[type(v)]


def _elements(j: str, text: bool) -> list[str | None]:
    v = _loads(j)
    if not isinstance(v, list):
        raise ValueError("22023: cannot extract elements from a non-array")
    return [_shown(x, text) for x in v]


def _each(j: str, text: bool) -> list[dict]:
    v = _loads(j)
    if not isinstance(v, dict):
        raise ValueError("22023: cannot deconstruct a non-object")
    return [{"key": k, "value": _shown(v[k], text)} for k in sorted(v, key=lambda k: (len(k.encode()), k.encode()))]


def _jsonb_concat(a: str, b: str) -> str:
    x, y = _loads(a), _loads(b)
    if isinstance(x, dict) and isinstance(y, dict):
        return jsonb_value(x | y)
    return jsonb_value((x if isinstance(x, list) else [x]) + (y if isinstance(y, list) else [y]))


def _jsonb_delete(j: str, key: str, index: bool) -> str:
    v = _loads(j)
    if isinstance(v, dict):
        return jsonb_value({k: x for k, x in v.items() if k != key})
    if index:
        return jsonb_value(json_delete(v, [key]))
    return jsonb_value([x for x in v if x != key])


def _json_has(j: str, key: str) -> bool:
    v = _loads(j)
    return key in v if isinstance(v, dict) else any(isinstance(x, str) and x == key for x in v) if isinstance(v, list) else v == key


def _json_object(a: list[str], b: list[str] | None) -> str:
    pairs = zip(a, b) if b is not None else zip(a[::2], a[1::2])
    return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)} : {json.dumps(v, ensure_ascii=False)}" for k, v in pairs) + "}"


def _set_lax(j: str, path: list[str], new: str | None, create: bool, how: str) -> str | None:
    if new is not None:
        return jsonb_value(json_set(_loads(j), path, _loads(new), create))
    if how == "raise_exception":
        raise ValueError("22004: JSON value must not be null")
    if how == "delete_key":
        return jsonb_value(json_delete(_loads(j), path))
    return jsonb_value(_loads(j) if how == "return_target" else json_set(_loads(j), path, None, create))


# -- strings ---------------------------------------------------------------------------------------------------------


@functools.lru_cache(1024)
def _compiled(p: str, flags: str) -> re.Pattern:
    return re.compile(regex.posix(p, flags.replace("g", "")))


def _regexp_replace(s: str, p: str, r: str, flags: str) -> str:
    template = re.sub(r"\\(\d|&|\\)", lambda m: r"\g<0>" if m[1] == "&" else "\\\\" if m[1] == "\\" else rf"\g<{m[1]}>", r)
    return _compiled(p, flags).sub(template, s, count=0 if "g" in flags else 1)


def _groups(m: re.Match) -> list[str | None]:
    return list(m.groups()) if m.re.groups else [m[0]]


def _nth(s: str, p: str, start: int, n: int, flags: str) -> re.Match | None:
    for i, m in enumerate(_compiled(p, flags).finditer(s, start - 1), 1):
        if i == n:
            return m
    return None


def _regexp_instr(s: str, p: str, start: int, n: int, end: int, flags: str) -> int:
    m = _nth(s, p, start, n, flags)
    return 0 if m is None else (m.end() if end else m.start()) + 1


def _regexp_split(s: str, p: str, flags: str) -> list[str]:
    out, at = [], 0
    for m in _compiled(p, flags).finditer(s):
        if m.end() == m.start() and (m.start() in (0, len(s)) or m.start() == at):
            continue
        out.append(s[at : m.start()])
        at = m.end()
    return [*out, s[at:]]


_IDENT = re.compile(r"[a-z_][a-z0-9_$]*$")


def _quote_ident(s: str) -> str:
    from tessel.dialect.parser import _RESERVED

    return s if _IDENT.match(s) and s not in _RESERVED else '"' + s.replace('"', '""') + '"'


def _quote_literal(s: str) -> str:
    body = s.replace("'", "''")
    return " E'".strip() + body.replace("\\", "\\\\") + "'" if "\\" in s else f"'{body}'"


def _format(f: str, args: list[str | None]) -> str:
    at = 0

    def one(m: re.Match) -> str:
        nonlocal at
        if m[0] == "%%":
            return "%"
        if m["pos"]:
            at = int(m["pos"])
        else:
            at += 1
        width = m["width"]
        if width == "*":
            width = args[at - 1]
            at += 1
        if at > len(args):
            raise ValueError("22023: too few arguments for format()")
        v = args[at - 1]
        if m["kind"] == "s":
            v = v or ""
        elif m["kind"] == "I":
            if v is None:
                raise ValueError("22004: null values cannot be formatted as an SQL identifier")
            v = _quote_ident(v)
        else:
            v = "NULL" if v is None else _quote_literal(v)
        w = int(width or 0)
        return v.ljust(abs(w)) if m["left"] or w < 0 else v.rjust(w)

    return re.sub(r"%%|%(?:(?P<pos>\d+)\$)?(?P<left>-)?(?P<width>\d+|\*)?(?P<kind>[sIL])", one, f)


def _unistr(s: str) -> str:
    return re.sub(r"\\(?:\+([0-9A-Fa-f]{6})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([0-9A-Fa-f]{4})|(\\))", lambda m: "\\" if m[5] else chr(int(m[1] or m[2] or m[3] or m[4], 16)), s)


def array_items(s: str) -> list[str | None]:
    """The elements of an array literal such as {1,"a b",NULL}."""
    s = s.strip()
    if not (s.startswith("{") and s.endswith("}")):
        raise ValueError(f"22P02: malformed array literal: {s}")
    out: list[str | None] = []
    for m in re.finditer(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^,{}]*?))\s*(?:,|$)', s[1:-1]):
        if m[0] == "" and (m.start() == len(s) - 2 and (not s[1:-1] or not s[1:-1].rstrip().endswith(","))):
            break
        out.append(re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else None if m[2].upper() == "NULL" else m[2])
    return out


def _array_text(j: str) -> str:
    def one(v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "{" + ",".join(map(one, v)) + "}"
        if isinstance(v, bool):
            return "t" if v else "f"
        s = v if isinstance(v, str) else jsonb_value(v)
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' if s == "" or s.upper() == "NULL" or re.search(r'[{}",\\\s]', s) else s

    return one(_loads(j)["v"])


def float_text(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    r = repr(x)
    e = math.floor(math.log10(abs(x)))
    if e < -5 or e >= 15:
        m, _, p = f"{x:e}".partition("e") if "e" not in r else r.partition("e")
        if "e" not in r:
            digits = r.replace("-", "").replace(".", "").strip("0") or "0"
            m = ("-" if x < 0 else "") + digits[0] + ("." + digits[1:] if digits[1:] else "")
            p = str(e)
        n = int(p)
        return f"{m.removesuffix('.0')}e{'-' if n < 0 else '+'}{abs(n):02d}"
    return r.removesuffix(".0")


def _trig(name: str, x: float) -> float:
    exact = {"sin": {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}, "cos": {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5}, "tan": {0: 0.0, 45: 1.0, 135: -1.0, 180: 0.0, 225: 1.0, 315: -1.0}, "cot": {45: 1.0, 90: 0.0, 135: -1.0, 270: 0.0}}
    y = math.fmod(x, 360) % 360
    if y in exact[name]:
        return exact[name][y]
    r = math.radians(x)
    return {"sin": math.sin, "cos": math.cos, "tan": math.tan, "cot": lambda v: 1 / math.tan(v)}[name](r)


def _scale(s: str, least: bool) -> int:
    frac = s.partition(".")[2]
    return len(frac.rstrip("0") if least else frac)


def _escape_bytes(b: bytes) -> str:
    return "".join("\\\\" if c == 92 else chr(c) if 32 <= c < 127 else f"\\{c:03o}" for c in b)


def _unescape_bytes(s: str) -> bytes:
    return re.sub(rb"\\(\\|[0-7]{3})", lambda m: b"\\" if m[1] == b"\\" else bytes([int(m[1], 8)]), s.encode())


def _substring_similar(s: str, pattern: str, escape: str) -> str | None:
    """What the part between the two marks (escape and a double quote) matches, the parts around it as short as can be."""
    parts = pattern.split(escape + '"')
    if len(parts) != 3:
        return s if len(parts) == 1 and re.search(regex.similar(pattern, escape), s) else None
    first, mid, last = (regex.similar(p, escape)[5:-1].replace(".*", ".*?" if j != 1 else ".*") for j, p in enumerate(parts))
    m = re.fullmatch(f"(?s:{first})({mid}){last}", s, re.S)
    return m[1] if m else None


def _bit_op(op: str, a: str, b: str) -> str:
    if op in ("<<", ">>"):
        n = int(b)
        return (a[n:] + "0" * n)[: len(a)] if op == "<<" else ("0" * n + a)[: len(a)]
    f = {"&": lambda x, y: x & y, "|": lambda x, y: x | y, "#": lambda x, y: x ^ y}[op]
    return "".join(str(f(int(x), int(y))) for x, y in zip(a, b))


#: name: (function, result type). Every one is strict unless listed in _LAX.
UDFS: dict[str, tuple[Callable, str]] = {
    "jsonb": (jsonb_text, "string"), "json_path": (json_path, "string"), "json_has": (_json_has, "boolean"), "json_has_any": (lambda j, ks: any(_json_has(j, k) for k in ks), "boolean"), "json_has_all": (lambda j, ks: all(_json_has(j, k) for k in ks), "boolean"), "json_typeof": (lambda j: _typeof(_loads(j)), "string"),
    "jsonb_contains": (lambda a, b: contains(_loads(a), _loads(b)), "boolean"), "jsonb_concat": (_jsonb_concat, "string"), "jsonb_delete": (_jsonb_delete, "string"),
    "jsonb_delete_keys": (lambda j, ks: jsonb_value({k: v for k, v in x.items() if k not in ks} if isinstance(x := _loads(j), dict) else [v for v in x if v not in ks]), "string"),
    "jsonb_delete_path": (lambda j, p: jsonb_value(json_delete(_loads(j), p)), "string"), "jsonb_set": (lambda j, p, v, c: jsonb_value(json_set(_loads(j), p, _loads(v), c)), "string"), "jsonb_set_lax": (_set_lax, "string"),
    "jsonb_insert": (lambda j, p, v, a: jsonb_value(json_insert(_loads(j), p, _loads(v), a)), "string"), "jsonb_strip_nulls": (lambda j: jsonb_value(without_nulls(_loads(j))), "string"), "json_strip_nulls": (lambda j: json.dumps(without_nulls(_loads(j)), separators=(",", ":"), ensure_ascii=False, default=str), "string"), "jsonb_pretty": (lambda j: pretty(_loads(j)), "string"),
    "jsonpath": (jsonpath, "array<string>"), "json_elements": (_elements, "array<string>"), "json_each": (_each, "array<struct<key:string,value:string>>"), "json_object": (_json_object, "string"),
    "initcap": (lambda s: re.sub(r"[^\W_]+", lambda m: m[0][0].upper() + m[0][1:].lower(), s), "string"), "chr": (chr, "string"), "quote_ident": (_quote_ident, "string"), "quote_literal": (_quote_literal, "string"),
    "format": (_format, "string"), "unistr": (_unistr, "string"), "encode_escape": (lambda b: _escape_bytes(bytes(b)), "string"), "decode_escape": (_unescape_bytes, "binary"), "bit_op": (_bit_op, "string"),
    "regexp_replace": (_regexp_replace, "string"), "regexp_match": (lambda s, p, f: _groups(m) if (m := _compiled(p, f).search(s)) else None, "array<string>"),
    "regexp_matches": (lambda s, p, f: [_groups(m) for m in _compiled(p, f).finditer(s)][: None if "g" in f else 1], "array<array<string>>"),
    "regexp_substr": (lambda s, p, a, n, f: (m[1] if m.re.groups else m[0]) if (m := _nth(s, p, a, n, f)) else None, "string"), "regexp_instr": (_regexp_instr, "int"), "regexp_split": (_regexp_split, "array<string>"),
    "substring_similar": (_substring_similar, "string"), "similar": (lambda s, p: bool(re.search(regex.similar(p), s)), "boolean"), "array_items": (array_items, "array<string>"), "array_text": (_array_text, "string"), "float_text": (float_text, "string"),
    "gcd": (math.gcd, "bigint"), "factorial": (lambda n: str(math.factorial(n)), "string"), "erf": (math.erf, "double"), "trig_degrees": (_trig, "double"), "scale": (_scale, "int"),
    "interval_text": (iv.text_of, "string"), "interval": (lambda s: dict(zip(("months", "days", "micros"), iv.parsed(s))), "struct<months:int,days:int,micros:bigint>"),
    "to_timestamp": (datetimes.read, "string"), "to_char_time": (datetimes.shown, "string"), "to_char_number": (datetimes.number, "string"), "to_char_interval": (datetimes.interval, "string"),
    "to_tsvector": (ts.to_vector, "string"), "to_tsquery": (ts.to_query, "string"), "plainto_tsquery": (ts.plain_query, "string"), "phraseto_tsquery": (ts.phrase_query, "string"), "ts_match": (ts.match, "boolean"),
    "ts_rank": (ts.rank, "double"), "ts_headline": (ts.headline, "string"), "ts_length": (ts.length, "int"), "ts_setweight": (ts.set_weight, "string"), "ts_strip": (ts.strip, "string"), "ts_numnode": (ts.numnode, "int"),
    "ts_concat": (ts.concat, "string"), "tsvector_in": (ts.vector_in, "string"), "tsquery_in": (ts.query_in, "string"),
}
_LAX = frozenset({"jsonb_set_lax", "json_object", "ts_rank"})


def _strict(f: Callable) -> Callable:
    def run(*a: Any) -> Any:
        return None if any(x is None for x in a) else f(*a)

    return run


def register(spark: SparkSession) -> None:
    """Registers the UDFs once in a session. They are deterministic, so constant calls fold and predicates push down."""
    if getattr(spark, "_tessel_udfs", False):
        return
    for name, (f, kind) in UDFS.items():
        spark.udf.register(f"pg_{name}", F.udf(f if name in _LAX else _strict(f), T._parse_datatype_string(kind) if hasattr(T, "_parse_datatype_string") else kind))
    spark._tessel_udfs = True
