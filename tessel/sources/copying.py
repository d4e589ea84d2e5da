"""COPY FROM STDIN and TO STDOUT in text and csv format."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.dialect.parser import N
from tessel.dialect.translate import Translator, tick
from tessel.errors import SqlError
from tessel.functions import library
from tessel.functions.library import E

_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _records(data: str, o: dict[str, Any]) -> list[list[str | None]]:
    form = o.get("format", "text")
    if form == "csv":
        null, quote = o.get("null", ""), o.get("quote", '"')
        out, row, cell, quoted, i, inside = [], [], [], False, 0, False
        sep = o.get("delimiter", ",")
        while i <= len(data):
            c = data[i] if i < len(data) else "\n"
            if i == len(data) and not (row or cell or quoted):
                break
            if inside:
                if c == quote and data[i + 1 : i + 2] == quote:
                    cell.append(quote)
                    i += 1
                elif c == quote:
                    inside = False
                else:
                    cell.append(c)
            elif c == quote:
                inside = quoted = True
            elif c == sep or c == "\n":
                s = "".join(cell).rstrip("\r") if c == "\n" and not quoted else "".join(cell)
                row.append(None if not quoted and s == null else s)
                cell, quoted = [], False
                if c == "\n":
                    if row == ["\\."]:
                        break
                    out.append(row)
                    row = []
            else:
                cell.append(c)
            i += 1
        return out[1:] if o.get("header") else out
    null, sep, out = o.get("null", "\\N"), o.get("delimiter", "\t"), []
    for line in data.splitlines():
        if line == "\\.":
            break
        cells = re.split(r"(?<!\\)" + re.escape(sep), line)
        out.append([None if c == null else re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), c) for c in cells])
    return out[1:] if o.get("header") else out


def load(session: Any, n: N, data: str) -> int:
    """The payload as an INSERT: its rows are cast, defaulted and checked like any others."""
    if n.kind != "copy" or not n.into:
        raise SqlError("42601", "COPY ... FROM STDIN is expected")
    t = session.registry.table(n.path)
    cols = n.columns or [c for c in t.names() if c not in t.generated]
    rows = _records(data, n.options)
    for r in rows:
        if len(r) != len(cols):
            raise SqlError("22P04", "missing data for column" if len(r) < len(cols) else "extra data after last expected column")
    if not rows:
        return 0
    lit = lambda v: N("lit", value=v, type="null" if v is None else "str")
    values = N("values", rows=[[lit(v) for v in r] for r in rows], ctes=[], order=[], limit=None, offset=None, ties=False)
    return session._run(N("insert", path=n.path, alias=None, columns=cols, overriding="system", query=values, conflict=None, returning=[], ctes=[]), []).count


def dumped(session: Any, n: N, tr: Translator) -> DataFrame:
    """One line of text a row, in column `line`; distributed, so it can be written as it is."""
    if n.query is not None:
        q = tr.query(n.query)
    else:
        relation, cols = session.relation(n.path, tr)
        keep = n.columns or [c for c, _ in cols]
        q = type("Q", (), {"sql": f"SELECT {', '.join(map(tick, keep))} FROM {relation}", "cols": [(c, dict(cols)[c]) for c in keep]})
    o = n.options
    is_csv = o.get("format") == "csv"
    sep, null = o.get("delimiter", "," if is_csv else "\t"), o.get("null", "" if is_csv else "\\N")
    df = session.spark.sql(q.sql)
    cells = []
    for c, k in q.cols:
        text = F.expr(library.as_text(E(tick(c), k)) if k != "bool" else f"CASE WHEN {tick(c)} THEN 't' WHEN NOT {tick(c)} THEN 'f' END")
        if is_csv:
            quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
            text = F.when(text.rlike(f'[{re.escape(sep)}"\\n\\r]') | (text == null), quoted).otherwise(text)
        else:
            for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                text = F.replace(text, F.lit(a), F.lit(b))
        cells.append(F.coalesce(text, F.lit(null)))
    out = df.select(F.concat_ws(sep, *cells).alias("line"))
    if o.get("header"):
        out = session.spark.createDataFrame([(sep.join(c for c, _ in q.cols),)], "line string").union(out)
    return out


