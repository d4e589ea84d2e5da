"""Tokens to a syntax tree: statements of the PostgreSQL dialect, by its public grammar.

A node is an N with a kind and fields. Expressions are read by precedence climbing over the table of binding powers below.
"""

from __future__ import annotations

from typing import Any

from tessel.dialect.lexer import Token, tokenize
from tessel.errors import SqlError, unsupported


class N:
    """A node: kind and fields, equal by value."""

    def __init__(self, kind: str, **fields: Any):
        self.__dict__.update(fields, kind=kind)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, N) and self.__dict__ == other.__dict__

    def __hash__(self) -> int:
        return hash(repr(self))

    def __repr__(self) -> str:
        return f"N({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items())})"

    def but(self, **fields: Any) -> N:
        n = N(self.kind)
        n.__dict__.update(self.__dict__, **fields)
        return n


#: Binding powers, weakest first, after the precedence table of the public documentation.
OR, AND, NOT, IS, COMPARE, RANGE, OTHER, SUM, PRODUCT, POWER, ZONE, COLLATE, SIGN, SUBSCRIPT, CAST = range(1, 16)
_COMPARE = frozenset("< > = <= >= <> !=".split())
_RESERVED = frozenset(
    "all and any array as asc asymmetric both case cast check collate column constraint create cross current_catalog current_date current_role current_time current_timestamp current_user default deferrable desc distinct do else end except false fetch for foreign from full grant group having ilike in initially inner intersect into is isnull join lateral leading left like limit localtime localtimestamp natural not notnull null offset on only or order outer overlaps placing primary references returning right select session_user similar some symmetric table tablesample then to trailing true union unique user using variadic when where window with".split()
)
_NO_ALIAS = _RESERVED | {"set", "values"}
_BARE_CALLS = frozenset("current_catalog current_date current_role current_time current_timestamp current_user localtime localtimestamp session_user user current_schema".split())
_TYPE_WORDS = {
    ("double", "precision"): "float8", ("character", "varying"): "varchar", ("bit", "varying"): "varbit",
    ("timestamp", "with", "time", "zone"): "timestamptz", ("timestamp", "without", "time", "zone"): "timestamp",
    ("time", "with", "time", "zone"): "timetz", ("time", "without", "time", "zone"): "time",
}


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokenize(text), 0

    # -- tokens ------------------------------------------------------------------------------------------------------
    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.t
        self.i += 1
        return t

    def word(self, *words: str) -> bool:
        """Whether the next tokens are these unquoted words."""
        return all((x := self.peek(j)).kind == "id" and x.value == w for j, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.i += len(words)
            return True
        return False

    def op(self, value: str) -> bool:
        return self.t.kind == "op" and self.t.value == value

    def take_op(self, value: str) -> bool:
        if self.op(value):
            self.i += 1
            return True
        return False

    def fail(self) -> SqlError:
        return SqlError("42601", f'syntax error at or near "{self.t.value}"')

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail()

    def need_op(self, value: str) -> None:
        if not self.take_op(value):
            raise self.fail()

    def one_of(self, *words: str) -> str | None:
        for w in words:
            if self.take(*w.split()):
                return w
        return None

    def name(self) -> str:
        if self.t.kind in ("id", "qid"):
            return self.next().value
        raise self.fail()

    def path(self) -> list[str]:
        out = [self.name()]
        while self.op(".") and self.peek().kind in ("id", "qid"):
            self.i += 1
            out.append(self.name())
        return out

    def listed(self, item: Any) -> list:
        out = [item()]
        while self.take_op(","):
            out.append(item())
        return out

    def names(self) -> list[str]:
        self.need_op("(")
        out = self.listed(self.name)
        self.need_op(")")
        return out

    # -- statements --------------------------------------------------------------------------------------------------
    def script(self) -> list[N]:
        out = []
        while self.t.kind != "end":
            if self.take_op(";"):
                continue
            start = self.t.at
            n = self.statement()
            n.sql_text = self.text[start : self.t.at].strip()
            out.append(n)
            if self.t.kind != "end":
                self.need_op(";")
        return out

    def statement(self) -> N:
        t = self.t.value if self.t.kind == "id" else ""
        if t in ("select", "values", "table", "with") or self.op("("):
            return self.query_or_dml()
        if t in ("insert", "update", "delete"):
            return self.dml([])
        method = getattr(self, f"st_{t}", None)
        if method:
            self.i += 1
            return method()
        if t in ("comment", "grant", "revoke", "vacuum", "analyze", "checkpoint", "cluster", "reindex", "lock", "discard", "do", "security", "notify", "listen", "unlisten"):
            while self.t.kind != "end" and not self.op(";"):
                self.i += 1
            return N("noop", what=t)
        if t in ("merge", "declare", "fetch", "move", "close", "call", "load", "import"):
            raise unsupported(t.upper())
        raise self.fail()

    def query_or_dml(self) -> N:
        ctes = self.ctes()
        if self.word("insert") or self.word("update") or self.word("delete"):
            return self.dml(ctes)
        q = self.query()
        return q.but(ctes=ctes + q.ctes) if ctes else q

    def ctes(self) -> list[N]:
        if not self.take("with"):
            return []
        recursive = self.take("recursive")

        def one() -> N:
            name = self.name()
            cols = self.names() if self.op("(") else []
            self.need("as")
            self.take("materialized") or self.take("not", "materialized")
            self.need_op("(")
            body = self.query_or_dml()
            self.need_op(")")
            if self.word("search") or self.word("cycle"):
                raise unsupported("SEARCH and CYCLE")
            return N("cte", name=name, columns=cols, query=body, recursive=recursive)

        return self.listed(one)

    def query(self) -> N:
        """A select with set operations, and the clauses that follow them."""
        ctes = self.ctes()
        n = self.setop(0)
        order = self.order() if self.take("order", "by") else []
        limit = offset = None
        ties = False
        while True:
            if self.take("limit"):
                limit = None if self.take("all") else self.expr()
            elif self.take("offset"):
                offset = self.expr()
                self.take("rows") or self.take("row")
            elif self.take("fetch"):
                self.take("first") or self.take("next")
                limit = N("lit", value="1", type="num") if self.word("row") or self.word("rows") else self.expr(OTHER)
                self.take("rows") or self.take("row")
                if self.take("with", "ties"):
                    ties = True
                else:
                    self.need("only")
            elif self.take("for"):
                while self.t.kind == "id" and self.t.value in ("update", "share", "no", "key", "of", "nowait", "skip", "locked") or (self.t.kind in ("id", "qid") and self.peek(-1).value == "of"):
                    self.i += 1
            else:
                break
        if ties and not order:
            raise SqlError("42601", "WITH TIES needs ORDER BY")
        if order or limit is not None or offset is not None or ctes:
            if n.kind in ("select", "setop", "values") and not n.order and n.limit is None and n.offset is None:
                return n.but(order=order, limit=limit, offset=offset, ties=ties, ctes=ctes + n.ctes)
            return N("select", ctes=ctes, distinct=None, items=[N("star", table=None)], source=[N("subquery", query=n, alias="q", columns=[], lateral=False)], where=None, group=None, having=None, windows={}, order=order, limit=limit, offset=offset, ties=ties)
        return n

    def setop(self, power: int) -> N:
        if self.take_op("("):
            left = self.query()
            self.need_op(")")
            left = left.but(nested=True)
        else:
            left = self.simple()
        while True:
            kind = next((w for w in ("union", "except", "intersect") if self.word(w)), None)
            mine = 2 if kind == "intersect" else 1
            if not kind or mine <= power:
                return left
            self.i += 1
            every = self.take("all")
            self.take("distinct")
            right = self.setop(mine)
            left = N("setop", op=kind, all=every, left=left, right=right, ctes=[], order=[], limit=None, offset=None, ties=False)

    def simple(self) -> N:
        rest = {"ctes": [], "order": [], "limit": None, "offset": None, "ties": False}
        if self.take("values"):
            def row() -> list[N]:
                self.need_op("(")
                out = self.listed(lambda: N("default") if self.take("default") else self.expr())
                self.need_op(")")
                return out

            return N("values", rows=self.listed(row), **rest)
        if self.take("table"):
            return N("select", distinct=None, items=[N("star", table=None)], source=[N("table", path=self.path(), alias=None, columns=[])], where=None, group=None, having=None, windows={}, **rest)
        if not self.take("select"):
            raise self.fail()
        distinct = None
        if self.take("distinct"):
            distinct = []
            if self.take("on"):
                self.need_op("(")
                distinct = self.listed(self.expr)
                self.need_op(")")
        else:
            self.take("all")
        items = [] if self.word("from") or self.word("where") or self.t.kind == "end" or self.op(";") or self.op(")") or self.word("union") else self.listed(self.item)
        if self.word("into"):
            raise unsupported("SELECT INTO")
        source = self.listed(self.source) if self.take("from") else []
        where = self.expr() if self.take("where") else None
        group = None
        if self.take("group", "by"):
            unique = self.take("distinct")
            self.take("all")
            group = N("group", distinct=unique, items=self.listed(self.group_item))
        having = self.expr() if self.take("having") else None
        windows: dict[str, N] = {}
        if self.take("window"):
            for name, spec in self.listed(lambda: (self.name(), self.need("as"), self.window())[::2]):
                windows[name] = spec
        return N("select", distinct=distinct, items=items, source=source, where=where, group=group, having=having, windows=windows, **rest)

    def item(self) -> N:
        if self.take_op("*"):
            return N("star", table=None)
        if self.t.kind in ("id", "qid"):
            j = 0
            while self.peek(j).kind in ("id", "qid") and self.peek(j + 1).value == ".":
                j += 2
            if j and self.peek(j).kind == "op" and self.peek(j).value == "*":
                table = [self.peek(k).value for k in range(0, j, 2)]
                self.i += j + 1
                return N("star", table=table[-1])
        e = self.expr()
        alias = None
        if self.take("as"):
            alias = self.name()
        elif self.t.kind == "qid" or self.t.kind == "id" and self.t.value not in _NO_ALIAS | {"over", "filter", "within"}:
            alias = self.name()
        return N("item", expr=e, alias=alias)

    def order(self) -> list[N]:
        def one() -> N:
            e = self.expr()
            desc = False
            if self.take("using"):
                desc = self.next().value.startswith(">")
            elif self.take("desc"):
                desc = True
            else:
                self.take("asc")
            first = desc
            if self.take("nulls", "first"):
                first = True
            elif self.take("nulls", "last"):
                first = False
            return N("sort", expr=e, desc=desc, nulls_first=first)

        return self.listed(one)

    def group_item(self) -> N:
        if self.take("rollup"):
            return N("rollup", sets=self.group_list())
        if self.take("cube"):
            return N("cube", sets=self.group_list())
        if self.take("grouping", "sets"):
            self.need_op("(")
            out = self.listed(self.group_item)
            self.need_op(")")
            return N("sets", sets=out)
        if self.op("(") and self.peek().value == ")" and self.peek().kind == "op":
            self.i += 2
            return N("gset", exprs=[])
        e = self.expr()
        while e.kind == "paren":
            e = e.arg
        return N("gset", exprs=e.items if e.kind == "row" and not e.explicit else [e])

    def group_list(self) -> list[list[N]]:
        self.need_op("(")
        out = self.listed(self.group_item)
        self.need_op(")")
        return [x.exprs for x in out]

    # -- FROM --------------------------------------------------------------------------------------------------------
    def source(self) -> N:
        left = self.source_item()
        while True:
            natural = self.take("natural")
            kind = self.one_of("cross join", "inner join", "left outer join", "left join", "right outer join", "right join", "full outer join", "full join", "join")
            if not kind:
                if natural:
                    raise self.fail()
                return left
            kind = kind.split()[0].replace("join", "inner")
            right = self.source_item()
            if right.kind != "join" and not natural and kind != "cross" and not (self.word("on") or self.word("using")):
                right = self.joined(right)
            on = using = alias = None
            if kind != "cross" and not natural:
                if self.take("on"):
                    on = self.expr()
                else:
                    self.need("using")
                    using = self.names()
                    alias = self.name() if self.take("as") else None
            left = N("join", how=kind, natural=natural, left=left, right=right, on=on, using=using, alias=alias)

    def joined(self, left: N) -> N:
        """a JOIN b JOIN c ON .. ON ..: the inner join stands to the right."""
        kind = self.one_of("inner join", "left outer join", "left join", "right outer join", "right join", "full outer join", "full join", "join")
        if not kind:
            return left
        right = self.source_item()
        self.need("on")
        return N("join", how=kind.split()[0].replace("join", "inner"), natural=False, left=left, right=right, on=self.expr(), using=None, alias=None)

    def source_item(self) -> N:
        lateral = self.take("lateral")
        self.take("only")
        if self.op("("):
            j = self.i
            depth = 0
            while self.peek(j - self.i).value == "(" and self.peek(j - self.i).kind == "op":
                j += 1
                depth += 1
            first = self.tokens[j]
            if first.kind == "id" and first.value in ("select", "values", "with", "table"):
                self.i += 1
                try:
                    save = self.i
                    q = self.query_or_dml()
                    self.need_op(")")
                    n = N("subquery", query=q, lateral=lateral)
                    return self.aliased(n)
                except SqlError:
                    self.i = save
                    n = self.source()
                    self.need_op(")")
                    return n
            self.i += 1
            n = self.source()
            self.need_op(")")
            return n
        if self.take("rows", "from"):
            self.need_op("(")
            calls = self.listed(self.primary)
            self.need_op(")")
            ordinality = self.take("with", "ordinality")
            return self.aliased(N("function", calls=calls, ordinality=ordinality, lateral=True, rows_from=True))
        j = 0
        while self.peek(j).kind in ("id", "qid") and self.peek(j + 1).value == ".":
            j += 2
        if self.peek(j).kind in ("id", "qid") and self.peek(j + 1).kind == "op" and self.peek(j + 1).value == "(":
            call = self.primary()
            ordinality = self.take("with", "ordinality")
            return self.aliased(N("function", calls=[call], ordinality=ordinality, lateral=True, rows_from=False))
        path = self.path()
        self.take_op("*")
        n = self.aliased(N("table", path=path))
        if self.word("tablesample"):
            raise unsupported("TABLESAMPLE")
        return n

    def aliased(self, n: N) -> N:
        alias, cols, types = None, [], None
        if self.take("as"):
            alias = self.name() if not self.op("(") else None
        elif self.t.kind == "qid" or self.t.kind == "id" and self.t.value not in _NO_ALIAS and not (self.t.value in ("natural", "inner", "left", "right", "full", "cross")):
            alias = self.name()
        if self.op("(") and (alias is not None or self.peek(-1).value == "as"):
            self.i += 1

            def col() -> tuple[str, N | None]:
                name = self.name()
                return name, None if self.op(",") or self.op(")") else self.type()

            got = self.listed(col)
            self.need_op(")")
            cols = [c for c, _ in got]
            types = [t for _, t in got] if any(t for _, t in got) else None
        return n.but(alias=alias, columns=cols, types=types)

    def window(self) -> N:
        self.need_op("(")
        base = self.name() if self.t.kind in ("id", "qid") and self.t.value not in ("partition", "order", "rows", "range", "groups") else None
        partition = self.listed(self.expr) if self.take("partition", "by") else []
        order = self.order() if self.take("order", "by") else []
        frame = None
        if unit := self.one_of("rows", "range", "groups"):
            if self.take("between"):
                start = self.bound()
                self.need("and")
                end = self.bound()
            else:
                start, end = self.bound(), ("current", None)
            exclude = None
            if self.take("exclude"):
                exclude = self.one_of("current row", "group", "ties", "no others")
            frame = N("frame", unit=unit, start=start, end=end, exclude=exclude)
        self.need_op(")")
        return N("window", base=base, partition=partition, order=order, frame=frame)

    def bound(self) -> tuple[str, N | None]:
        if self.take("unbounded"):
            return ("unbounded_" + (self.one_of("preceding", "following") or ""), None)
        if self.take("current", "row"):
            return ("current", None)
        e = self.expr(OTHER)
        return (self.one_of("preceding", "following") or "", e)

    # -- expressions -------------------------------------------------------------------------------------------------
    def expr(self, power: int = 0) -> N:
        left = self.prefix()
        while True:
            more = self.infix(left, power)
            if more is None:
                return left
            left = more

    def prefix(self) -> N:
        t = self.t
        if t.kind == "id" and t.value == "not":
            self.i += 1
            return N("not", arg=self.expr(NOT))
        if t.kind == "op" and t.value in ("+", "-"):
            self.i += 1
            arg = self.expr(SIGN)
            if arg.kind == "lit" and arg.type == "num" and t.value == "-" and not arg.value.startswith("-"):
                return arg.but(value="-" + arg.value)
            return N("unary", op=t.value, arg=arg)
        if t.kind == "op" and t.value in ("~", "@", "|/", "||/", "!!", "@-"):
            self.i += 1
            return N("unary", op=t.value, arg=self.expr(OTHER))
        return self.primary()

    def infix(self, left: N, power: int) -> N | None:
        t = self.t
        if t.kind == "op":
            v = t.value
            if v == "::" and power < CAST:
                self.i += 1
                return N("cast", arg=left, type=self.type())
            if v == "[" and power < SUBSCRIPT:
                return self.subscript(left)
            if v == "." and power < CAST and left.kind in ("row", "paren", "subscript", "cast", "call"):
                self.i += 1
                return N("star_field", arg=left) if self.take_op("*") else N("field", arg=left, name=self.name())
            mine = COMPARE if v in _COMPARE else SUM if v in "+-" else PRODUCT if v in "*/%" else POWER if v == "^" else OTHER
            if v in ("(", ")", "[", "]", ",", ";", ":", ":=", "=>", ".", "..", "::") or mine <= power:
                return None
            self.i += 1
            if quantifier := self.one_of("any", "some", "all"):
                self.need_op("(")
                sub = self.query() if self.t.kind == "id" and self.t.value in ("select", "values", "with", "table") else None
                arg = sub or self.expr()
                self.need_op(")")
                return N("quantified", op="<>" if v == "!=" else v, every=quantifier == "all", left=left, query=sub, array=None if sub else arg)
            return N("binary", op="<>" if v == "!=" else v, left=left, right=self.expr(mine))
        if t.kind != "id":
            return None
        v = t.value
        if v == "or" and power < OR or v == "and" and power < AND:
            self.i += 1
            return N(v, left=left, right=self.expr(OR if v == "or" else AND))
        if power < IS:
            if v == "is":
                self.i += 1
                no = self.take("not")
                if self.take("distinct", "from"):
                    return N("distinct_from", no=no, left=left, right=self.expr(IS))
                if self.take("json"):
                    return N("is_json", no=no, arg=left, what=self.one_of("value", "object", "array", "scalar") or "value")
                what = self.one_of("null", "true", "false", "unknown", "document", "normalized")
                if not what:
                    raise self.fail()
                return N("is", what=what, no=no, arg=left)
            if v in ("isnull", "notnull"):
                self.i += 1
                return N("is", what="null", no=v == "notnull", arg=left)
        no = v == "not" and self.peek().kind == "id" and self.peek().value in ("between", "in", "like", "ilike", "similar")
        w = self.peek().value if no else v
        if w == "similar" and not self.peek(2 if no else 1).value == "to":
            return None
        if power < RANGE and w in ("between", "in", "like", "ilike", "similar"):
            self.i += 2 if no else 1
            if w == "between":
                symmetric = self.take("symmetric")
                self.take("asymmetric")
                low = self.expr(RANGE)
                self.need("and")
                return N("between", no=no, symmetric=symmetric, arg=left, low=low, high=self.expr(RANGE))
            if w == "in":
                self.need_op("(")
                if self.t.kind == "id" and self.t.value in ("select", "values", "with", "table"):
                    q = self.query()
                    self.need_op(")")
                    return N("in_query", no=no, arg=left, query=q)
                items = self.listed(self.expr)
                self.need_op(")")
                return N("in", no=no, arg=left, items=items)
            if w == "similar":
                self.need("to")
            if w != "similar" and (quantifier := self.one_of("any", "all", "some")):
                self.need_op("(")
                arg = self.expr()
                self.need_op(")")
                return N("quantified", op=("!~~" if no else "~~") + ("*" if w == "ilike" else ""), every=quantifier == "all", left=left, query=None, array=arg)
            pattern = self.expr(RANGE)
            escape = self.expr(RANGE) if self.take("escape") else None
            return N("like", no=no, how=w, arg=left, pattern=pattern, escape=escape)
        if v == "overlaps" and power < RANGE:
            self.i += 1
            return N("overlaps", left=left, right=self.expr(RANGE))
        if v == "at" and power < ZONE:
            if self.take("at", "time", "zone"):
                return N("call", name="timezone", args=[self.expr(ZONE), left], named={}, distinct=False, order=[], filter=None, over=None, within=None, star=False, path=["timezone"])
            if self.take("at", "local"):
                return self.call_node(["timezone"], [left])
        if v == "collate" and power < COLLATE:
            self.i += 1
            self.path()
            return left
        if v == "operator" and self.peek().value == "(" and power < OTHER:
            self.i += 2
            while self.t.kind in ("id", "qid"):
                self.i += 1
                self.need_op(".")
            op = self.next().value
            self.need_op(")")
            return N("binary", op=op, left=left, right=self.expr(OTHER))
        return None

    def subscript(self, left: N) -> N:
        self.need_op("[")
        low = None if self.op(":") else self.expr()
        if self.take_op(":"):
            high = None if self.op("]") else self.expr()
            self.need_op("]")
            return N("slice", arg=left, low=low, high=high)
        self.need_op("]")
        return N("subscript", arg=left, index=low)

    def primary(self) -> N:
        t = self.t
        if t.kind == "num":
            self.i += 1
            v = t.value
            if v[:2].lower() in ("0x", "0o", "0b"):
                v = str(int(v, 0))
            return N("lit", value=v, type="num")
        if t.kind == "str":
            self.i += 1
            s = t.value
            while self.t.kind == "str" and "\n" in self.text[t.at : self.t.at]:
                s += self.next().value
            return N("lit", value=s, type="str")
        if t.kind == "bit":
            self.i += 1
            return N("lit", value="".join(f"{int(c, 16):04b}" for c in t.value[1:]) if t.value.startswith("x") else t.value, type="bit")
        if t.kind == "param":
            self.i += 1
            return N("param", n=int(t.value))
        if t.kind == "op" and t.value == "(":
            self.i += 1
            if self.t.kind == "id" and self.t.value in ("select", "values", "with", "table"):
                q = self.query()
                self.need_op(")")
                return N("scalar", query=q)
            if self.take_op(")"):
                return N("row", items=[], explicit=False)
            items = self.listed(self.expr)
            self.need_op(")")
            return N("paren", arg=items[0]) if len(items) == 1 else N("row", items=items, explicit=False)
        if t.kind == "op" and t.value == "*":
            self.i += 1
            return N("star", table=None)
        if t.kind == "qid":
            return self.reference()
        if t.kind != "id":
            raise self.fail()
        v = t.value
        special = getattr(self, f"ex_{v}", None)
        if special and (v in ("case", "cast", "exists", "row", "array", "null", "true", "false", "interval", "default") or self.peek().value == "("):
            out = special()
            if out is not None:
                return out
        if v in _BARE_CALLS and not (self.peek().value == "(" and self.peek().kind == "op"):
            self.i += 1
            return self.call_node([v], [])
        if v in _BARE_CALLS and self.peek().value == "(" and v.startswith(("current_t", "local")):
            self.i += 2
            self.next()
            self.need_op(")")
            return self.call_node([v], [])
        if v in _RESERVED and v not in ("left", "right", "user", "any", "current_user", "session_user", "current_role", "current_catalog", "overlaps", "like"):
            raise self.fail()
        typed = self.typed_literal()
        return typed or self.reference()

    def typed_literal(self) -> N | None:
        """TYPE 'text'."""
        save = self.i
        if self.t.value in ("date", "time", "timestamp", "timestamptz", "timetz", "bool", "boolean", "int", "integer", "bigint", "smallint", "numeric", "decimal", "float", "real", "double", "text", "varchar", "json", "jsonb", "uuid", "bytea", "tsvector", "tsquery", "float8", "float4", "int4", "int8", "int2", "bit", "inet", "money", "char", "character"):
            try:
                kind = self.type()
                if self.t.kind == "str":
                    return N("cast", arg=N("lit", value=self.next().value, type="str"), type=kind)
            except SqlError:
                pass
            self.i = save
        return None

    def reference(self) -> N:
        path = self.path()
        if self.op("("):
            return self.call(path)
        if self.op(".") and self.peek().value == "*":
            self.i += 2
            return N("star", table=path[-1])
        return N("col", path=path)

    def call_node(self, path: list[str], args: list[N], **more: Any) -> N:
        base = {"named": {}, "distinct": False, "order": [], "filter": None, "over": None, "within": None, "star": False}
        return N("call", name=path[-1], path=path, args=args, **base | more)

    def call(self, path: list[str]) -> N:
        self.need_op("(")
        args: list[N] = []
        named: dict[str, N] = {}
        star = distinct = False
        order: list[N] = []
        if self.take_op("*"):
            star = True
        elif not self.op(")"):
            distinct = self.take("distinct")
            self.take("all")
            while True:
                self.take("variadic")
                if self.t.kind in ("id", "qid") and self.peek().value in ("=>", ":=") and self.peek().kind == "op":
                    name = self.name()
                    self.i += 1
                    named[name] = self.expr()
                else:
                    args.append(self.expr())
                if not self.take_op(","):
                    break
            if self.take("order", "by"):
                order = self.order()
        self.need_op(")")
        within = filter_ = over = None
        if self.take("within", "group"):
            self.need_op("(")
            self.need("order", "by")
            within = self.order()
            self.need_op(")")
        if self.word("filter") and self.peek().value == "(":
            self.i += 2
            self.need("where")
            filter_ = self.expr()
            self.need_op(")")
        if self.take("over"):
            over = self.window() if self.op("(") else N("window", base=self.name(), partition=[], order=[], frame=None, named=True)
        return self.call_node(path, args, named=named, star=star, distinct=distinct, order=order, within=within, filter=filter_, over=over)

    def ex_case(self) -> N:
        self.i += 1
        subject = None if self.word("when") else self.expr()
        whens = []
        while self.take("when"):
            c = self.expr()
            self.need("then")
            whens.append((c, self.expr()))
        other = self.expr() if self.take("else") else None
        self.need("end")
        return N("case", subject=subject, whens=whens, other=other)

    def ex_cast(self) -> N:
        self.i += 1
        self.need_op("(")
        e = self.expr()
        self.need("as")
        kind = self.type()
        self.need_op(")")
        return N("cast", arg=e, type=kind)

    def ex_exists(self) -> N:
        self.i += 1
        self.need_op("(")
        q = self.query()
        self.need_op(")")
        return N("exists", query=q)

    def ex_row(self) -> N | None:
        if self.peek().value != "(":
            return None
        self.i += 2
        items = [] if self.op(")") else self.listed(self.expr)
        self.need_op(")")
        return N("row", items=items, explicit=True)

    def ex_array(self) -> N:
        self.i += 1
        if self.take_op("("):
            q = self.query()
            self.need_op(")")
            return N("array_query", query=q)
        return self.array_literal()

    def array_literal(self) -> N:
        self.need_op("[")
        items = []
        if not self.op("]"):
            items = self.listed(lambda: self.array_literal() if self.op("[") else self.expr())
        self.need_op("]")
        return N("array", items=items)

    def ex_null(self) -> N:
        self.i += 1
        return N("lit", value=None, type="null")

    def ex_true(self) -> N:
        self.i += 1
        return N("lit", value=True, type="bool")

    def ex_false(self) -> N:
        self.i += 1
        return N("lit", value=False, type="bool")

    def ex_default(self) -> N:
        self.i += 1
        return N("default")

    def ex_interval(self) -> N | None:
        if self.peek().kind == "str":
            self.i += 1
            text = self.next().value
            unit = None
            if self.t.kind == "id" and self.t.value in ("year", "month", "day", "hour", "minute", "second"):
                unit = self.next().value
                if self.take("to"):
                    unit += " to " + self.next().value
            return N("interval", text=text, unit=unit)
        return None

    def ex_extract(self) -> N:
        self.i += 2
        field = self.next().value
        self.need("from")
        e = self.expr()
        self.need_op(")")
        return self.call_node(["extract"], [N("lit", value=field.lower(), type="str"), e])

    def ex_position(self) -> N | None:
        save = self.i
        self.i += 2
        needle = self.expr(RANGE)
        if not self.take("in"):
            self.i = save
            return None
        hay = self.expr()
        self.need_op(")")
        return self.call_node(["strpos"], [hay, needle])

    def ex_substring(self) -> N:
        self.i += 2
        args = [self.expr()]
        name = "substring"
        if self.take("from"):
            args.append(self.expr())
            if self.take("for"):
                args.append(self.expr())
        elif self.take("for"):
            args += [N("lit", value="1", type="num"), self.expr()]
        elif self.take("similar"):
            args.append(self.expr(RANGE))
            self.need("escape")
            args.append(self.expr())
            name = "substring_similar"
        else:
            while self.take_op(","):
                args.append(self.expr())
        self.need_op(")")
        return self.call_node([name], args)

    def ex_overlay(self) -> N:
        self.i += 2
        args = [self.expr()]
        if self.take("placing"):
            args.append(self.expr())
            self.need("from")
            args.append(self.expr())
            if self.take("for"):
                args.append(self.expr())
        else:
            while self.take_op(","):
                args.append(self.expr())
        self.need_op(")")
        return self.call_node(["overlay"], args)

    def ex_trim(self) -> N:
        self.i += 2
        how = self.one_of("leading", "trailing", "both") or "both"
        name = {"leading": "ltrim", "trailing": "rtrim", "both": "btrim"}[how]
        if self.take("from"):
            args = self.listed(self.expr)
        else:
            args = [self.expr()]
            if self.take("from"):
                args = [self.expr(), args[0]]
            elif self.take_op(","):
                args.append(self.expr())
        self.need_op(")")
        return self.call_node([name], args)

    # -- types -------------------------------------------------------------------------------------------------------
    def type(self) -> N:
        for words, name in sorted(_TYPE_WORDS.items(), key=lambda x: -len(x[0])):
            if self.word(*words):
                self.i += len(words)
                break
            if words[0] in ("timestamp", "time") and self.word(words[0]) and self.peek().value == "(" and all((x := self.peek(4 + j)).value == w for j, w in enumerate(words[1:])):
                self.i += 3 + len(words)
                break
        else:
            name = self.path()[-1]
        mods: list[int] = []
        if name == "interval":
            while self.t.kind == "id" and self.t.value in ("year", "month", "day", "hour", "minute", "second", "to"):
                self.i += 1
        if self.op("(") and self.peek().kind == "num":
            self.i += 1
            mods = [int(x) for x in self.listed(lambda: self.next().value)]
            self.need_op(")")
            if name in ("timestamp", "time") and self.take("with", "time", "zone"):
                name += "tz"
            else:
                self.take("without", "time", "zone")
        dims = 0
        while self.op("[") or self.word("array"):
            if self.take("array"):
                dims += 1
                if not self.op("["):
                    continue
            self.need_op("[")
            if self.t.kind == "num":
                self.i += 1
            self.need_op("]")
            dims += 1
        return N("type", name=name, mods=mods, dims=min(dims, 1) if dims else 0)

    # -- data modification -------------------------------------------------------------------------------------------
    def dml(self, ctes: list[N]) -> N:
        n = getattr(self, "dml_" + self.next().value)()
        n.returning = self.listed(self.item) if self.take("returning") else []
        n.ctes = ctes
        return n

    def target(self) -> tuple[list[str], str | None]:
        self.take("only")
        path = self.path()
        self.take_op("*")
        alias = self.name() if self.take("as") or self.t.kind == "id" and self.t.value not in _NO_ALIAS | {"set", "using", "default", "overriding"} else None
        return path, alias

    def dml_insert(self) -> N:
        self.need("into")
        path, alias = self.path(), None
        if self.take("as"):
            alias = self.name()
        cols = self.names() if self.op("(") and self.peek().kind in ("id", "qid") and self.peek().value not in ("select", "values", "with") else []
        overriding = None
        if self.take("overriding"):
            overriding = self.next().value
            self.need("value")
        query = None if self.take("default", "values") else self.query()
        conflict = None
        if self.take("on", "conflict"):
            keys, name = [], None
            if self.take("on", "constraint"):
                name = self.name()
            elif self.op("("):
                keys = self.names()
                if self.take("where"):  # a partial index: its predicate only chooses the arbiter
                    self.expr()
            self.need("do")
            if self.take("nothing"):
                conflict = N("conflict", keys=keys, constraint=name, sets=None, where=None)
            else:
                self.need("update", "set")
                sets = self.listed(self.assignment)
                conflict = N("conflict", keys=keys, constraint=name, sets=sets, where=self.expr() if self.take("where") else None)
        return N("insert", path=path, alias=alias, columns=cols, overriding=overriding, query=query, conflict=conflict)

    def assignment(self) -> tuple[list[str], N]:
        if self.op("("):
            cols = self.names()
            self.need_op("=")
            e = self.expr()
            return cols, e
        col = self.name()
        self.need_op("=")
        return [col], N("default") if self.take("default") else self.expr()

    def dml_update(self) -> N:
        path, alias = self.target()
        self.need("set")
        sets = self.listed(self.assignment)
        source = self.listed(self.source) if self.take("from") else []
        if self.word("where", "current", "of"):
            raise unsupported("WHERE CURRENT OF")
        return N("update", path=path, alias=alias, sets=sets, source=source, where=self.expr() if self.take("where") else None)

    def dml_delete(self) -> N:
        self.need("from")
        path, alias = self.target()
        source = self.listed(self.source) if self.take("using") else []
        return N("delete", path=path, alias=alias, source=source, where=self.expr() if self.take("where") else None)

    # -- other statements --------------------------------------------------------------------------------------------
    def exists_clause(self, no: bool) -> bool:
        return self.take("if", "not", "exists") if no else self.take("if", "exists")

    def st_create(self) -> N:
        replace = self.take("or", "replace")
        temp = self.take("temporary") or self.take("temp") or self.take("unlogged")
        self.take("recursive")
        if self.take("table"):
            return self.create_table(bool(temp))
        if self.take("view"):
            path = self.path()
            cols = self.names() if self.op("(") else []
            self.need("as")
            return N("create_view", path=path, columns=cols, query=self.query(), replace=replace, materialized=False, no_data=False, quiet=False)
        if self.take("materialized", "view"):
            quiet = self.exists_clause(True)
            path = self.path()
            cols = self.names() if self.op("(") else []
            self.need("as")
            q = self.query()
            no_data = self.take("with", "no", "data")
            self.take("with", "data")
            return N("create_view", path=path, columns=cols, query=q, replace=False, materialized=True, no_data=no_data, quiet=quiet)
        unique = self.take("unique")
        if self.take("index"):
            self.take("concurrently")
            quiet = self.exists_clause(True)
            name = None if self.word("on") else self.name()
            self.need("on")
            self.take("only")
            path = self.path()
            if self.take("using"):
                self.name()
            self.need_op("(")

            def part() -> N:
                e = self.expr()
                while self.t.kind == "id" and self.t.value in ("asc", "desc", "nulls", "first", "last") or self.t.kind == "id" and self.t.value.endswith("_ops"):
                    self.i += 1
                return e

            parts = self.listed(part)
            self.need_op(")")
            if self.take("include"):
                self.names()
            nulls = True
            if self.take("nulls"):
                nulls = not self.take("not", "distinct")
                self.take("distinct")
            return N("create_index", name=name, path=path, exprs=parts, unique=unique, quiet=quiet, nulls_distinct=nulls, where=self.expr() if self.take("where") else None)
        if self.take("schema"):
            quiet = self.exists_clause(True)
            return N("create_schema", name=self.name(), quiet=quiet)
        if self.take("sequence"):
            quiet = self.exists_clause(True)
            return N("create_sequence", path=self.path(), options=self.sequence_options(), quiet=quiet)
        if self.take("type"):
            path = self.path()
            self.need("as", "enum")
            self.need_op("(")
            labels = [] if self.op(")") else self.listed(lambda: self.next().value)
            self.need_op(")")
            return N("create_enum", path=path, labels=labels)
        if self.take("domain"):
            path = self.path()
            self.take("as")
            kind = self.type()
            checks, not_null, default = [], False, None
            while True:
                if self.take("constraint"):
                    self.name()
                if self.take("check"):
                    checks.append(self.expr())
                elif self.take("not", "null"):
                    not_null = True
                elif self.take("default"):
                    default = self.expr(RANGE)
                elif not self.take("null"):
                    break
            return N("create_domain", path=path, type=kind, checks=checks, not_null=not_null, default=default)
        if self.take("function"):
            return self.create_function(replace)
        if self.take("trigger"):
            name = self.name()
            when = self.one_of("before", "after", "instead of")
            events = [self.next().value]
            while self.take("or"):
                events.append(self.next().value)
            if self.take("of"):
                self.listed(self.name)
            self.need("on")
            path = self.path()
            row = False
            if self.take("for"):
                self.take("each")
                row = self.next().value == "row"
            cond = None
            if self.take("when"):
                cond = self.expr()
            self.need("execute")
            self.next()
            call = self.call(self.path())
            return N("create_trigger", name=name, when=when, events=events, path=path, row=row, cond=cond, function=call.path)
        raise unsupported(f"CREATE {self.t.value.upper()}")

    def create_function(self, replace: bool) -> N:
        path = self.path()
        self.need_op("(")
        args = []
        while not self.take_op(")"):
            self.one_of("in", "variadic")
            if self.word("out") or self.word("inout"):
                raise unsupported("OUT arguments")
            save = self.i
            name = self.name()
            if self.op(",") or self.op(")") or self.word("default") or self.op("=") or self.op("("):
                self.i = save
                name = ""
            kind = self.type()
            default = self.expr() if self.take("default") or self.take_op("=") else None
            args.append((name, kind, default))
            self.take_op(",")
        returns = table = None
        setof = False
        if self.take("returns"):
            if self.take("table"):
                self.need_op("(")
                table = self.listed(lambda: (self.name(), self.type()))
                self.need_op(")")
            else:
                setof = self.take("setof")
                returns = self.type()
        body = language = None
        strict = False
        while self.t.kind != "end" and not self.op(";"):
            if self.take("language"):
                language = self.next().value.lower()
            elif self.take("as"):
                body = self.next().value
            elif self.take("strict") or self.take("returns", "null", "on", "null", "input"):
                strict = True
            elif self.take("return"):
                start = self.t.at
                self.expr()
                body, language = "SELECT " + self.text[start : self.t.at], "sql"
            else:
                self.i += 1
        return N("create_function", path=path, args=args, returns=returns, table=table, setof=setof, language=language, body=body, strict=strict, replace=replace)

    def sequence_options(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        number = lambda: int(("-" if self.take_op("-") else "") + self.next().value)
        while True:
            if self.take("increment"):
                self.take("by")
                out["increment"] = number()
            elif self.take("start"):
                self.take("with")
                out["start"] = number()
            elif self.take("restart"):
                self.take("with")
                out["restart"] = number() if self.t.kind == "num" or self.op("-") else None
            elif self.take("minvalue"):
                out["min"] = number()
            elif self.take("maxvalue"):
                out["max"] = number()
            elif self.take("cache"):
                number()
            elif self.take("no"):
                out.pop({"minvalue": "min", "maxvalue": "max"}.get(self.next().value, ""), None)
            elif self.take("cycle"):
                out["cycle"] = True
            elif self.take("owned"):
                self.need("by")
                self.path()
            elif self.take("as"):
                self.type()
            else:
                return out

    def create_table(self, temp: bool) -> N:
        quiet = self.exists_clause(True)
        path = self.path()
        if self.word("as") or self.op("(") and self._is_name_list():
            cols = self.names() if self.op("(") else []
            self.need("as")
            q = self.query()
            no_data = self.take("with", "no", "data")
            self.take("with", "data")
            return N("create_as", path=path, columns=cols, query=q, quiet=quiet, no_data=no_data)
        if self.word("partition") or self.word("of"):
            raise unsupported("table partitioning")
        self.need_op("(")
        columns, constraints, likes = [], [], []
        while not self.take_op(")"):
            if self.take("like"):
                path_, parts = self.path(), set()
                while (more := self.take("including")) or self.take("excluding"):
                    what = self.next().value
                    parts = parts | {what} if more else parts - {what}
                likes.append((path_, parts))
            elif self.t.kind == "id" and self.t.value in ("constraint", "primary", "unique", "check", "foreign", "exclude"):
                constraints.append(self.table_constraint())
            else:
                columns.append(self.column())
            self.take_op(",")
        if self.word("inherits") or self.word("partition"):
            raise unsupported("inheritance and partitioning")
        if self.take("on", "commit"):
            self.one_of("preserve rows", "delete rows", "drop")
        return N("create_table", path=path, columns=columns, constraints=constraints, likes=likes, quiet=quiet, temp=temp)

    def _is_name_list(self) -> bool:
        j = 1
        while self.peek(j).kind in ("id", "qid") and self.peek(j + 1).value in (",", ")"):
            if self.peek(j + 1).value == ")":
                return self.peek(j + 2).value == "as"
            j += 2
        return False

    def column(self) -> N:
        c = N("column", name=self.name(), type=self.type(), not_null=False, default=None, generated=None, identity=None, constraints=[])
        while True:
            name = self.name() if self.take("constraint") else None
            if self.take("not", "null"):
                c.not_null = True
            elif self.take("null"):
                pass
            elif self.take("default"):
                c.default = self.expr(RANGE)
            elif self.take("primary", "key"):
                c.not_null = True
                c.constraints.append(N("unique", name=name, columns=[c.name], primary=True, nulls_distinct=True))
            elif self.take("unique"):
                nulls = True
                if self.take("nulls"):
                    nulls = not self.take("not", "distinct")
                    self.take("distinct")
                c.constraints.append(N("unique", name=name, columns=[c.name], primary=False, nulls_distinct=nulls))
            elif self.take("check"):
                c.constraints.append(N("check", name=name, expr=self.expr()))
            elif self.take("references"):
                c.constraints.append(self.references(name, [c.name]))
            elif self.take("generated"):
                always = self.one_of("always", "by default")
                self.need("as")
                if self.take("identity"):
                    c.identity = always
                    c.not_null = True
                    c.options = {}
                    if self.take_op("("):
                        c.options = self.sequence_options()
                        self.need_op(")")
                else:
                    c.generated = self.expr()
                    self.take("stored")
                    self.take("virtual")
            elif self.take("collate"):
                self.path()
            elif self.take("deferrable") or self.take("not", "deferrable") or self.take("initially", "deferred") or self.take("initially", "immediate"):
                pass
            else:
                return c

    def references(self, name: str | None, columns: list[str]) -> N:
        path = self.path()
        to = self.names() if self.op("(") else []
        full = deferred = False
        actions = {"delete": "no action", "update": "no action"}
        while True:
            if self.take("match"):
                full = self.next().value == "full"
            elif self.take("on"):
                what = self.next().value
                actions[what] = self.one_of("cascade", "set null", "set default", "restrict", "no action") or ""
            elif self.take("initially", "deferred"):
                deferred = True
            elif not (self.take("deferrable") or self.take("not", "deferrable") or self.take("initially", "immediate") or self.take("not", "valid")):
                return N("foreign", name=name, columns=columns, path=path, to=to, full=full, deferred=deferred, on_delete=actions["delete"], on_update=actions["update"])

    def table_constraint(self) -> N:
        name = self.name() if self.take("constraint") else None
        if self.take("primary", "key"):
            return N("unique", name=name, columns=self.names(), primary=True, nulls_distinct=True)
        if self.take("unique"):
            nulls = True
            if self.take("nulls"):
                nulls = not self.take("not", "distinct")
                self.take("distinct")
            return N("unique", name=name, columns=self.names(), primary=False, nulls_distinct=nulls)
        if self.take("check"):
            e = self.expr()
            self.take("no", "inherit")
            return N("check", name=name, expr=e)
        if self.take("foreign", "key"):
            cols = self.names()
            self.need("references")
            return self.references(name, cols)
        raise unsupported("EXCLUDE constraints")

    def st_alter(self) -> N:
        what = self.one_of("table", "sequence", "view", "materialized view", "index", "schema", "type", "domain")
        quiet = self.exists_clause(False)
        self.take("only")
        path = self.path()
        if what == "sequence" and not self.word("rename") and not self.word("set"):
            return N("alter_sequence", path=path, options=self.sequence_options())
        if what == "type" and self.take("add", "value"):
            missing = self.exists_clause(True)
            label = self.next().value
            place = self.one_of("before", "after")
            return N("alter_enum", path=path, label=label, place=place, at=self.next().value if place else None, quiet=missing)
        if what == "type" and self.take("rename", "value"):
            old = self.next().value
            self.need("to")
            return N("alter_enum", path=path, label=self.next().value, place="rename", at=old, quiet=False)

        def action() -> N:
            if self.take("add"):
                if self.t.kind == "id" and self.t.value in ("constraint", "primary", "unique", "check", "foreign"):
                    return N("add_constraint", constraint=self.table_constraint())
                self.take("column")
                missing = self.exists_clause(True)
                return N("add_column", column=self.column(), quiet=missing)
            if self.take("drop"):
                if self.take("constraint"):
                    missing = self.exists_clause(False)
                    n = N("drop_constraint", name=self.name(), quiet=missing)
                else:
                    self.take("column")
                    missing = self.exists_clause(False)
                    n = N("drop_column", name=self.name(), quiet=missing)
                self.one_of("cascade", "restrict")
                return n
            if self.take("rename"):
                if self.take("to"):
                    return N("rename", to=self.name())
                kind = "constraint" if self.take("constraint") else "column"
                self.take("column")
                old = self.name()
                self.need("to")
                return N(f"rename_{kind}", name=old, to=self.name())
            if self.take("alter"):
                self.take("column")
                c = self.name()
                if self.take("set", "default"):
                    return N("set_default", name=c, expr=self.expr())
                if self.take("drop", "default"):
                    return N("set_default", name=c, expr=None)
                if self.take("set", "not", "null") or self.take("drop", "not", "null"):
                    return N("set_not_null", name=c, on=self.peek(-3).value == "set")
                self.take("set", "data")
                self.need("type")
                kind = self.type()
                return N("set_type", name=c, type=kind, using=self.expr() if self.take("using") else None)
            if self.take("set", "schema"):
                return N("set_schema", to=self.name())
            while self.t.kind != "end" and not self.op(";") and not self.op(","):
                self.i += 1
            return N("nothing")

        return N("alter", what=what, path=path, actions=self.listed(action), quiet=quiet)

    def st_drop(self) -> N:
        what = self.one_of("table", "view", "materialized view", "index", "schema", "sequence", "type", "domain", "function", "trigger")
        if not what:
            raise unsupported("DROP " + self.t.value.upper())
        quiet = self.exists_clause(False)
        paths = self.listed(self.path)
        if what == "function" and self.take_op("("):
            while not self.take_op(")"):
                self.i += 1
        on = self.path() if self.take("on") else None
        return N("drop", what=what, paths=paths, quiet=quiet, on=on, cascade=self.one_of("cascade", "restrict") == "cascade")

    def st_truncate(self) -> N:
        self.take("table")
        paths = self.listed(lambda: (self.take("only"), self.path())[1])
        restart = self.one_of("restart identity", "continue identity") == "restart identity"
        return N("truncate", paths=paths, restart=restart, cascade=self.one_of("cascade", "restrict") == "cascade")

    def st_refresh(self) -> N:
        self.need("materialized", "view")
        self.take("concurrently")
        path = self.path()
        no_data = self.take("with", "no", "data")
        self.take("with", "data")
        return N("refresh", path=path, no_data=no_data)

    def _rest(self) -> None:
        while self.t.kind != "end" and not self.op(";"):
            self.i += 1

    def st_begin(self) -> N:
        self._rest()
        return N("begin")

    def st_start(self) -> N:
        self._rest()
        return N("begin")

    def st_commit(self) -> N:
        self._rest()
        return N("commit")

    st_end = st_commit

    def st_rollback(self) -> N:
        self.take("work") or self.take("transaction")
        if self.take("to"):
            self.take("savepoint")
            return N("rollback_to", name=self.name())
        return N("rollback")

    st_abort = st_rollback

    def st_savepoint(self) -> N:
        return N("savepoint", name=self.name())

    def st_release(self) -> N:
        self.take("savepoint")
        return N("release", name=self.name())

    def st_set(self) -> N:
        self.take("session")
        local = self.take("local")
        if self.take("time", "zone"):
            name = "timezone"
        elif self.word("transaction") or self.word("constraints") or self.word("role"):
            self._rest()
            return N("noop", what="set")
        else:
            name = ".".join(self.path())
            if not self.take("to"):
                self.need_op("=")
        values = []
        while self.t.kind != "end" and not self.op(";"):
            if not self.take_op(","):
                values.append(("-" if self.take_op("-") else "") + self.next().value)
        return N("set", name=name, value=", ".join(values), local=local)

    def st_show(self) -> N:
        if self.take("time", "zone"):
            return N("show", name="timezone")
        return N("show", name=".".join(self.path()))

    def st_reset(self) -> N:
        return N("reset", name=".".join(self.path()))

    def st_prepare(self) -> N:
        name = self.name()
        if self.op("("):
            self.i += 1
            self.listed(self.type)
            self.need_op(")")
        self.need("as")
        return N("prepare", name=name, statement=self.statement())

    def st_execute(self) -> N:
        name = self.name()
        args = []
        if self.take_op("("):
            args = [] if self.op(")") else self.listed(self.expr)
            self.need_op(")")
        return N("execute", name=name, args=args)

    def st_deallocate(self) -> N:
        self.take("prepare")
        return N("deallocate", name=None if self.take("all") else self.name())

    def st_explain(self) -> N:
        analyze = False
        if self.take_op("("):
            while not self.take_op(")"):
                analyze |= self.word("analyze")
                self.i += 1
        analyze |= self.take("analyze")
        self.take("verbose")
        return N("explain", statement=self.statement(), analyze=analyze)

    def st_copy(self) -> N:
        query = path = None
        cols: list[str] = []
        if self.take_op("("):
            query = self.query()
            self.need_op(")")
        else:
            path = self.path()
            cols = self.names() if self.op("(") else []
        into = self.one_of("from", "to")
        if not self.one_of("stdin", "stdout"):
            raise unsupported("COPY with files or programs")
        options: dict[str, Any] = {}
        self.take("with")
        paren = self.take_op("(")
        while self.t.kind not in ("end",) and not self.op(";") and not self.take_op(")"):
            if self.take_op(","):
                continue
            key = self.name()
            if key in ("csv", "text", "binary") and not paren:
                options["format"] = key
            elif key == "header":
                options["header"] = not self.take("false") if not self.take("true") else True
            else:
                self.take("as")
                options[key] = self.next().value
        if options.get("format") == "binary":
            raise unsupported("COPY in binary format")
        return N("copy", query=query, path=path, columns=cols, into=into == "from", options=options)


def parse(text: str) -> list[N]:
    return Parser(text).script()
