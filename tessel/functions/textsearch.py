"""Text search: vectors, queries, matching, ranking. Vectors and queries travel as canonical text.

The english configuration drops stop words and stems by the published Porter algorithm (the second revision's common
rules); simple only folds case.
"""

from __future__ import annotations

import functools
import re

#: Stop words of the english configuration.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?", re.U)
_V = "aeiouy"


def _regions(w: str) -> tuple[int, int]:
    m = re.search(r"[aeiouy][^aeiouy]", w)
    r1 = m.end() if m else len(w)
    for p in ("gener", "commun", "arsen"):
        if w.startswith(p):
            r1 = len(p)
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, r1)
    return r1, m.end() if m else len(w)


def _short(w: str) -> bool:
    return bool(re.search(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", w))


#: Suffix tables of the published algorithm.
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_ODD = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}


@functools.lru_cache(50_000)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii():
        return w
    if w in _ODD:
        return _ODD[w]
    w = w.removesuffix("'s")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w.endswith(("eedly", "eed")):
        base = w.removesuffix("ly")[:-3]
        if len(base) >= r1:
            w = base + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for table, low in ((_STEP2, r1), (_STEP3, r1)):
        for s, r in table.items():
            if w.endswith(s):
                if len(w) - len(s) >= low:
                    w = w[: len(w) - len(s)] + r
                break
        else:
            if table is _STEP2 and w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
            elif table is _STEP2 and w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
                w = w[:-2]
            elif table is _STEP3 and w.endswith("ative") and len(w) - 5 >= r2:
                w = w[:-5]
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: len(w) - len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def _lexeme(word: str, config: str) -> str | None:
    w = word.lower()
    if config == "simple":
        return w
    return None if w in STOP else stem(w)


def _words(text: str, config: str):
    for i, m in enumerate(_WORD.finditer(text), 1):
        yield i, m, _lexeme(m[0], config)


Vector = dict[str, list[tuple[int, str]]]


def _quote(w: str) -> str:
    return "'" + w.replace("'", "''") + "'"


def _show(v: Vector) -> str:
    return " ".join(_quote(w) + (":" + ",".join(f"{p}{x if x != 'D' else ''}" for p, x in v[w]) if v[w] else "") for w in sorted(v, key=str.encode))


def parse_vector(s: str) -> Vector:
    out: Vector = {}
    for m in re.finditer(r"(?:'((?:[^']|'')*)'|([^\s:']+))(?::([\dA-D,]+))?", s):
        w = m[1].replace("''", "'") if m[1] is not None else m[2]
        got = [(int(p.rstrip("ABCD")), p[-1] if p[-1] in "ABCD" else "D") for p in (m[3] or "").split(",") if p]
        out[w] = sorted(set(out.get(w, []) + got))
    return out


def to_vector(config: str, text: str) -> str:
    v: Vector = {}
    for i, _, w in _words(text, config):
        if w is not None:
            v.setdefault(w, []).append((i, "D"))
    return _show(v)


def vector_in(s: str) -> str:
    return _show(parse_vector(s))


def length(s: str) -> int:
    return len(parse_vector(s))


def strip(s: str) -> str:
    return _show({w: [] for w in parse_vector(s)})


def set_weight(s: str, weight: str) -> str:
    return _show({w: [(p, weight.upper()) for p, _ in ps] for w, ps in parse_vector(s).items()})


def concat(a: str, b: str) -> str:
    x, y = parse_vector(a), parse_vector(b)
    top = max((p for ps in x.values() for p, _ in ps), default=0)
    for w, ps in y.items():
        x[w] = sorted(x.get(w, []) + [(p + top, k) for p, k in ps])
    return _show(x)


# A query is a tree: (word, weights, prefix) as ("w", ...), ("!", q), ("&", a, b), ("|", a, b), ("<n>", a, b).
_TOKEN = re.compile(r"\s*(?:(<->|<\d+>|[&|!()])|'((?:[^']|'')*)'(?::([*A-Da-d]+))?|([^\s&|!()<:']+)(?::([*A-Da-d]+))?)")


def parse_query(s: str, config: str | None = None):
    tokens, at = [], 0
    while s[at:].strip():
        m = _TOKEN.match(s, at)
        if not m:
            raise ValueError(f"42601: syntax error in tsquery: {s!r}")
        at = m.end()
        if m[1]:
            tokens.append((m[1],))
        else:
            word, flags = (m[2].replace("''", "'") if m[2] is not None else m[4]), (m[3] or m[5] or "").upper()
            tokens.append(("w", word, "".join(sorted(set(flags) - {"*"})), "*" in flags))
    pos = 0

    def term(power: int):
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"42601: syntax error in tsquery: {s!r}")
        t = tokens[pos]
        pos += 1
        if t[0] == "!":
            left = term(3)
            left = ("!", left) if left else None
        elif t[0] == "(":
            left = term(0)
            pos += 1
        else:
            left = None
            if config is None:
                left = t
            else:
                for _, _, w in _words(t[1], config):
                    if w is not None:
                        new = ("w", w, t[2], t[3])
                        left = new if left is None else ("<1>", left, new)
        while pos < len(tokens) and tokens[pos][0] not in ("w", "!", "(", ")"):
            op = tokens[pos][0]
            mine = {"|": 1, "&": 2}.get(op, 3)
            if mine <= power:
                break
            pos += 1
            right = term(mine)
            op = "<1>" if op == "<->" else op
            left = right if left is None else left if right is None else (op, left, right)
        return left

    return term(0) if tokens else None


def _show_query(q, power: int = 0) -> str:
    if q is None:
        return ""
    if q[0] == "w":
        flags = ("*" if q[3] else "") + q[2]
        return _quote(q[1]) + (":" + flags if flags else "")
    if q[0] == "!":
        return "!" + _show_query(q[1], 4)
    mine = {"|": 1, "&": 2}.get(q[0], 3)
    op = "<->" if q[0] == "<1>" else q[0]
    s = f"{_show_query(q[1], mine)} {op} {_show_query(q[2], mine + (mine == 3))}"
    return f"( {s} )" if mine < power else s


def to_query(config: str, s: str) -> str:
    return _show_query(parse_query(s, config))


def query_in(s: str) -> str:
    return _show_query(parse_query(s))


def plain_query(config: str, s: str) -> str:
    q = None
    for _, _, w in _words(s, config):
        if w is not None:
            q = ("w", w, "", False) if q is None else ("&", q, ("w", w, "", False))
    return _show_query(q)


def phrase_query(config: str, s: str) -> str:
    q, last = None, 0
    for i, _, w in _words(s, config):
        if w is not None:
            q = ("w", w, "", False) if q is None else (f"<{i - last}>", q, ("w", w, "", False))
            last = i
    return _show_query(q)


def numnode(s: str) -> int:
    def count(q) -> int:
        return 0 if q is None else 1 if q[0] == "w" else 1 + sum(map(count, q[1:]))

    return count(parse_query(s))


def _hits(q, v: Vector) -> list[int] | None:
    """Positions where a word or phrase ends; None: it does not occur (an occurrence without positions is [])."""
    if q[0] == "w":
        found = [v[q[1]]] if not q[3] and q[1] in v else [ps for w, ps in v.items() if w.startswith(q[1])] if q[3] else []
        if q[2]:
            found = [kept for ps in found if (kept := [(p, k) for p, k in ps if k in q[2]])]
        return sorted({p for ps in found for p, _ in ps}) if found else None
    n = int(q[0][1:-1])
    a, b = _hits(q[1], v), _hits(q[2], v)
    if a is None or b is None:
        return None
    got = [p for p in b if p - n in a]
    return got or None


def _true(q, v: Vector) -> bool:
    if q[0] == "!":
        return not _true(q[1], v)
    if q[0] == "&":
        return _true(q[1], v) and _true(q[2], v)
    if q[0] == "|":
        return _true(q[1], v) or _true(q[2], v)
    return _hits(q, v) is not None


@functools.lru_cache(512)
def _query(s: str):
    return parse_query(s)


def match(vector: str, query: str) -> bool:
    q = _query(query)
    return q is not None and _true(q, parse_vector(vector))


def _leaves(q) -> list:
    return [] if q is None else [q] if q[0] == "w" else [x for y in q[1:] for x in _leaves(y)]


def rank(weights: list[float] | None, vector: str, query: str, norm: int) -> float | None:
    """Sum over the query's words of weights damped by occurrence, as the public manual describes ts_rank."""
    if vector is None or query is None:
        return None
    v, q = parse_vector(vector), _query(query)
    by = dict(zip("DCBA", weights or [0.1, 0.2, 0.4, 1.0]))
    total, words = 0.0, {x[1:] for x in _leaves(q)}
    for x in sorted(words):
        ps = [p for w, ps in v.items() if (w.startswith(x[0]) if x[2] else w == x[0]) for p in (ps or [(0, "D")])]
        if ps:
            ws = [by[k] for _, k in ps]
            top = max(ws)
            s = sum(w / (i * i) for i, w in enumerate(ws, 1))
            total += (s + top - top / (ws.index(top) + 1) ** 2) / 1.64493406685
    total /= max(1, len(words))
    n = sum(max(1, len(p)) for p in v.values())
    if norm & 1 and n:
        import math

        total /= 1 + math.log(n)
    if norm & 2 and n:
        total /= n
    if norm & 8 and v:
        total /= len(v)
    if norm & 32:
        total /= total + 1
    return total


def headline(text: str, query: str, options: str) -> str:
    opts = dict((k.strip().lower(), v.strip().strip('"')) for k, v in re.findall(r'(\w+)\s*=\s*("[^"]*"|[^,]*)', options))
    start, stop, most = opts.get("startsel", "<b>"), opts.get("stopsel", "</b>"), int(opts.get("maxwords", 35))
    words = {x[1]: x[3] for x in _leaves(_query(query))}
    found = [(m, w is not None and (w in words or any(p and w.startswith(k) for k, p in words.items()))) for _, m, w in _words(text, "english")]
    first = next((i for i, (_, hit) in enumerate(found) if hit), 0)
    part = found[max(0, min(first, len(found) - most)) :][:most]
    if not part:
        return text
    if len(found) <= most:
        part, low, high = found, 0, len(text)
    else:
        low, high = part[0][0].start(), part[-1][0].end()
    out, at = [], low
    for m, hit in part:
        out += [text[at : m.start()], f"{start}{m[0]}{stop}" if hit else m[0]]
        at = m.end()
    return "".join(out) + text[at:high]
