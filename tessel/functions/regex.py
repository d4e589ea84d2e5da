"""Patterns of the dialect (POSIX ARE, SIMILAR TO) as Java and Python patterns."""

from __future__ import annotations

import re

_CLASSES = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\s", "punct": r"!-/:-@\[-`{-~", "xdigit": "0-9A-Fa-f", "blank": r" \t", "word": r"\w", "cntrl": r"\x00-\x1f\x7f", "print": r"\x20-\x7e", "graph": r"\x21-\x7e"}
_ESCAPES = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "A": "^", "Z": "$"}


def posix(pattern: str, flags: str = "") -> str:
    """The same pattern for Java and Python engines; flags of the dialect become an inline group."""
    inline = "".join(f for f in ("i" if "i" in flags or "c" not in flags and pattern.startswith("(?i)") else "", "m" if "n" in flags or "m" in flags or "w" in flags else "") if f)
    if "n" not in flags and "p" not in flags and "m" not in flags:
        inline += "s"
    if "x" in flags:
        inline += "x"
    if "q" in flags:
        return f"(?{inline})" * bool(inline) + re.escape(pattern)
    if pattern.startswith("(?i)"):
        pattern = pattern[4:]
    body = re.sub(r"\[:(\w+):\]", lambda m: _CLASSES.get(m[1], ""), pattern)
    body = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), body)
    return (f"(?{inline})" if inline else "") + body


def similar(pattern: str, escape: str | None = "\\") -> str:
    """SIMILAR TO as an anchored pattern."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif in_class:
            out.append(c if c != "\\" else "\\\\")
            in_class = c != "]"
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        elif c == "(":
            out.append("(?:")
        else:
            out.append(c)
        i += 1
    return f"(?s)^(?:{''.join(out)})$"
