"""Intervals as (months, days, microseconds): reading and writing their text, and SQL over the struct."""

from __future__ import annotations

import re

from tessel.errors import SqlError

_UNITS = {
    "microsecond": (0, 0, 1), "us": (0, 0, 1), "millisecond": (0, 0, 1000), "ms": (0, 0, 1000), "second": (0, 0, 10**6), "sec": (0, 0, 10**6), "s": (0, 0, 10**6),
    "minute": (0, 0, 60 * 10**6), "min": (0, 0, 60 * 10**6), "m": (0, 0, 60 * 10**6), "hour": (0, 0, 3600 * 10**6), "hr": (0, 0, 3600 * 10**6), "h": (0, 0, 3600 * 10**6),
    "day": (0, 1, 0), "d": (0, 1, 0), "week": (0, 7, 0), "w": (0, 7, 0), "month": (1, 0, 0), "mon": (1, 0, 0), "year": (12, 0, 0), "yr": (12, 0, 0), "y": (12, 0, 0),
    "decade": (120, 0, 0), "century": (1200, 0, 0), "centurie": (1200, 0, 0), "millennium": (12000, 0, 0), "millennia": (12000, 0, 0),
}
_PART = re.compile(r"([+-]?\d*\.?\d+)\s*([A-Za-z]+)|([+-])?(\d+):(\d+)(?::(\d+(?:\.\d+)?))?|([+-]?\d+(?:\.\d+)?)\s*$|(ago)\b", re.I)
_ISO = re.compile(r"P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?$")
Interval = tuple[int, int, int]


def _add(total: list[float], n: float, unit: Interval) -> None:
    """n units; a fraction of a month goes on as days of a 30-day month, of a day as time."""
    months = n * unit[0]
    whole = int(months)
    days = n * unit[1] + (months - whole) * 30
    whole_days = int(days)
    total[0] += whole
    total[1] += whole_days
    total[2] += round(n * unit[2] + (days - whole_days) * 86400 * 10**6)


def parsed(text: str, unit: str | None = None) -> Interval:
    total: list[float] = [0, 0, 0]
    s = text.strip()
    if m := _ISO.match(s):
        for x, u in zip(m.groups(), ("year", "month", "week", "day", "hour", "minute", "second")):
            if x:
                _add(total, float(x), _UNITS[u])
        return int(total[0]), int(total[1]), int(total[2])
    at = 0
    for m in _PART.finditer(s):
        if s[at : m.start()].strip(" ,@"):
            raise SqlError("22007", f'invalid input syntax for type interval: "{text}"')
        at = m.end()
        if m[2]:
            u = m[2].lower()
            u = u if u in _UNITS else u[:-1] if u.endswith("s") and u[:-1] in _UNITS else {"mins": "min", "secs": "sec", "hrs": "hour", "mons": "month", "yrs": "year"}.get(u, u)
            if u not in _UNITS:
                raise SqlError("22007", f'invalid input syntax for type interval: "{text}"')
            _add(total, float(m[1]), _UNITS[u])
        elif m[4]:
            sign = -1 if m[3] == "-" else 1
            total[2] += sign * (int(m[4]) * 3600 * 10**6 + int(m[5]) * 60 * 10**6 + round(float(m[6] or 0) * 10**6))
        elif m[7]:
            _add(total, float(m[7]), _UNITS[(unit or "second").split()[-1]])
        else:
            total = [-x for x in total]
    if s[at:].strip() or not s:
        raise SqlError("22007", f'invalid input syntax for type interval: "{text}"')
    return int(total[0]), int(total[1]), int(total[2])


def text_of(months: int, days: int, micros: int) -> str:
    """The dialect's text: 1 year 2 mons 3 days 04:05:06."""
    out = []
    sign = lambda x, before: "+" if before and x > 0 else ""
    years, mons = int(months / 12), months - 12 * int(months / 12)
    negative = False
    for n, unit in ((years, "year"), (mons, "mon"), (days, "day")):
        if n:
            out.append(f"{sign(n, negative)}{n} {unit}{'' if n == 1 else 's'}")
            negative = n < 0
    if micros or not out:
        x = abs(micros)
        frac = f".{x % 10**6:06d}".rstrip("0") if x % 10**6 else ""
        s = x // 10**6
        out.append(f"{'-' if micros < 0 else sign(1, negative)}{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}{frac}")
    return " ".join(out)


def literal(i: Interval) -> str:
    return f"named_struct('months', {i[0]}, 'days', {i[1]}, 'micros', {i[2]}L)"


def key(x: str) -> str:
    """SQL of the comparison key: microseconds with months of 30 days."""
    return f"(({x}).months * 30L + ({x}).days) * 86400000000L + ({x}).micros"


def native(x: str, sign: str = "") -> str:
    """SQL of Spark's calendar interval, to be added to a date or timestamp."""
    return f"make_interval(0, {sign}({x}).months, 0, {sign}({x}).days, 0, 0, CAST({sign}({x}).micros / 1000000D AS DECIMAL(18,6)))"


def built(months: str = "0", days: str = "0", micros: str = "0L") -> str:
    return f"named_struct('months', CAST({months} AS INT), 'days', CAST({days} AS INT), 'micros', CAST({micros} AS BIGINT))"
