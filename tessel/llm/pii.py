"""Personal data by weak supervision.

Candidates: every match of the base patterns (e-mail and IP addresses, card and telephone numbers), and matches of wider
patterns (obfuscated addresses, numbers written without a country code, IPv6, shorter cards). Five labelers vote for,
against or abstain on each candidate: the strict pattern, the kind's own validity rule, a gazetteer (domains, issuer
prefixes, country codes), cue words before it, and the characters around it. Expectation-maximisation (Dawid and Skene)
over the counts of all vote patterns in the corpus estimates how reliable each labeler is for each kind, and its
posteriors are the soft labels of the final classifier, a logistic regression on votes and shape. Base matches always
stay; other candidates stay where the classifier says so.

What leaves the workers for fitting is a count for each combination of votes and shape: bounded, whatever the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import arrow_map, unused

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "validity", "gazetteer", "cue", "edges")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_NUMBER = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[{](?:at|AT)[)\]}] ?[A-Za-z0-9-]{1,63}(?:(?: ?[(\[{](?:dot|DOT)[)\]}] ?|\.)[A-Za-z0-9-]{1,63}){1,8}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,8}")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")

#: Common top-level domains; leading digits of card issuers; country calling codes.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro io ai app dev co me tv us uk de fr es it nl be ch at pl cz se no dk fi ie pt gr ru ua ro hu tr il in cn jp kr au nz ca mx br ar cl za eu example test".split())
ISSUERS = tuple("34 36 37 38 30 4 51 52 53 54 55 2221 2720 35 6011 64 65 62 50 56 57 58 60".split())
CALLING_CODES = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Words that speak for a kind, or against personal data, when they stand shortly before a candidate.
CUES = {
    "email": "email e-mail mail contact write correo courriel kontakt reach",
    "ip": "ip address host server client login from dirección adresse",
    "card": "card visa mastercard amex credit debit payment pay tarjeta carte karte",
    "phone": "phone tel telephone call mobile fax cell contact teléfono téléphone telefon",
}
AGAINST = "version isbn issn doi order invoice sha md5 token key hash build serial sku uuid v."
_CUES = {k: re.compile("|".join(rf"\b{re.escape(w)}\b" for w in v.split()), re.I) for k, v in CUES.items()}
_AGAINST = re.compile("|".join(rf"\b{re.escape(w)}" for w in AGAINST.split()), re.I)

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(t: str) -> list[Span]:
    """The base matches, by kind, then start. Linear in the text: a run of digits or name characters is entered once."""
    out: list[Span] = []
    done, i = 0, t.find("@")
    while i >= 0:
        j = i
        while j > done and t[j - 1] in _LOCAL:
            j -= 1
        m = _DOMAIN.match(t, i + 1) if j < i else None
        if m:
            out.append((0, j, m.end()))
            done = m.end()
        i = t.find("@", max(done, i + 1))
    out += [(1, *m.span()) for m in _IP.finditer(t) if all(map(_octet, m.group().split(".")))]
    for m in _NUMBER.finditer(t):
        if m.end() - m.start() >= 16:
            digits = _DIGITS.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in t:
        out += [(3, *m.span()) for m in _PHONE.finditer(t) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


def wider_spans(t: str, base: list[Span]) -> list[Span]:
    """Other candidates, none of which overlaps a base match or an earlier candidate."""
    found: list[Span] = []
    if "at)" in t or "AT)" in t or "at]" in t or "AT]" in t or "at}" in t or " dot " in t:
        found += [(0, *m.span()) for m in _AT.finditer(t)]
    if t.count(":") >= 7:
        found += [(1, *m.span()) for m in _IPV6.finditer(t)]
    for m in _NUMBER.finditer(t):
        if 13 <= m.end() - m.start() <= 24 and 13 <= len(d := _DIGITS.sub("", m.group())) <= 15 and luhn(d):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(t)]
    starts, ends = [], []  # of the base matches, overlapping ones as one
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out, last = [], 0
    for k, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        i = bisect.bisect_right(ends, s)  # the first base match that ends after s
        if s >= last and (i == len(starts) or starts[i] >= e):
            out.append((k, s, e))
            last = e
    return sorted(out)


def votes(t: str, span: Span, base: bool) -> tuple[int, ...]:
    """-1, 0 or 1 of each labeler."""
    k, s, e = span
    body = t[s:e]
    digits = _DIGITS.sub("", body)
    if k == 0:
        last = re.split(r"[.\s)\]}]+", body.rstrip(".-"))[-1].lower()
        validity = 1 if ".." not in body and not body.startswith((".", "-")) else -1
        gazetteer = 1 if last in TOP_DOMAINS else -1 if not last.isalpha() else 0
    elif k == 1:
        parts = body.split(".")
        validity = 1 if ":" in body or all(p == "0" or not p.startswith("0") for p in parts) else -1
        gazetteer = 1 if ":" in body or 1 <= int(parts[0][-3:]) <= 223 else -1
    elif k == 2:
        validity = 1 if len(set(digits)) > 2 and len(re.findall(r"[ -]", body)) in (0, 2, 3, 4) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    else:
        validity = 1 if 10 <= len(digits) <= 13 and body.count("(") == body.count(")") else 0
        gazetteer = (1 if digits.startswith(CALLING_CODES) else -1) if body.startswith("+") else 0
    before = t[max(0, s - 40) : s]
    cue = 1 if _CUES[KINDS[k]].search(before) else -1 if _AGAINST.search(before[-16:]) else 0
    a, b = t[s - 1 : s], t[e : e + 1]
    edges = -1 if a.isalnum() or b.isalnum() or a in ("=", "/", "#") and a else 1
    return (1 if base else 0, validity, gazetteer, cue, edges)


def shape(t: str, span: Span) -> tuple[int, int]:
    body = t[span[1] : span[2]]
    return min(7, len(body) // 5), min(4, 5 * sum(c.isdigit() for c in body) // max(1, len(body)))


def candidates(t: str) -> Iterator[tuple[Span, bool, tuple[int, ...]]]:
    """(span, base?, features): the kind, the votes, the shape."""
    base = base_spans(t)
    for span in base:
        yield span, True, (span[0], *votes(t, span, True), *shape(t, span))
    for span in wider_spans(t, base):
        yield span, False, (span[0], *votes(t, span, False), *shape(t, span))


@dataclass
class Model:
    weights: np.ndarray
    accuracy: dict[tuple[str, str], tuple[float, float]]  # (kind, labeler): P(vote for | personal), P(vote for | not)
    threshold: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_encoded(features) @ self.weights, -30, 30)))


def _encoded(f: np.ndarray) -> np.ndarray:
    """One column for each value of each vote and each kind, and for length and share of digits; then 1."""
    x = [(f[:, 0] == k) for k in range(len(KINDS))]
    x += [f[:, 1 + j] == v for j in range(len(LABELERS)) for v in (-1, 1)]
    return np.stack([*x, f[:, 6] / 7, f[:, 7] / 4, np.ones(len(f))], 1).astype(float)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of vote patterns, and P(vote | class) as (labeler, class, vote + 1). Starts from the mean vote."""
    q = 1 / (1 + np.exp(-2.0 * patterns.sum(1) + 1))
    table = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        w = np.stack([(1 - q) * counts, q * counts], 1)
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] = w[patterns[:, j] == v].sum(0) + 0.5 + (v == 0)
        table /= table.sum(2, keepdims=True)
        log = np.log((w.sum(0) + 1) / (w.sum() + 2))[None] + sum(np.log(table[j][:, patterns[:, j] + 1]).T for j in range(patterns.shape[1]))
        q = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return q, table


def fit_counts(rows: list[tuple[tuple[int, ...], int]], threshold: float = 0.8) -> Model:
    """From counts of features. Without any candidate the model rejects all that is not base."""
    accuracy: dict[tuple[str, str], tuple[float, float]] = {}
    if not rows:
        return Model(np.append(np.zeros(len(KINDS) + 2 * len(LABELERS) + 2), -3.0), accuracy, threshold)
    f, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    soft = np.zeros(len(f))
    for k, kind in enumerate(KINDS):
        at = np.flatnonzero(f[:, 0] == k)
        if len(at):
            soft[at], table = em(f[at, 1:6], n[at])
            accuracy |= {(kind, name): (float(table[j, 1, 2]), float(table[j, 0, 2])) for j, name in enumerate(LABELERS)}
    x, w = _encoded(f), np.zeros(len(KINDS) + 2 * len(LABELERS) + 3)
    weight = np.sqrt(n) / np.sqrt(n).sum()
    for _ in range(50):  # Newton steps on the ridge-penalised likelihood of the soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - soft)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return Model(w, accuracy, threshold)


def fit(docs: DataFrame, text: str = "text", threshold: float = 0.8) -> Model:
    """Reliabilities and classifier from the candidates of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(f for _, _, f in candidates(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["f", "n"])

    rows = arrow_map(docs.select(text), run, "f array<int>, n long").groupBy("f").agg(F.sum("n")).collect()
    return fit_counts(sorted((tuple(r[0]), r[1]) for r in rows), threshold)


def spans_of(t: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind, then start."""
    found = list(candidates(t)) if t else []
    base = [s for s, is_base, _ in found if is_base]
    rest = [(s, f) for s, is_base, f in found if not is_base]
    if rest:
        p = model.probability(np.array([f for _, f in rest]))
        return base, sorted(base + [s for (s, _), x in zip(rest, p) if x >= model.threshold])
    return base, base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(t: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [t[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + t[at:]


def found(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each whole text.

    Null and empty texts hold no spans. Repeated rows are treated alike; other columns do not matter; an empty table
    gives an empty result. Places are code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [spans_of(t, model) for t in batch.column(0).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], *counts, digest, pa.array([joined(every) for _, every in got], pa.string())], [*keep, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    chosen = docs.select(F.col(text).alias(unused("_body", keep)), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return arrow_map(chosen, run, f"{kept}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def without(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the personal data in each text replaced; all other columns as they are.

    Null texts stay null, empty ones empty; repeated rows are treated alike; an empty table gives an empty result.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t and redacted(t, spans_of(t, model)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return arrow_map(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
