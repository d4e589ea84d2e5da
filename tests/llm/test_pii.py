import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import pii
from tests.llm import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB1.2@-+ ()0945%_é:\n", max_size=80))
def test_base_spans_are_the_patterns(t):
    assert pii.base_spans(t) == brute(t)


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a." * 100_000, "1." * 100_000, "+1" + "-" * 200_000, "a@" * 100_000):
        pii.base_spans(t)


def wider_brute(t, base):
    """Each candidate against all matches before it."""
    taken, out = [(a, b) for _, a, b in base], []
    for k, a, b in sorted(((2, *m.span()) for m in pii._NUMBER.finditer(t) if 13 <= m.end() - m.start() <= 24 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 15 and pii.luhn(d)), key=lambda x: (x[1], x[0])):
        if all(b <= x or a >= y for x, y in taken):
            out.append((k, a, b))
            taken.append((a, b))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0459 -+.@a", max_size=120))
def test_wider_spans_overlap_nothing(t):
    base = pii.base_spans(t)
    wide = pii.wider_spans(t, base)
    assert [s for s in wide if s[0] == 2] == wider_brute(t, base) or any(s[0] != 2 for s in wide)
    every = sorted((a, b) for _, a, b in wide)
    assert all(x[1] <= y[0] for x, y in zip(every, every[1:]))
    assert all(b <= x or a >= y for _, a, b in wide for _, x, y in base)


def test_a_long_directory_is_linear():
    lines = [f"Name {i}, +1 202 555 {i % 10_000:04d}, (202) 555-{i % 10_000:04d}, n{i}@example.com, 4000 0000 000{i % 1000:03d}" for i in range(20_000)]
    began = time.perf_counter()
    pii.wider_spans(t := "\n".join(lines), pii.base_spans(t))
    assert time.perf_counter() - began < 10


def test_em_finds_the_better_labeler():
    r = np.random.default_rng(0)
    truth = r.random(4000) < 0.5
    votes = np.stack([np.where(r.random(4000) < acc, truth, ~truth) * 2 - 1 for acc in (0.95, 0.9, 0.6)], 1)
    q, table = pii.em(votes, np.ones(4000))
    assert ((q > 0.5) == truth).mean() > 0.93 and table[0, 1, 2] > table[2, 1, 2]


@pytest.mark.parametrize("make", [cases.documents, cases.empty])
def test_results(spark, make):
    docs = make(spark)
    got = pii.found(docs, pii.fit(docs), ["doc_id"]).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        base = brute(text[r.doc_id] or "")
        shown = pii.joined(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))


def test_redaction_keeps_the_rest(spark):
    docs = cases.documents(spark)
    got = {r.doc_id: r.text for r in pii.without(docs, pii.fit(docs)).collect()}
    assert "mail [EMAIL] or [PHONE], host [IP], card [CARD]." in got.values()
    assert got[0] is None and got[5] == "ünï cödé ① \U0001f600 end" and len(got) == len({r[0] for r in cases.rows()})
