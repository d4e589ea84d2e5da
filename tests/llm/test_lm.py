import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessel.llm import lm
from tessel.llm.shared import remainder
from tests.llm import cases


def scored(docs, s=lm.Settings()):
    docs = docs.select("*", (remainder("doc_id", 10) == 0).alias("held_out"))
    return lm.score(docs, lm.fit(docs.filter("not held_out"), s=s), ["doc_id", "held_out"])


@pytest.mark.parametrize("head", [200_000, 5])
def test_base_score_is_exact_and_rows_stay(spark, head):
    """With a head of 5 words nearly all counts come by the join."""
    got = scored(cases.documents(spark), lm.Settings(head=head)).collect()
    data = cases.rows()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    tokens = {d: (t or "").encode().lower().split() + [b"\n"] for d, t, *_ in data}
    count = Counter(w for d, t, *_ in data if not held(d) for w in tokens[d])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(data)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0 and math.isfinite(r.score)


def slow_log10(model, words):
    """log10 of each token's probability by a loop over tokens, in plain Python."""
    v, p, s = model.vocabulary, {k: x.astype(float) for k, x in model.params.items()}, model.settings
    counts = {bytes(r[0]): r[1] for r in model.counts.collect()}
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ids, out = [0] * s.context + [v.of(w) for w in words], []
    for i, w in enumerate(words, s.context):
        q = sum(p["C"][j] * p["R"][ids[i - 1 - j]] for j in range(s.context))
        k = int(v.cls[ids[i]])
        lp = math.log10(softmax(p["Q"] @ q + p["b"])[k])
        if k >= v.alone:
            own = slice(v.first[k], v.last[k])
            lp += math.log10(softmax(p["M"][own] @ q + p["m"][own])[ids[i] - v.first[k]])
        if w not in v.index:
            beyond = [c for x, c in counts.items() if x not in v.index and zlib.crc32(x[-2:]) % v.shared == k - v.alone]
            lp += math.log10((counts.get(w, 0) + 0.1) / (sum(beyond) + 0.1 * (len(beyond) + 1)))
        out.append(lp)
    return out


def test_score_is_the_slow_one(spark):
    """Words with vectors, words beyond the vocabulary, and words never seen."""
    s = lm.Settings(vocabulary=40, single=6, shared=5, head=60, batch=64)
    docs = cases.documents(spark).select("*", (remainder("doc_id", 10) == 0).alias("held_out"))
    model = lm.fit(docs.filter("not held_out"), s=s)
    text = {r[0]: r[1] for r in cases.rows()}
    for r in lm.score(docs, model, ["doc_id"]).collect():
        words = (text[r.doc_id] or "").encode().lower().split() + [lm.END]
        assert r.score == pytest.approx(sum(slow_log10(model, words)), rel=1e-4, abs=1e-3)


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary and, in each class, all that is beyond it."""
    s = lm.Settings(vocabulary=30, single=5, shared=4, batch=64)
    model = lm.fit(cases.documents(spark).filter("text is not null"), s=s)
    v, a, total = model.vocabulary, np.array([0, 3, 1, 9, 0], np.int32), 0.0
    for i in range(v.n):
        a[-1] = i
        total += 10 ** lm.token_log10(model.params, v, a, np.array([len(a) - 1]))[0]
    assert total == pytest.approx(1, abs=1e-5)
    counts = {bytes(r[0]): r[1] for r in model.counts.collect()}
    for k, other in enumerate(v.others):
        beyond = [c for w, c in counts.items() if w not in v.index and zlib.crc32(w[-2:]) % v.shared == k]
        shares = [10 ** (math.log10(c + 0.1) - model.inside[other]) for c in [*beyond, 0]]
        assert sum(shares) == pytest.approx(1)


def test_training_beats_the_prior():
    """A corpus in which the next word follows from the last: as a class by itself, and as one of a class."""
    s = lm.Settings(rate=0.2, single=3, shared=2, batch=500)
    v = lm.Vocabulary([b"w%d" % i for i in range(8)], s.single, s.shared)
    a = np.tile([v.of(b"w%d" % i) for i in range(8)], 500).astype(np.int32)
    prior = lm.Prior.of(v, np.bincount(a, minlength=v.n).astype(float))
    p = lm.start(v, prior, s)
    g2 = {k: np.full_like(x, 1e-3) for k, x in p.items()}
    rng = np.random.default_rng(0)
    for _ in range(60):
        for i in range(3, 4000, s.batch):
            lm.nce_step(p, g2, a, np.arange(i, min(i + s.batch, 4000)), v, prior, rng, s)
    assert lm.token_log10(p, v, a, np.arange(3, 500)).mean() > math.log10(1 / 8) + 0.5


def test_empty_table(spark):
    assert scored(cases.empty(spark)).count() == 0
