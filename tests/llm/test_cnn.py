import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import cnn
from tests.llm import cases


def test_chunks_cover_the_whole_text():
    s = cnn.Settings()
    for n in (0, 1, 511, 517, 518, 1000, 5000):
        data = bytes(random.Random(n).randbytes(n))
        got = cnn.chunks(data, s)
        assert got.shape[1] == s.chunk + s.width - 1
        seen = bytes(got[0][got[0] < 256].astype(np.uint8)) if n < 518 else None
        if seen is not None:
            assert seen == data
        else:
            assert bytes(got[-1].astype(np.uint8)) == data[-got.shape[1] :] and len(got) >= (n - got.shape[1]) / s.step


def test_gradients_are_those_of_the_loss():
    s = cnn.Settings(filters=3, heads=2, embed=2, width=3, chunk=16, step=12)
    p = {k: v.astype(np.float64) for k, v in cnn.start(s).items()}
    texts, y = [b"hello there general kenobi of old", b"!!##", b"abc abc abc abc abc abc"], np.array([1.0, 0.0, 1.0])
    cut = [cnn.chunks(t, s) for t in texts]
    first = np.cumsum([0] + [len(c) for c in cut[:-1]])
    x, sizes = np.concatenate(cut), np.array([len(t) for t in texts])

    def loss():
        z, _ = cnn.combined(p, cnn.pooled(p, x, s)[0], first, sizes)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    d = cnn.gradients(p, x, first, sizes, y, s)
    for k in ("E", "W", "b", "A", "a", "D", "d"):
        at = np.unravel_index(np.abs(d[k]).argmax(), d[k].shape)
        keep = p[k][at]
        p[k][at] = keep + 1e-3
        up = loss()
        p[k][at] = keep - 1e-3
        down = loss()
        p[k][at] = keep
        assert (up - down) / 2e-3 == pytest.approx(float(d[k][at]), rel=0.08, abs=2e-4)


def test_pooled_is_the_slow_convolution():
    s = cnn.Settings(filters=4, embed=3, width=3, chunk=20, step=16)
    p = cnn.start(s)
    x = cnn.chunks(b"some text of a few words, longer than a chunk of it", s)
    got, where = cnn.pooled(p, x, s, True)
    for i, chunk in enumerate(x):
        for f in range(s.filters):
            at = [sum(float(p["E"][chunk[j + w]] @ p["W"][w][:, f]) for w in range(s.width)) + float(p["b"][f]) for j in range(s.chunk)]
            assert got[i, f] == pytest.approx(max(at), abs=1e-5) and at[where[i, f]] == pytest.approx(max(at), abs=1e-5)


def test_learns_and_holds_out():
    r = random.Random(0)
    good = [" ".join(cases.words(r, r.randint(20, 300))).encode() for _ in range(150)]
    bad = [" ".join(w + "!!" for w in cases.words(r, r.randint(20, 300))).upper().encode() for _ in range(150)]
    p = cnn.trained(good[:120] + bad[:120], [1] * 120 + [0] * 120)
    s = cnn.Settings()
    score = lambda t: cnn.combined(p, cnn.pooled(p, cnn.chunks(t, s), s)[0], np.array([0]), np.array([len(t)]))[0][0]
    assert np.mean([score(t) > 0 for t in good[120:]] + [score(t) < 0 for t in bad[120:]]) > 0.95


def test_operator(spark):
    docs, labels = cases.documents(spark), cases.labels(spark)
    p = cnn.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = cnn.scored(docs, p, ["doc_id"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1  # null counts as empty
    assert cnn.scored(docs, p, docs.columns, name="_score").columns == [*docs.columns, "_score"]


def test_no_labels_and_empty_table(spark):
    none = cases.labels(spark).limit(0)
    p = cnn.fit(cases.documents(spark), none, F.lit(True))
    assert {round(r.score, 6) for r in cnn.scored(cases.documents(spark), p, ["doc_id"]).collect()} == {0.5}
    assert cnn.scored(cases.empty(spark), p, ["doc_id"]).count() == 0
