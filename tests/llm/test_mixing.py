import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import mixing
from tests.llm import cases


def solution(l, p, share, ridge, rounds=200_000):
    """Plain projected gradient, in the metric of the tokens, to convergence."""
    total, w = l.sum(), np.ones(len(l))
    step = 1 / (np.linalg.norm((p * l[:, None]).T @ p / total, 2) + ridge)
    for _ in range(rounds):
        g = p.T @ (w * l) / total - share
        new = np.maximum(0, w - step * (p @ g + ridge * (w - 1)))
        if abs(new - w).max() < 1e-12:
            break
        w = new
    return w


@pytest.mark.parametrize("share", [(0.3, 0.3, 0.4), (0.9, 0.05, 0.05)])
def test_rates_solve_the_least_squares(spark, share):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.5, 0.3, 0.2], 200)
    l = r.integers(1, 500, 200).astype(float)  # noqa: E741
    rows = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(l, p)], "tokens long, p array<double>")
    history, residuals = mixing.solved(rows, list(share))
    w = np.array([x[0] for x in rows.select(mixing.rate(F.col("p"), history)).collect()])
    best = solution(l, p, np.array(share), mixing.Settings().ridge)
    loss = lambda v: ((p.T @ (v * l) / l.sum() - share) ** 2).sum()
    assert (w >= 0).all() and loss(w) <= loss(best) + 1e-6 and len(residuals) <= 25


def test_operator(spark):
    docs = cases.documents(spark)
    labels = cases.labels(spark).select("doc_id", F.when(F.col("quality") == 1, "a").when(F.col("quality") == 0, "b").alias("domain"))
    targets = {"a": 0.5, "b": 0.5}
    got = mixing.rates(docs, labels, targets).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.p_a + r.p_b == pytest.approx(1) and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1)
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.rate * r.p_a for r in got) / total == pytest.approx(0.5, abs=0.01)
    words = {d: len((t or "").split()) for d, t, *_ in cases.rows() if d is not None and "\x85" not in (t or "")}
    assert all(r.tokens == words[r.doc_id] for r in got if r.doc_id is not None and r.doc_id > 7)


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.rates(cases.documents(spark), none, {"a": 1.0, "b": 1.0}).collect()
    assert all(r.p_a == pytest.approx(0.5) and r.rate == pytest.approx(1) for r in got)
    assert mixing.rates(cases.empty(spark), none, {"a": 1.0}).count() == 0


@pytest.mark.parametrize("toxic", [0, 3, 60])
def test_the_whole_domain_loses_no_document(spark, toxic):
    """Fewer toxic tokens than the target of 0.04, none at all, and more than it."""
    r = np.random.default_rng(2)
    q = np.concatenate([r.beta(1, 400, 400), r.beta(40, 2, toxic), r.uniform(0.3, 0.5, 20 if toxic == 60 else 0)])
    l = r.integers(50, 150, len(q))  # noqa: E741
    rows = spark.createDataFrame([(int(a), [float(1 - b), float(b)]) for a, b in zip(l, q)], "tokens long, p array<double>")
    history, residuals = mixing.solved(rows, [0.96, 0.04], whole=0)
    w = np.array([x[0] for x in rows.select(mixing.rate(F.col("p"), history, 0)).collect()])
    assert (w[q <= 0.5] >= 1).all() and (w >= 0).all()
    if (q * l).sum() <= 0.04 * l.sum():
        assert w == pytest.approx(1)
    else:
        assert (w * l * q).sum() / l.sum() == pytest.approx(0.04, abs=0.002) and (w * l * (1 - q)).sum() / l.sum() == pytest.approx(0.96, abs=0.002)
