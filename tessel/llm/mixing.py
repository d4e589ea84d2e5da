"""Mixing documents to target weights, with soft membership in domains, in DataFrame functions only.

A labelled table names the domain of some documents. A classifier learns from it: the class means and the pooled variances
of a of a few features of the text give posteriors for all documents (a linear discriminant with diagonal covariance). Some
features are learned too: for each domain, how many words of its lexicon a text has. A lexicon holds the words that
documents of the domain have far more often than others, the most telling first.

The rates w of documents are the nonnegative solution of least squares between the expected token total of every domain,
sum_i w_i l_i p_ik, and its target T_k, with a slight ridge towards rates of 1. Projected gradient: with the residuals
g = (A w - T) / S, a step is w_i <- max(0, w_i - p_i . d), where d is the gradient in the metric of the domains' Gram
matrix, or in the plain one when that has not made progress. An iteration is one aggregation of K + K^2 sums over the
documents, and a document's rate is a short expression of its posteriors: nothing else reaches the driver, and nothing is
stored by document between iterations.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.rules import let, words
from tessel.llm.shared import written


@dataclass
class Settings:
    """sample: labelled documents that the classifier learns from, at most; lexicon: words of a domain at most; tolerance: of a
    domain's total, as a share of all tokens; missed: such a share that is warned of; ridge: pull of the rates to 1, which bounds them where a domain that has
    hardly any tokens has a target."""

    sample: int = 8000
    lexicon: int = 300
    iterations: int = 25
    tolerance: float = 1e-7
    ridge: float = 1e-4
    missed: float = 1e-3


def _numbers(values: list[float]) -> Column:
    """A constant array; folded once, however long."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def _letters(text: Column) -> Column:
    """Runs of letters, in lower case; ASCII characters of other kinds separate them."""
    return F.split(F.lower(text), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]
    means: list[list[float]]  # by domain, then feature
    variances: list[float]
    lexicons: list[list[str]]  # by domain

    def _features(self, w: Column, text: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        length = F.greatest(F.length(text), F.lit(1)).cast("double")

        def learned(letters: Column) -> Column:
            hits = [F.log1p(F.size(F.array_intersect(letters, F.split(F.lit(" ".join(words)), " "))).cast("double")) if words else F.lit(0.0) for words in self.lexicons]
            return F.array(F.size(F.array_distinct(letters)) / n, *hits)

        shape = F.array(
            F.log1p(F.size(w).cast("double")),
            F.least(length / n, F.lit(40.0)),
            F.least(F.length(F.regexp_replace(text, r"[^#*$%&|<>!]+", "")) / n, F.lit(3.0)),
            F.length(F.regexp_replace(text, r"[^A-Z]+", "")) / length,
        )
        return F.concat(shape, let(_letters(text), learned))

    def described(self, text: Column) -> Column:
        """struct(tokens, f): the words of the text and its features. Null text is empty."""
        t = F.coalesce(text, F.lit(""))
        return let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), self._features(w, t).alias("f")))

    def posteriors(self, f: Column) -> Column:
        """An array of the domains' posteriors, which sum to 1."""
        logits = [F.lit(_log(p)) - sum((F.get(f, j) - F.lit(m)) * (F.get(f, j) - F.lit(m)) * F.lit(0.5 / v) for j, (m, v) in enumerate(zip(mean, self.variances))) for p, mean in zip(self.prior, self.means)]
        top = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return let(let(F.array(*logits), top), lambda e: F.transform(e, lambda x: x / total(e)))


def _log(p: float) -> float:
    import math

    return math.log(max(p, 1e-12))


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> Classifier:
    """labelled: (id, domain). Rows with another domain or a null are ignored; of several domains of an id the first stays.

    Learns from s.sample labelled documents at most, chosen by the hash of the id. A domain without any gets prior 0.
    """
    names = labelled.filter(F.col("domain").isin(domains) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("k")).agg(F.min("domain").alias("domain"))
    chosen = names.orderBy(F.xxhash64("k"), "k").limit(s.sample)
    some = written(docs.select(F.col(doc_id).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "k").select("domain", "t"), "mix-sample")
    n = {r[0]: r[1] for r in some.groupBy("domain").count().collect()}
    total = sum(n.values())
    seen = some.select("domain", F.explode(F.array_distinct(_letters(F.col("t")))).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("every"), *[F.count(F.when(F.col("domain") == d, 1)).alias(f"d{j}") for j, d in enumerate(domains)])
    seen = written(seen.filter("every >= 4"), "mix-words")
    lexicons = []
    for j, d in enumerate(domains):
        own, rest = F.col(f"d{j}"), F.col("every") - F.col(f"d{j}")
        odds = F.log((own + 0.5) / F.lit(n.get(d, 0) + 1.0)) - F.log((rest + 0.5) / F.lit(total - n.get(d, 0) + 1.0))
        best = seen.filter((own >= 4) & (odds >= 1.5)).orderBy((own * odds).desc(), "word").limit(s.lexicon)
        lexicons.append([r[0] for r in best.select("word").collect()])
    bare = Classifier(domains, [], [], [], lexicons)
    parts = some.select("domain", bare.described(F.col("t")).alias("x")).select("domain", *[F.get("x.f", F.lit(j)).alias(f"f{j}") for j in range(5 + len(domains))])
    size = 5 + len(domains)
    got = {r["domain"]: r for r in parts.groupBy("domain").agg(*[F.avg(f"f{j}").alias(f"m{j}") for j in range(size)], *[F.var_pop(f"f{j}").alias(f"v{j}") for j in range(size)]).collect()}
    means = [[got[d][f"m{j}"] if d in got else 0.0 for j in range(size)] for d in domains]
    variances = [max(1e-4, sum(n[d] * got[d][f"v{j}"] for d in got) / total) if total else 1.0 for j in range(size)]
    prior = [n.get(d, 0) / total if total else 1 / len(domains) for d in domains]
    return Classifier(domains, prior, means, variances, lexicons)


def rate(p: Column, history: list[list[float]], whole: int | None = None) -> Column:
    """A document's rate: 1, then max(0, w - p . d) for each step d of the history; max(1, ...) where p[whole] is half or more."""
    w = F.lit(1.0)
    least = F.lit(0.0) if whole is None else F.when(F.get(p, F.lit(whole)) >= 0.5, 1.0).otherwise(0.0)
    for d in history:
        w = F.greatest(least, w - sum(F.get(p, F.lit(j)) * F.lit(float(x)) for j, x in enumerate(d)))
    return w


def solved(rows: DataFrame, targets: list[float], s: Settings = Settings(), whole: int | None = None) -> tuple[list[list[float]], list[list[float]]]:
    """(steps, residuals by iteration) for rows (tokens, p). targets: shares of all tokens; they are scaled to sum to 1.

    whole: a domain that loses no document. What is mainly of it has rates of 1 or more, and where another domain has less
    than its target already, its present share is its target, so it is not raised at the cost of this one.
    """
    k = len(targets)
    share = np.array(targets) / sum(targets)
    at = lambda j: F.get("p", F.lit(j))
    steps: list[list[float]] = []
    residuals: list[list[float]] = []
    moved, was = np.zeros(k), np.inf
    for _ in range(s.iterations):
        now = rows.select(F.col("tokens").cast("double").alias("l"), "p", rate(F.col("p"), steps, whole).alias("w"))
        mass = F.when(F.col("w") > 0, F.col("l")).otherwise(0.0)  # of the documents that a step can move either way
        got = now.agg(F.sum("l"), *[F.sum(F.col("l") * F.col("w") * at(j)) for j in range(k)], *[F.sum(mass * at(i) * at(j)) for i in range(k) for j in range(i, k)]).first()
        if not got[0]:
            return [], []
        held = np.array(got[1 : 1 + k]) / got[0]
        if whole is not None and not residuals:  # all rates are 1: these are the present shares
            share = np.minimum(share, held)
            share[whole] += 1 - share.sum()
        g = held - share
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = np.array(got[1 + k :]) / got[0]
        gram += np.triu(gram, 1).T
        residuals.append(g.tolist())
        slope = g - s.ridge * moved
        size = float(np.abs(slope).max())
        if size < s.tolerance:
            break
        metric = gram + s.ridge * np.eye(k) if size < 0.9 * was else np.eye(k) * (np.linalg.norm(gram, 1) + s.ridge)
        d = np.linalg.solve(metric, slope)
        steps.append(d.tolist())
        moved, was = moved + d, size
    else:
        if max(map(abs, residuals[-1]), default=0) > s.missed:
            warnings.warn(f"mixing: after {s.iterations} steps the shares miss their targets by {[round(x, 4) for x in residuals[-1]]}", stacklevel=2)
    return steps, residuals


def copies(w: Column, doc_id: Column, seed: int = 17) -> Column:
    """How often a document enters the mix: the rate, rounded up or down by the hash of its id, so that it is right on average."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(2**40)) / F.lit(float(2**40))
    return F.floor(w + u).cast("int")


@dataclass
class Mix:
    classifier: Classifier
    history: list[list[float]]
    residuals: list[list[float]]
    whole: int | None = None

    def on(self, docs: DataFrame, text: str = "text", name: str = "_mix") -> DataFrame:
        """docs with a column of the given name, which none of theirs may have: struct(tokens, p, rate).

        Null and empty texts have 0 tokens; repeated rows get equal rates; an empty table gives an empty result.
        """
        x = self.classifier.described(F.col(text))
        body: Callable[[Column], Column] = lambda d: let(self.classifier.posteriors(d["f"]), lambda p: F.struct(d["tokens"].alias("tokens"), p.alias("p"), rate(p, self.history, self.whole).alias("rate")))
        return docs.withColumn(name, let(x, body))


def fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", s: Settings = Settings(), whole: str | None = None) -> tuple[Mix, DataFrame]:
    """(mix, a written table of id, tokens, p for all documents). whole: the domain that loses no document, if any."""
    classifier = fit(docs, labelled, list(targets), doc_id, text, s)
    thin = Mix(classifier, [], []).on(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), "t").select("doc_id", "_mix.tokens", "_mix.p")
    thin = written(thin, "mix-rows")
    kept = None if whole is None else list(targets).index(whole)
    history, residuals = solved(thin, list(targets.values()), s, kept)
    return Mix(classifier, history, residuals, kept), thin


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """doc_id, tokens, a posterior p_<domain> for each domain, rate, copies: a row for each of docs.

    Null and empty texts have 0 tokens, so any rate suits them; theirs follows from their posteriors. Repeated rows get
    equal rates. Without labels all domains are equally likely; without tokens all rates are 1. Other columns do not
    matter; an empty table gives an empty result.
    """
    mix, thin = fitted(docs, labelled, targets, doc_id, text, s)
    w = let(F.col("p"), lambda p: rate(p, mix.history))
    return thin.withColumn("rate", w).select("doc_id", "tokens", *[F.get("p", F.lit(j)).alias(f"p_{d}") for j, d in enumerate(targets)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
