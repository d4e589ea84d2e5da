"""Scoring text with a log-bilinear neural language model.

The `vocabulary` commonest words and the end of a text have vectors of their own, one as context and one as target. With the
context's vectors r(c_i) the prediction is q = sum_i C_i * r(c_i). Words are dealt out to classes: the `single` commonest and
the end are classes by themselves, all others share classes by their last two bytes. P(class | q) is a softmax of
q . Q_k + b_k over all classes, P(word | class, q) one of q . M_w + b_w over the class's words: products of matrices for blocks of
positions, which normalise over the whole vocabulary at the cost of about two square roots of it. Words beyond the
vocabulary are one more member of their class, with a vector as context too, and share its probability by exact counts of
the whole training corpus: (c + 0.1) / (N_k + 0.1 (V_k + 1)), N_k and V_k over the class's words beyond the vocabulary, so that a
word never seen has its share. All factors sum to 1.

Training: noise-contrastive estimation on every token of every training text, in numpy: against `noise` classes drawn for a
minibatch, and, within classes, against the words of the `rivals` next tokens of the same class in the minibatch, which are
draws from the class's words by frequency. Each partition runs Adagrad on its own texts from
the same start; the parameters are averaged, weighted by tokens, in a tree, so they depend a little on how the texts are
partitioned. A first round over a fifth of the texts gives the second round, over the others, its start.

Counts of words: the `head` commonest go to the workers in a table of bounded size; the others (a few per cent of the
tokens) are joined with the table of counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import arrow_map, in_slices, words_of, written

END = b"\n"


@dataclass
class Settings:
    """vocabulary: words with vectors of their own, single: of them classes by themselves, shared: classes of the others; head:
    words whose counts go to the workers, at most."""

    vocabulary: int = 4000
    single: int = 64
    shared: int = 63
    context: int = 3
    dim: int = 16
    noise: int = 32
    rivals: int = 4
    batch: int = 8192
    rate: float = 0.08
    head: int = 200_000
    seed: int = 7


class Vocabulary:
    """Ids of words. 0 is the end; then the single words; then class by class its words and, last, one id for all its others."""

    def __init__(self, words: list[bytes], single: int, shared: int):
        """words: the commonest first, without the end."""
        self.alone, self.shared = 1 + min(single, len(words)), shared
        members: list[list[bytes]] = [[] for _ in range(shared)]
        for w in words[single:]:
            members[zlib.crc32(w[-2:]) % shared].append(w)
        self.words: list[bytes | None] = [END, *words[:single]]
        self.others = []
        for m in members:
            self.words += [*m, None]
            self.others.append(len(self.words) - 1)
        self.index = {w: i for i, w in enumerate(self.words) if w is not None}
        self.n, self.classes = len(self.words), self.alone + shared
        last = np.array([*range(1, self.alone + 1), *[i + 1 for i in self.others]])
        self.first = np.concatenate([[0], last[:-1]])  # of each class: its first id, and the one after its last
        self.last = last
        self.cls = np.repeat(np.arange(self.classes), last - self.first).astype(np.int32)

    def of(self, word: bytes) -> int:
        i = self.index.get(word)
        return self.others[zlib.crc32(word[-2:]) % self.shared] if i is None else i


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for text in texts:
            seen.update(words_of(text))
        seen[END] += len(texts)
        if len(seen) > 400_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), c: how often it occurs in all texts, with one end a text."""
    return arrow_map(docs.select(F.col(text).cast("binary")), _counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words by falling count, whole bands of counts until `most` words; bounded by `most` whatever the corpus."""
    band = F.when(F.col("c") < 1024, F.col("c")).otherwise((F.log2("c") * 64).cast("long") + 384)
    total, least = 0, None
    for b, n in sorted(((r[0], r[1]) for r in counts.groupBy(band.alias("b")).count().collect()), reverse=True):
        if total + n > most:
            break
        total, least = total + n, b
    if least is None:
        return []
    found = [(bytes(r[0]), r[1]) for r in counts.filter(band >= least).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


class _Ids(dict):
    """word -> id, kept for words seen; emptied before it grows large."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        super().__init__(vocabulary.index)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
            self.update(self.vocabulary.index)
        self[word] = i = self.vocabulary.of(word)
        return i


def _tokens(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, an end after each, and how many of these each text has."""
    flat: list[bytes] = []
    sizes = []
    for x in texts:
        words = words_of(x)
        flat += words
        flat.append(END)
        sizes.append(len(words) + 1)
    return flat, np.array(sizes)


def _windows(ids: np.ndarray, sizes: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with `context` ends before it, and the positions of its tokens."""
    at = np.arange(len(ids)) + context * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    a = np.zeros(len(ids) + context * len(sizes), np.int32)
    a[at] = ids
    return a, at


@dataclass
class Prior:
    """By class its share of the tokens; by id its share of its class."""

    classes: np.ndarray
    within: np.ndarray

    @staticmethod
    def of(v: Vocabulary, counts: np.ndarray) -> Prior:
        c = counts + 1.0
        total = np.add.reduceat(c, v.first)
        return Prior(total / total.sum(), c / total[v.cls])


def start(v: Vocabulary, prior: Prior, s: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    return {
        "R": rng.normal(0, 0.1, (v.n, s.dim)).astype(np.float32),
        "Q": rng.normal(0, 0.1, (v.classes, s.dim)).astype(np.float32),
        "M": np.zeros((v.n, s.dim), np.float32),
        "C": np.full((s.context, s.dim), 1.0, np.float32),
        "b": np.log(prior.classes).astype(np.float32),
        "m": np.log(prior.within).astype(np.float32),
    }


def summed_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """An array of n rows: the sum of the rows for each place."""
    d = rows.shape[1]
    return np.bincount((at[:, None] * d + np.arange(d)).ravel(), rows.ravel(), n * d).reshape(n, d).astype(np.float32)


def _against(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the noise-contrastive loss by the scores of the tokens and of the noise."""
    return -1 / (1 + np.exp(np.clip(own, -30, 30))), 1 / (1 + np.exp(np.clip(-other, -30, 30)))


def _stepped(p: dict, g2: dict, rows: dict[str, np.ndarray], at: np.ndarray, n: int, s: Settings) -> None:
    """An Adagrad step of those rows of tables that the places name; gradients of one place are summed."""
    ids, inverse = np.unique(at, return_inverse=True)
    for k, x in rows.items():
        g = (summed_rows(inverse, x, len(ids)) / np.float32(n)).reshape(len(ids), *p[k].shape[1:])
        g2[k][ids] = h = g2[k][ids] + g * g
        p[k][ids] -= np.float32(s.rate) * g / np.sqrt(h + 1e-8)


def nce_step(p: dict, g2: dict, a: np.ndarray, at: np.ndarray, v: Vocabulary, prior: Prior, rng: np.random.Generator, s: Settings) -> None:
    """One Adagrad step of noise-contrastive estimation on the tokens at the given positions, which rise."""
    word, n, low = a[at], len(at), int(at[0]) - s.context
    cls, here, place = v.cls[word], a[low : int(at[-1]) + 1], at - low
    vectors = p["R"][here]  # of all positions in between, once
    rows = [vectors[place - 1 - i] for i in range(s.context)]
    q = sum(c * r for c, r in zip(p["C"], rows))
    # classes: the same noise for all tokens
    noise = rng.choice(v.classes, s.noise, p=prior.classes)
    shift = p["b"] - np.log(s.noise * prior.classes).astype(np.float32)
    target = p["Q"][cls]
    g_own, g_other = _against(np.einsum("nd,nd->n", q, target) + shift[cls], q @ p["Q"][noise].T + shift[noise])
    dq = g_own[:, None] * target + g_other @ p["Q"][noise]
    d = {"Q": summed_rows(cls, g_own[:, None] * q, v.classes), "b": np.bincount(cls, g_own, v.classes).astype(np.float32)}
    np.add.at(d["Q"], noise, g_other.T @ q)
    np.add.at(d["b"], noise, g_other.sum(0))
    # words of shared classes: tokens in order of class, each against those after it
    some = np.flatnonzero(cls >= v.alone)
    if len(some) > s.rivals:
        some = some[np.argsort(cls[some], kind="stable")]
        own, qs, k = word[some], q[some], cls[some]
        target = p["M"][own]
        score = p["m"] - np.log(s.rivals * prior.within).astype(np.float32)
        score = score[own]
        g = -1 / (1 + np.exp(np.clip(np.einsum("nd,nd->n", qs, target) + score, -30, 30)))
        dqs, dm, db = g[:, None] * target, g[:, None] * qs, g.copy()
        for r in range(1, s.rivals + 1):
            g = 1 / (1 + np.exp(np.clip(-np.einsum("nd,nd->n", qs[:-r], target[r:]) - score[r:], -30, 30)))
            g = np.where(k[:-r] == k[r:], g, 0).astype(np.float32)
            dqs[:-r] += g[:, None] * target[r:]
            dm[r:] += g[:, None] * qs[:-r]
            db[r:] += g
        dq[some] += dqs
        _stepped(p, g2, {"M": dm, "m": db[:, None]}, own, n, s)
    d["C"] = np.stack([np.einsum("nd,nd->d", dq, r) for r in rows])
    back = np.zeros_like(vectors)
    for i, c in enumerate(p["C"]):
        back[place - 1 - i] += c * dq  # no position twice
    _stepped(p, g2, {"R": back}, here, n, s)
    for k, grad in d.items():
        grad /= np.float32(n)
        g2[k] += grad * grad
        p[k] -= np.float32(s.rate) * grad / np.sqrt(g2[k] + 1e-8)


def _blob(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32).tobytes()


def _trained(p0: dict, v: Vocabulary, prior: Prior, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, ids = np.random.default_rng(s.seed), _Ids(v)
        p, g2, seen = {k: x.copy() for k, x in p0.items()}, {k: np.full_like(x, 1e-3) for k, x in p0.items()}, 0
        for batch in batches:
            for part in in_slices(batch, 0):
                words, sizes = _tokens(part.column(0).to_pylist())
                a, at = _windows(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)), sizes, s.context)
                for i in rng.permutation(np.arange(0, len(at), s.batch)):
                    nce_step(p, g2, a, at[i : i + s.batch], v, prior, rng, s)
                seen += len(at)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([_blob(p)], pa.binary())], ["n", "p"])

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0.0, None
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(blob, np.float32).astype(np.float64) * k
            n, total = n + k, x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["n", "p"])


@dataclass
class Model:
    params: dict[str, np.ndarray]
    vocabulary: Vocabulary
    inside: np.ndarray  # by id, log10 of what its count term is divided by: c + 0.1, or N_k + 0.1 (V_k + 1) beyond the vocabulary
    head: list[tuple[bytes, int]]
    counts: DataFrame
    n: int
    v: int
    settings: Settings


def fit(docs: DataFrame, text: str = "text", part: Column | None = None, s: Settings = Settings()) -> Model:
    """Counts of and a model trained on all the given texts. part: a number that deals texts out to the two rounds."""
    part = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) if part is None else part
    counts = written(word_counts(docs, text), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = commonest(counts, s.head)
    v_ = Vocabulary([w for w, _ in head if w != END][: s.vocabulary], s.single, s.shared)

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((s.shared, 2), np.int64)
        for batch in batches:
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if w not in v_.index:
                    total[zlib.crc32(w[-2:]) % s.shared] += (c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(s.shared), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], ["k", "n", "v"])

    by_id, kinds = np.zeros(v_.n), np.zeros(v_.n)
    for w, c in head:
        if w in v_.index:
            by_id[v_.index[w]] = c
    for k, cn, cv in arrow_map(counts.select("word", "c"), beyond, "k int, n long, v long").groupBy("k").agg(F.sum("n"), F.sum("v")).collect():
        by_id[v_.others[k]], kinds[v_.others[k]] = cn, cv
    inside = np.log10(by_id + 0.1)
    inside[v_.others] = np.log10(by_id[v_.others] + 0.1 * (kinds[v_.others] + 1))
    prior = Prior.of(v_, by_id)
    params = start(v_, prior, s)
    for first in (True, False):
        some = docs.filter((part % 5 == 0) if first else (part % 5 != 0)).select(F.col(text).cast("binary"))
        rows = arrow_map(some, _trained(params, v_, prior, s), "n double, p binary")
        left = some.rdd.getNumPartitions()
        while True:  # a tree of averages: no task sees more than 32 rows, and the driver one
            left = max(1, -(-left // 32))
            rows = arrow_map(rows.repartition(left), _averaged, "n double, p binary")
            if left == 1:
                break
        got = rows.collect()
        if got:
            flat, at = np.frombuffer(got[0][1], np.float32), 0
            for k in sorted(params):
                size = params[k].size
                params[k] = flat[at : at + size].reshape(params[k].shape).copy()
                at += size
    return Model(params, v_, inside, head, counts, n, v, s)


def _log_softmax(q: np.ndarray, columns: np.ndarray, own: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The logarithm of each row's share of its own column in a softmax of q . columns. room: space for the scores."""
    scores = np.matmul(q, columns, out=room[: len(q) * columns.shape[1]].reshape(len(q), -1))
    mine = scores[np.arange(len(q)), own]
    with np.errstate(over="ignore"):
        total = np.exp(scores, out=scores).sum(1)
    if np.isfinite(total).all() and total.min() > 0:
        return mine - np.log(total)
    scores = np.matmul(q, columns)  # too large for a plain exponential
    top = scores.max(1)
    return mine - top - np.log(np.exp(scores - top[:, None]).sum(1))


def token_log10(p: dict, v: Vocabulary, a: np.ndarray, at: np.ndarray, block: int = 1024) -> np.ndarray:
    """log10 P(id | context) at the given positions; normalised over all ids."""
    parts = [p["R"] * c for c in p["C"]]
    qt = np.concatenate([p["Q"].T, p["b"][None]]).astype(np.float32)  # the bias is one more dimension, in which q is 1
    mt = np.concatenate([p["M"].T, p["m"][None]]).astype(np.float32)
    room = np.empty(block * max(v.classes, int((v.last - v.first).max())), np.float32)
    cls, out, q = v.cls[a[at]], np.empty(len(at)), np.ones((len(at), len(qt)), np.float32)
    for i in range(0, len(at), block):
        x = at[i : i + block]
        q[i : i + block, :-1] = sum(t[a[x - 1 - j]] for j, t in enumerate(parts))
        out[i : i + block] = _log_softmax(q[i : i + block], qt, cls[i : i + block], room)
    some = np.flatnonzero(cls >= v.alone)
    some = some[np.argsort(cls[some], kind="stable")]  # class by class, each a product of matrices
    for group in np.split(some, np.flatnonzero(np.diff(cls[some])) + 1) if len(some) else ():
        first, last = v.first[cls[group[0]]], v.last[cls[group[0]]]
        columns = np.ascontiguousarray(mt[:, first:last])
        for i in range(0, len(group), block):
            x = group[i : i + block]
            out[x] += _log_softmax(q[x], columns, a[at[x]] - first, room)
    return out / math.log(10)


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """A row for each of docs: the kept columns, n_tokens, n_known, train_tokens, base_score and score.

    Null text counts as empty (its end alone is scored). Repeated rows stay, each with its score; without any training
    text every token has probability 1 in the base. Other columns of docs do not matter.
    """
    s, v, head = model.settings, model.vocabulary, model.head
    index = _Places({w: i for i, (w, _) in enumerate(head)})
    logc = np.array([math.log10(c + 0.1) for _, c in head])
    kinds = np.array([v.of(w) for w, _ in head], np.int32)
    params, inside = model.params, model.inside
    logc, kinds = np.append(logc, 0.0), np.append(kinds, np.int32(0))  # the last stands for words outside the head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 0, 600_000):
                words, sizes = _tokens(part.column(0).to_pylist())
                first = np.cumsum(sizes) - sizes
                found = np.fromiter(map(index.__getitem__, words), np.int32, len(words))
                k, unseen = kinds[found], np.flatnonzero(found < 0)
                k[unseen] = [v.of(words[i]) for i in unseen.tolist()]
                tails: list[Counter[bytes]] = [Counter() for _ in sizes]
                for text, i in zip((np.searchsorted(first, unseen, "right") - 1).tolist(), unseen.tolist()):
                    tails[text][words[i]] += 1
                known, base = np.add.reduceat(found >= 0, first, dtype=np.int64), np.add.reduceat(logc[found], first)
                a, at = _windows(k, sizes, s.context)
                inner = np.add.reduceat(token_log10(params, v, a, at) - inside[k], first)
                rest = pa.array([[{"word": w, "n": n} for w, n in t.items()] for t in tails], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(1, part.num_columns)], pa.array(sizes), pa.array(known), pa.array(base), pa.array(inner), rest], [*names, "n_tokens", "known", "logc", "inner", "tail"])

    names = [f"k{i}" for i in range(len(keep))]  # so that no kept column has a name of ours
    chosen = docs.select(F.col(text).cast("binary").alias("body"), *[F.col(k).alias(n) for k, n in zip(keep, names)])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    rows = arrow_map(chosen, run, f"{kept}, n_tokens long, known long, logc double, inner double, tail array<struct<word:binary,n:int>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    tail = rows.select("row", F.inline("tail")).join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("t_logc"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("t_known"))
    total = F.col("logc") + F.coalesce("t_logc", F.lit(0.0))
    base = total - F.col("n_tokens") * F.lit(math.log10(model.n + 0.1 * (model.v + 1)))
    return rows.drop("tail").join(tail, "row", "left").select(
        *[F.col(n).alias(k) for k, n in zip(keep, names)], "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("inner") + total).alias("score"))
