"""A byte-level convolutional network, in numpy, that marks whole texts for quality.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. In a chunk each byte is embedded, `filters`
learned filters of `width` bytes slide over it, and each filter's largest response in the chunk is kept. A small dense
layer makes `heads` values of a chunk; their maximum, minimum and mean over the chunks, and the text's length, give one
probability. Everything, embeddings included, is learned by back-propagation (Adam) on a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import arrow_map, in_slices, unused

PAD = 256


@dataclass
class Settings:
    """sample: labelled texts that training uses, at most, none longer than longest bytes (longer ones are still scored whole)."""

    chunk: int = 512
    step: int = 448
    width: int = 6
    embed: int = 6
    filters: int = 24
    heads: int = 4
    sample: int = 3000
    longest: int = 60_000
    epochs: int = 8
    docs: int = 16
    rate: float = 0.01
    seed: int = 3


def chunks(text: bytes | None, s: Settings) -> np.ndarray:
    """(chunks, chunk + width - 1) byte ids; the last chunk ends with the text; a short or empty text is one padded chunk."""
    x = np.frombuffer(text or b"", np.uint8).astype(np.int16)
    wide = s.chunk + s.width - 1
    if len(x) <= wide:
        return np.pad(x, (0, wide - len(x)), constant_values=PAD)[None]
    at = np.arange(0, len(x) - wide, s.step)
    return x[np.append(at, len(x) - wide)[:, None] + np.arange(wide)]


def start(s: Settings) -> dict[str, np.ndarray]:
    r = np.random.default_rng(s.seed)
    f = lambda *shape, by: r.normal(0, by, shape).astype(np.float32)
    return {"E": f(257, s.embed, by=0.5), "W": f(s.width, s.embed, s.filters, by=0.4), "b": np.zeros(s.filters, np.float32), "A": f(s.filters, s.heads, by=0.3), "a": np.zeros(s.heads, np.float32), "D": f(3 * s.heads + 1, by=0.2), "d": np.zeros(1, np.float32)}


def pooled(p: dict, x: np.ndarray, s: Settings, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest response in each chunk, and where it is."""
    taps = [p["E"] @ p["W"][j] for j in range(s.width)]  # a byte's part of the response at each place of the filter
    taps[0] = taps[0] + p["b"]
    out, where = np.empty((len(x), s.filters), np.float32), np.empty((len(x), s.filters), np.int64) if places else None
    n = x.shape[1] - s.width + 1
    for i in range(0, len(x), 32):
        part = x[i : i + 32]
        y = taps[0][part[:, :n]]
        for j in range(1, s.width):
            y += taps[j][part[:, j : j + n]]
        out[i : i + 32] = y.max(1)
        if places:
            where[i : i + 32] = y.argmax(1)
    return out, where


def combined(p: dict, pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of texts whose chunks start at `first` in pool."""
    act = np.maximum(pool, 0)
    h = np.tanh(act @ p["A"] + p["a"])
    count = np.diff(np.append(first, len(pool)))
    top, low, mean = np.maximum.reduceat(h, first), np.minimum.reduceat(h, first), np.add.reduceat(h, first) / count[:, None]
    feats = np.concatenate([top, low, mean, np.minimum(np.log1p(sizes) / 6 - 1, 0.1)[:, None]], 1).astype(np.float32)
    return feats @ p["D"] + p["d"], (act, h, count, top, low, feats)


def gradients(p: dict, x: np.ndarray, first: np.ndarray, sizes: np.ndarray, label: np.ndarray, s: Settings) -> dict:
    pool, where = pooled(p, x, s, True)
    logit, (act, h, count, top, low, feats) = combined(p, pool, first, sizes)
    g = (1 / (1 + np.exp(-logit)) - label) / len(label)
    d = {"D": feats.T @ g, "d": g.sum(keepdims=True)}
    of = np.repeat(np.arange(len(first)), count)
    k = s.heads
    part = g[:, None] * p["D"][None, : 3 * k]
    dh = part[of, 2 * k :] / count[of, None]
    for at, best in ((0, top), (k, low)):
        hit = h == best[of]
        share = np.add.reduceat(hit.astype(np.float32), first)
        dh = dh + hit * (part[of, at : at + k] / share[of])
    dz = dh * (1 - h * h)
    d["A"], d["a"] = act.T @ dz, dz.sum(0)
    dpool = (dz @ p["A"].T) * (pool > 0)
    d["b"] = dpool.sum(0)
    d["W"], d["E"] = np.zeros_like(p["W"]), np.zeros_like(p["E"])
    row, col = np.arange(len(x))[:, None], np.arange(s.filters)
    for j in range(s.width):
        tap = np.zeros((257, s.filters), np.float32)
        np.add.at(tap, (x[row, where + j], np.broadcast_to(col, where.shape)), dpool)
        d["W"][j] = p["E"].T @ tap
        d["E"] += tap @ p["W"][j].T
    return d


def trained(texts: list[bytes], labels: list[int], s: Settings = Settings()) -> dict[str, np.ndarray]:
    """Parameters. Without labels of both kinds the network gives the smoothed share of label 1 to every text."""
    p = start(s)
    ones = sum(labels)
    p["d"][:] = math.log((ones + 1) / (len(labels) - ones + 1))
    if not 0 < ones < len(labels):
        p["D"][:] = 0
        return p
    r = np.random.default_rng(s.seed)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    y = np.array(labels, np.float32)
    for epoch in range(s.epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), s.docs):
            part = order[i : i + s.docs]
            cut = [chunks(texts[j], s) for j in part]
            first = np.cumsum([0] + [len(c) for c in cut[:-1]])
            d = gradients(p, np.concatenate(cut), first, np.array([len(texts[j]) for j in part]), y[part], s)
            t += 1
            rate = s.rate * (1 - 0.9 * epoch / s.epochs)
            for k in p:
                m[k] += 0.1 * (d[k] - m[k])
                v[k] += 0.01 * (d[k] ** 2 - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> dict[str, np.ndarray]:
    """Trains on s.sample labelled texts at most, chosen by the hash of the id among rows for which `learn` holds.

    Null labels and ids are ignored; of several labels of an id the mean decides.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.withColumnRenamed("k", doc_id).filter(learn).orderBy(F.xxhash64(doc_id), doc_id).limit(s.sample).select(F.col(doc_id).alias("k"), "y")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    found = docs.filter(F.octet_length(body) <= s.longest).select(F.col(doc_id).alias("k"), body.alias("x")).join(F.broadcast(chosen), "k")
    rows = found.groupBy("k", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r[0])
    return trained([bytes(r[2]) for r in rows], [r[1] for r in rows], s)


def scored(docs: DataFrame, p: dict[str, np.ndarray], keep: list[str], text: str = "text", s: Settings = Settings(), name: str = "score") -> DataFrame:
    """The kept columns and the score (under a name that none of them has), 0 to 1, of each whole text.

    Null counts as empty; an empty text is scored as all padding. Repeated rows get equal scores; columns that are not kept
    do not matter; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, 0, 500_000):
                texts = part.column(0).to_pylist()
                cut = [chunks(x, s) for x in texts]
                first = np.cumsum([0] + [len(c) for c in cut[:-1]])
                logit, _ = combined(p, pooled(p, np.concatenate(cut), s)[0], first, np.array([len(x or b"") for x in texts]))
                out = 1 / (1 + np.exp(-logit.astype(float)))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(1, part.num_columns)], pa.array(out)], [*keep, name])

    chosen = docs.select(F.col(text).cast("binary").alias(unused("_body", keep)), *keep)
    return arrow_map(chosen, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]) + f", `{name}` double")
