"""Reproducible shuffling into shards: a Feistel permutation, with cycle walking, of global row numbers.

Rows are numbered by (id, crc32 and hash of the text), so the numbering, and with it the shuffle, depends on the rows
and the key alone, not on files or partitions. The permuted number p of a row gives its place directly: shard p mod k,
slot p div k. Shards differ by one row at most, slots are gapless, and place() and row_at() compute either from the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import arrow_map, written

ROUNDS = 6
#: Multipliers and shifts of the public splitmix64 finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 (or its inverse) at x."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64(2**half - 1), np.uint64(half)
    keys = [(key + _GOLD * (i + 1)) % 2**64 for i in range(ROUNDS)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):  # numbers that leave 0..n-1 walk on along their cycle until they are back
        a, b = out[todo] >> shift, out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                a, b = b ^ (_mixed(a, k) & mask), a
            else:
                a, b = b, a ^ (_mixed(b, k) & mask)
        out[todo] = (a << shift) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place(row: np.ndarray, n: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    p = permuted(row, n, key)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, key: int) -> np.ndarray:
    return permuted(np.asarray(slot) * shards + np.asarray(shard), n, key, inverse=True)


def sharded(docs: DataFrame, shards: int = 40, key: int = 20_240_229, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32, law, row (global number), shard, slot, grown_shard (always null).

    Null texts count 0 bytes. Null ids are numbered first. Rows equal in id and text are interchangeable. Other columns
    of docs do not matter; an empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    thin = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("h"))
    ordered = thin.repartitionByRange("doc_id", "text_crc32", "h").sortWithinPartitions("doc_id", "text_crc32", "h")
    rows = written(ordered.drop("h").withColumn("at", F.monotonically_increasing_id()), "shard-rows")  # its high bits: the partition
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("at", 33)).count().collect())  # one row for each partition
    first, n = {}, 0
    for part, count in sizes:
        first[part], n = n, n + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            row = np.array([first[p] for p in (at >> 33).tolist()], np.int64) + (at & (2**33 - 1))
            shard, slot = place(row, n, shards, key)
            m = len(at)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(["rows"] * m), pa.array(row), pa.array(shard.astype(np.int32)), pa.array(slot), pa.nulls(m, pa.int32())], ["doc_id", "size", "text_crc32", "law", "row", "shard", "slot", "grown_shard"])

    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows.select("doc_id", "size", "text_crc32", "at"), run, f"doc_id {kind}, size long, text_crc32 long, law string, row long, shard int, slot long, grown_shard int")
