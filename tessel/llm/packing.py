"""Packing token sequences: a configuration linear program over the histogram of lengths.

tessel.llm.program solves it by multiplicative weights with knapsack dynamic programming, and rounds the solution to whole
sequences. It sees the histogram alone, at most `size` numbers, whatever the corpus.

Pieces get their place without any sort of the data: a piece's number among those of its length (a count kept by each
partition, plus the counts of the partitions before it) is looked up in the plan's ranges.
"""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.program import Plan, Program, best_fit, sequences
from tessel.llm.shared import arrow_map, unused, written

#: Words of a generation that a worker keeps the ids of (about 200 bytes each, two generations: 160 MB).
KNOWN = 400_000


def planned(histogram: dict[int, int], size: int = 2048) -> Plan:
    """(lengths of a sequence, how many such sequences): together they hold each length as often as the histogram.

    The program's plan, unless best fit alone needs fewer sequences: the program is solved to a gap, not to the end.
    """
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    plan: Plan = []
    if whole := left.pop(size, 0):
        plan.append(((size,), whole))
    if left:
        lengths = np.array(sorted(left, reverse=True))
        program = Program(lengths, np.array([left[int(x)] for x in lengths]), size)
        plan += min(program.rounded(program.solved()), best_fit(left, size), key=sequences)
    return plan


_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_DIGITS = "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == "N")
_SPACES = "\t-\r \x85\xa0"
#: How the tokenizer cuts text into words, for text that Latin-1 can hold (in RE2's syntax). Such text is composed already,
#: and its lower case is a matter of single characters. What lies between words is white space.
_CUT = f"('s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+)"
#: Text that Latin-1 cannot hold, or that may have special tokens, is left to the tokenizer.
_ODD = r"[^\x{00}-\x{FF}]|<\|"


class _Encoder:
    """Texts to token ids, as little-endian 32-bit numbers.

    Arrow cuts a batch of texts at spaces and line ends, which the tokenizer's words never cross, and tells the parts apart;
    distinct parts in Latin-1 are cut into words, and these are told apart again, so the ids of a word are looked up once a
    batch. Unseen words are encoded many at once and told apart by their last token, which ends a word. Other parts go to
    the tokenizer as they are. What has been seen is kept in two generations: a full one becomes the old one, from which
    what is met again is taken back, so common words stay.
    """

    def __init__(self, path: str, most: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.plain = Tokenizer.from_file(path)  # for words that are cut and in lower case already: its merges alone
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.seen: dict[str, bytes] = {}  # words, and odd parts, which no word is equal to
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")

    def _words(self, words: list[str]) -> Iterator[bytes]:
        for i in range(0, len(words), 4000):
            part = words[i : i + 4000]
            got = self._ids(" ".join(part))
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(part):  # not one ending token a word: take them one by one
                yield from (self._ids(w).tobytes() for w in part)
                continue
            data, at = got.tobytes(), 0
            for stop in (4 * stops).tolist():
                yield data[at:stop]
                at = stop

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _odd(self, parts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _known(self, keys: list[str], learn: Callable[[list[str]], Iterator[bytes]]) -> _Ragged:
        """The ids of distinct words or parts; `learn` makes those of unseen ones."""
        if len(self.seen) > self.most:
            self.old, self.seen = self.seen, {}
        found = list(map(self.seen.get, keys))
        holes = [i for i, x in enumerate(found) if x is None]
        if holes and self.old:
            for i, x in zip(holes, [self.old.get(keys[i]) for i in holes]):
                if x is not None:
                    found[i] = self.seen[keys[i]] = x
            holes = [i for i in holes if found[i] is None]
        if holes:
            new = [keys[i] for i in holes]
            ids = list(learn(new))
            self.seen.update(zip(new, ids))
            for i, x in zip(holes, ids):
                found[i] = x
        return _Ragged(np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4)

    def _parts(self, parts: pa.Array) -> _Ragged:
        """The ids of distinct parts."""
        odd = pc.match_substring_regex(parts, _ODD)
        plain = pc.utf8_lower(parts.filter(pc.invert(odd)))
        cut = pc.replace_substring_regex(pc.replace_substring_regex(plain, f"[{_SPACES}]", " "), _CUT, r"\1 ")
        lists = pc.split_pattern(cut, " ")
        words = lists.flatten().dictionary_encode()
        known = self._known(words.dictionary.to_pylist(), self._words_and_none)
        out = known.gathered(words.indices.to_numpy(), pc.list_value_length(lists).to_numpy())
        if pc.any(odd).as_py():
            others = self._known(parts.filter(odd).to_pylist(), self._odd)
            place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            out = _Ragged(np.concatenate([out.data, others.data]), np.concatenate([out.size, others.size])).gathered(place, np.ones(len(place), int))
        return out

    def _words_and_none(self, new: list[str]) -> list[bytes]:
        ids = list(self._words([w for w in new if w]))
        if "" in new:
            ids.insert(new.index(""), b"")
        return ids

    def flat(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after the other, each text's followed by those of `end`, and where each text's stop."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        ids, which, n = self._parts(parts.dictionary), parts.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
        if end:
            which, n = np.insert(which, np.cumsum(n), len(ids.size)), n + 1
            ids = _Ragged(np.append(ids.data, np.frombuffer(end, "<u4")), np.append(ids.size, len(end) // 4))
        out = ids.gathered(which, n)
        return out.data, np.cumsum(out.size)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, stops = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, stops[:-1])] if texts else []


class _Ragged:
    """Lists of ids: all ids one after the other, and each list's size."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.data, self.size = data, size

    def gathered(self, which: np.ndarray, n: np.ndarray) -> _Ragged:
        """The lists of the given numbers, put together to longer ones of `n` lists each."""
        first, stop = np.cumsum(self.size) - self.size, np.cumsum(self.size[which])
        out = np.empty(int(stop[-1]) if len(stop) else 0, "<u4")
        for i in range(0, len(which), 50_000):  # in steps, for the temporary arrays
            w, at = which[i : i + 50_000], int(stop[i - 1]) if i else 0
            size, to = self.size[w], stop[i : i + 50_000] - at
            out[at : at + to[-1]] = self.data[np.repeat(first[w] - to + size, size) + np.arange(to[-1])]
        return _Ragged(out, np.diff(np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(n)])]))


@functools.lru_cache(1)
def _encoder(path: str, known: int) -> _Encoder:
    """One for all tasks of a Python worker: words seen by earlier tasks are known to later ones."""
    return _Encoder(path, known)


def pieces(docs: DataFrame, tokenizer: str, keep: list[str], size: int = 2048, text: str = "text", known: int = KNOWN) -> DataFrame:
    """The kept columns and piece, start, length, ids_crc32, part, nth (of its length in its part): a row for each piece.

    Null text counts as empty and is one piece, the end token 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nth = _encoder(tokenizer, known), np.zeros(size + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            data, stops = ids.flat(batch.column(0), b"\0\0\0\0")
            first = 0
            for r, stop in enumerate(stops.tolist()):
                for piece, at in enumerate(range(first, stop, size)):
                    length = min(size, stop - at)
                    out.append((r, piece, at - first, length, zlib.crc32(data[at : at + length]), int(nth[length])))
                    nth[length] += 1
                first = stop
            take = pa.array([x[0] for x in out], pa.int64())
            col = lambda i, kind: pa.array([x[i] for x in out], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(1, batch.num_columns)], col(1, pa.int32()), col(2, pa.int64()), col(3, pa.int64()), col(4, pa.int64()), col(5, pa.int64())], [*keep, "piece", "start", "length", "ids_crc32", "nth"])

    chosen = docs.select(F.col(text).alias(unused("_body", keep)), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return arrow_map(chosen, run, f"{kept}, piece int, start long, length long, ids_crc32 long, nth long").withColumn("part", F.spark_partition_id())


def packed(docs: DataFrame, tokenizer: str, keep: list[str], size: int = 2048, text: str = "text", known: int = KNOWN) -> DataFrame:
    """pieces() with sequence_id and offset in place of part and nth.

    Repeated rows are packed each; other columns do not matter; an empty table gives an empty result.
    """
    rows = written(pieces(docs, tokenizer, keep, size, text, known), "pack-pieces")
    by_part = written(rows.groupBy("part", "length").count(), "pack-counts")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    plan = planned({r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("count")).collect()}, size)
    keys, ends, first, offset, used, base = [], [], [], [], Counter(), 0
    for config, times in plan:
        at = 0
        for x in config:
            keys.append((x << 40) | used[x])
            first.append(base)
            offset.append(at)
            used[x] += times
            at += x
        base += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    keys_a, first_a, offset_a = (np.array(v, np.int64)[order] for v in (keys, first, offset))
    names = [*keep, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = (batch.column(names.index("length")).to_numpy() << 40) | batch.column(len(names)).to_numpy()
            i = np.searchsorted(keys_a, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(names))], pa.array(first_a[i] + key - keys_a[i]), pa.array(offset_a[i])], [*names, "sequence_id", "offset"])

    placed = rows.join(offsets, ["part", "length"]).select(*names, (F.col("nth") + F.col("before")).alias("rank"))
    return arrow_map(placed, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields[: len(names)]) + ", sequence_id long, offset long")
