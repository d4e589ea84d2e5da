"""Exact Jaccard join of texts on word n-grams, by prefix filters under several global token orders.

A text's set is its distinct n-word shingles, as 64-bit hashes. Sets equal to each other are one class, whose smallest
row stands for all. With t the threshold, sets x and y that link share at least ceil(t |x|) shingles, so under any global
order of shingles the first |x| - ceil(t |x|) + l of x and as many of y share at least l. Three orders are used:

1. by hash, ascending, with l about n / 20. Only these prefixes of all texts are exploded. A shingle that no second class
   has in its prefix cannot be shared, and a class with fewer than l shared shingles in its prefix links with nothing: it
   is done. Of the others the whole sets are computed again, and
2. by frequency, rarest first: shingles that no other class has come first, and of the s others of a class the
   s - ceil(t |x|) + 1 rarest hold one that its partner has among its own. They are its keys. A class of which more than
   1 - t is its own has none, whatever passages it shares. A pair is a candidate if it shares a key, and
3. the filters are intersected on each such pair before any set is attached to it: its prefixes under order 1 and under
   the opposite one, by hash, descending, share at least l shingles each, and its sizes allow a link.

Verification then intersects the whole sets. Pairs are not enumerated within a key. First every class meets the centre of
each of its keys, the class with the fewest shingles of its own (a star: as many pairs as rows); links found give
components. Only classes of different components that still share a key are compared, and of those only pairs that can
link by the shingles they share with any class and by their parity maps, and whose distances to the key's centre, where
they were measured, differ by no more than 1 - t, since 1 - Jaccard is a metric. Nothing is capped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import arrow_map, in_slices, removed, tidied, words_of, written

#: Bits of a set's parity map.
BITS = 1024
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows of a side that is sent to all executors, at most (8 to 24 bytes a row).
SMALL = 300_000
#: Rows of the sample that finds hot tokens, at most, and the share of them that makes a token hot.
HOT_ROWS, HOT_SHARE = 20_000, 0.002
#: Rows of a key in one block of comparisons, about.
BLOCK = 500
#: Hundredths of a set's size that l adds to 1 in the filters by hash.
WIDE = 5


@dataclass
class Settings:
    """words of a shingle; percent: 100 * intersection >= percent * union links."""

    words: int = 4
    percent: int = 85

    def overlap(self, n):
        return -(-self.percent * n // 100)

    @staticmethod
    def depth(n):
        """l: how many shingles the prefixes of a linked pair share at least."""
        return 1 + n * WIDE // 100

    def prefix(self, n):
        return n - self.overlap(n) + self.depth(n)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], k: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words: the whole sequence as one; of none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(w) - k + 1
    h = _mixed(w[:n] + np.uint64(k))
    for j in range(1, k):
        h = _mixed(h + w[j : j + n])
    return np.unique(h)


def parity(hashes: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of the hashes that fall on it: two sets differ in at least as many hashes as bits."""
    odd = (np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def text_hash(text: str) -> Column:
    return F.xxhash64(F.lit(29), F.col(text))


def signatures(docs: DataFrame, s: Settings, text: str, doc_id: str) -> DataFrame:
    """row, doc_id, th (hash of the text), n (size of the set), fp (128 bits of the set), pre (the first shingles by hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in in_slices(batch, 0, 2_000_000):
                sets = [shingles(words_of(x), s.words, hashes) for x in part.column(0).to_pylist()]
                n = np.array([len(x) for x in sets], np.int64)
                pre = [x[: s.prefix(len(x))] if len(x) else x for x in sets]
                flat = np.concatenate(pre).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in pre]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), lists], ["doc_id", "th", "n", "fp", "pre"])

    chosen = docs.select(F.col(text).cast("binary").alias("body"), F.col(doc_id).alias("doc_id"), text_hash(text).alias("th"))
    rows = arrow_map(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, th long, n long, fp binary, pre array<long>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _light(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def sets_of(docs: DataFrame, active: DataFrame, n_active: int, s: Settings, text: str, doc_id: str) -> DataFrame:
    """row, set (sorted hashes), bits (parity map) of the classes in active (row, doc_id, fp), computed again from their texts."""
    ids = active.select("doc_id").distinct()
    same = F.col(doc_id).eqNullSafe(F.col("a_id"))
    some = docs.select(F.col(text).cast("binary"), F.col(doc_id)).join(_light(ids.withColumnRenamed("doc_id", "a_id"), n_active), same, "left_semi").select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in in_slices(batch, 0, 2_000_000):
                sets = [shingles(words_of(x), s.words, hashes) for x in part.column(0).to_pylist()]
                maps = [parity(x).tolist() for x in sets]
                sets = [x.tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary()), pa.array(maps, pa.list_(pa.int64()))], ["fp", "set", "bits"])

    found = arrow_map(some, run, "fp binary, set binary, bits array<long>")
    return found.join(_light(active.select("row", "fp"), n_active), "fp").select("row", "set", "bits").dropDuplicates(["row"])


def _ends(pairs: DataFrame, n: int, sets: DataFrame, *what: Column) -> DataFrame:
    """pairs (a, b), n of them, with what each end's set gives: a_<name>, b_<name>."""
    if n <= SMALL:  # of the sets, only those of the pairs are read on and moved
        ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        sets = sets.join(F.broadcast(ends), "row", "left_semi")
    given = sets.select("row", *what)
    names = given.columns[1:]
    a, b = (given.select(F.col("row").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in names]) for k in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", *[f"{k}_{c}" for c in names for k in "ab"])


def intersected(pairs: DataFrame, n: int, sets: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (a, b) that pass the prefix filters under both hash orders, and by size. Prefixes are cut from the
    sets before the join, so no whole set is attached to a pair that a filter refuses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = lambda x: np.frombuffer(x, np.uint64)
        for batch in batches:
            kept = []
            for nx, ny, *cuts in zip(*[batch.column(i).to_pylist() for i in range(2, 8)]):
                least = min(s.depth(nx), s.depth(ny))
                fits = 100 * min(nx, ny) >= s.percent * max(nx, ny)
                kept.append(fits and all(len(np.intersect1d(numbers(x), numbers(y), assume_unique=True)) >= least for x, y in (cuts[:2], cuts[2:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    size = F.floor(F.length("set") / 8)
    bytes_of = (8 * (size - F.floor((s.percent * size + 99) / 100) + 1 + F.floor(size * WIDE / 100))).cast("int")
    first, last = F.substring("set", F.lit(1), bytes_of), F.substring("set", F.length("set") - bytes_of + 1, bytes_of)
    return arrow_map(_ends(pairs, n, sets, size.cast("long").alias("n"), first.alias("first"), last.alias("last")), run, "a long, b long")


def verified(pairs: DataFrame, n: int, sets: DataFrame, s: Settings) -> DataFrame:
    """pairs (a, b) with dist (1 - Jaccard) and linked, by the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist, linked = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                dist.append(1 - both / union)
                linked.append(100 * both >= s.percent * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dist, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "dist", "linked"])

    return arrow_map(_ends(pairs, n, sets, F.col("set")), run, "a long, b long, dist double, linked boolean")


def linked(pairs: DataFrame, sets: DataFrame, s: Settings, what: str) -> DataFrame:
    """A written table of the candidate pairs (a, b) that pass the filters, with dist and linked."""
    pairs = written(pairs, f"{what}-pairs")
    passed = written(intersected(pairs, pairs.count(), sets, s), f"{what}-passed")
    found = written(verified(passed, passed.count(), sets, s), what)
    removed(pairs)
    removed(passed)
    return found


def components(links: DataFrame) -> DataFrame:
    """row, root: for every end of a link (a, b) the smallest row of its component. Smallest label of the neighbours, then
    the label's label, until nothing changes; each round is a written table."""
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = written(ends.union(ends.select("v", "u")).filter("u <> v").distinct(), "cc-edges")
    held = labels = written(edges.groupBy(F.col("u").alias("row")).agg(F.least(F.col("row"), F.min("v")).alias("root")), "cc-labels")
    n = labels.count()
    while True:  # labels are sent to all executors where they are few; else a hub's edges are one key, which AQE splits
        near = edges.join(_light(labels.withColumnRenamed("row", "v"), n), "v").groupBy(F.col("u").alias("row")).agg(F.min("root").alias("near"))
        step = written(labels.join(near, "row").select("row", F.col("root").alias("was"), F.least("root", "near").alias("root")), "cc-step")
        up = step.select(F.col("row").alias("root"), F.col("root").alias("above"))
        after = written(step.join(_light(up, n), "root", "left").select("row", "was", F.least("root", F.coalesce("above", "root")).alias("root")), "cc-labels")
        removed(step)
        removed(held)
        held, labels = after, after.select("row", "root")
        if after.filter("root < was").isEmpty():
            removed(edges)
            return labels


def grouped(docs: DataFrame, s: Settings, text: str, doc_id: str) -> DataFrame:
    """doc_id, th (hash of the text), n (shingles), root (one for each component) of every row of docs."""
    rows = written(signatures(docs, s, text, doc_id), "jaccard-rows")
    full = rows.filter("n > 0")
    groups = written(full.groupBy("fp").agg(F.min("row").alias("cls"), F.count("*").alias("c")).filter("c > 1").select("fp", "cls"), "jaccard-groups")
    n_groups = groups.count()
    of_class = rows.select("row", "doc_id", "th", "n", "fp").join(_light(groups, n_groups), "fp", "left").select("row", "doc_id", "th", "n", "fp", F.coalesce("cls", "row").alias("cls"))
    of_class = written(of_class, "jaccard-classes")
    copies = of_class.filter("cls <> row").select("row")
    reps = full.select("row", "n", "pre").join(_light(copies, copies.count()), "row", "left_anti")

    active = written(_active(reps, of_class.count(), s).join(of_class.select("row", "doc_id", "fp", "n"), "row"), "jaccard-active")
    removed(rows)  # its prefixes have served
    del rows, full, reps
    n_active = active.count()
    sets = written(sets_of(docs, active, n_active, s, text, doc_id), "jaccard-sets")
    tidied(docs.sparkSession)
    keys, hot = _keys(sets, active.select("row", "n"), n_active, s)
    keys = written(keys, "jaccard-keys")  # tok, row, n, s
    tidied(docs.sparkSession)

    leaders = keys.groupBy("tok").agg(F.min(F.struct(F.expr("n - s").alias("u"), "row")).getField("row").alias("a"), F.count("*").alias("c")).filter("c > 1").select("tok", "a")
    met = _routed(keys, written(leaders, "jaccard-leaders"), hot)
    pairs = written(met.filter("row <> a").select("a", F.col("row").alias("b")).distinct(), "jaccard-met")
    star = linked(pairs, sets, s, "jaccard-star")
    labels = components(star.filter("linked"))
    more = linked(_rest(met, pairs.join(star, ["a", "b"], "left"), labels, sets, hot, s), sets, s, "jaccard-more").filter("linked")
    if not more.isEmpty():
        labels = components(star.filter("linked").select("a", "b").union(more.select("a", "b")))
    removed(sets)
    removed(keys)
    return of_class.join(labels.withColumnRenamed("row", "cls"), "cls", "left").select("doc_id", "th", "n", F.coalesce("root", "cls").alias("root"))


def classes(docs: DataFrame, s: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Null and empty texts have no shingles and link with nothing. Null ids never become a component's id while it has
    another. Rows that repeat an id are rows of their own. Other columns do not matter; an empty table gives an empty result.
    """
    named = grouped(docs, s, text, doc_id)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, s: Settings = Settings(5, 80), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without near copies: of each component one row with its smallest id stays.

    Decisions are by row, told by its id and the hash of its text: another text under the same id is a row of its own, and of
    texts of one component under one id the one with the smallest hash stays, once. Rows without an id, and texts without a
    word, all stay. All columns of docs stay as they are, whatever their names; an empty table gives an empty result.
    """
    found = written(grouped(docs, s, text, doc_id).filter("n > 0 and doc_id is not null"), "jaccard-found")
    stays = found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k"), F.count("*").alias("c")).filter("c > 1").select("root", "k.*")
    stays = written(stays, "jaccard-stays")
    n = stays.count()
    first = stays.withColumnRenamed("doc_id", "first").withColumnRenamed("th", "first_th")
    gone = found.join(_light(first, n), "root").filter("doc_id <> first or th <> first_th").select("doc_id", "th").distinct()
    gone = written(gone, "jaccard-gone")
    twice = found.join(_light(stays, n), ["root", "doc_id", "th"], "left_semi").groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th")
    twice = written(twice, "jaccard-twice")
    key, th = (f"_{x}_{uuid.uuid4().hex}" for x in ("id", "th"))
    here = docs.withColumn(key, F.col(doc_id)).withColumn(th, text_hash(text))
    of = lambda df: _light(df.select(F.col("doc_id").alias(key), F.col("th").alias(th)), df.count())
    kept = here.join(of(gone), [key, th], "left_anti")
    if not twice.isEmpty():
        kept = kept.join(of(twice), [key, th], "left_anti").unionByName(kept.join(of(twice), [key, th], "left_semi").dropDuplicates([key, th]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _hot(tokens: Callable[[DataFrame], DataFrame], rows: DataFrame, n: int) -> DataFrame:
    """tok, df of the tokens that many rows have, by a sample of rows: HOT_ROWS at most, chosen by hash.

    It decides only how rows travel: those of hot tokens stay where they are. df is an estimate, the same for all rows; a
    token that the sample has more than once is shared. What a row has at most bounds how many are hot.
    """
    rate = min(1.0, HOT_ROWS / max(n, 1))
    some = rows.filter(F.pmod(F.xxhash64("row", F.lit(77)), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20))))
    least = max(20, int(min(n, HOT_ROWS) * HOT_SHARE))
    found = tokens(some).groupBy("tok").agg(F.count("*").alias("df")).filter(F.col("df") >= least)
    return written(found.withColumn("df", (F.col("df") / F.lit(rate)).cast("long")), "jaccard-hot")


def _routed(big: DataFrame, small: DataFrame, hot: DataFrame) -> DataFrame:
    """big joined with small by tok: rows of hot tokens meet a copy of small's few rows for them, all others are shuffled."""
    toks = F.broadcast(hot.select("tok"))
    return big.join(F.broadcast(small.join(toks, "tok", "left_semi")), "tok").unionByName(big.join(toks, "tok", "left_anti").join(small, "tok"))


def _shared(tokens: DataFrame, hot: DataFrame) -> DataFrame:
    """The tokens (tok, ...) that more than one row has, with df; those of a hot token are not shuffled."""
    rest = tokens.join(F.broadcast(hot.select("tok")), "tok", "left_anti")
    counted = rest.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    return tokens.join(F.broadcast(hot), "tok").unionByName(rest.join(counted, "tok"))


def _overlap(s: Settings):
    return F.floor((s.percent * F.col("n") + 99) / 100)


def _active(reps: DataFrame, n: int, s: Settings) -> DataFrame:
    """row of the classes that pass the first filter."""
    tokens = lambda df: df.select("row", F.explode("pre").alias("tok"))
    count = _shared(tokens(reps), _hot(tokens, reps, n)).groupBy("row").agg(F.count("*").alias("own"))
    return count.join(reps.select("row", "n"), "row").filter(F.col("own") >= 1 + F.floor(_overlap(s) * WIDE / 100)).select("row")  # l of the smallest partner


def _keys(sets: DataFrame, sizes: DataFrame, n: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(tok, row, n, s: the shingles, rare ones first, through which a class may meet a partner; the hot tokens). s: shingles it
    shares with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in whole]), pa.int32()), pa.array(np.concatenate(whole)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row", "all"])

    tokens = lambda df: arrow_map(df.select("row", "set"), run, "row long, all array<long>").select("row", F.explode("all").alias("tok"))
    hot = _hot(tokens, sets, n)
    shared = _shared(tokens(sets), hot)
    by_row = shared.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("own"))  # bounded by the text
    count = F.size("own") - _overlap(s) + 1
    kept = by_row.join(sizes, "row").filter(count > 0)
    keys = kept.select("row", "n", F.size("own").cast("long").alias("s"), F.explode(F.slice("own", 1, count.cast("int"))).alias("k")).select(F.col("k.tok").alias("tok"), "row", "n", "s")
    return keys, hot


def _rest(met: DataFrame, star: DataFrame, labels: DataFrame, sets: DataFrame, hot: DataFrame, s: Settings) -> DataFrame:
    """Pairs, not in the star, of different components that share a key and may link by size, shared shingles and distance.

    The intersection has at most min(s) shingles, and the sets differ in at least as many as their parity maps do: both
    bound the similarity.
    A class that did not link with its key's centre, at distance d from it, meets the others of that key whose
    distance lies within 1 - t of d; of those that did link (at most 1 - t away) it meets none if d > 2 (1 - t). Where the
    filters refused the pair with the centre, its distance is unknown, and more than 1 - t.
    A key's rows that did not link are dealt out in blocks of about BLOCK, each with all its other rows.
    """
    band = 1 - s.percent / 100 + 1e-9
    star = star.select("a", F.col("b").alias("row"), "dist", F.coalesce("linked", F.lit(False)).alias("linked"))
    here = met.filter("row <> a").join(labels.select("row", F.col("root").alias("comp")), "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    here = here.join(star, ["a", "row"])
    open_keys = here.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.when(~F.col("linked"), 1)).alias("left")).filter("lo < hi and left > 0")
    open_keys = open_keys.select("tok", F.ceil(F.col("left") / BLOCK).cast("int").alias("blocks"))
    here = _routed(here, open_keys, hot).join(sets.select("row", "bits"), "row")
    here = written(here.select("tok", "row", "n", "s", "comp", "dist", "linked", "bits", "blocks"), "jaccard-open")
    x, y = (here.select("tok", "blocks", *[F.col(c).alias(f"{k}_{c}") for c in ("row", "n", "s", "comp", "dist", "linked", "bits")]) for k in "xy")
    x = x.filter("not x_linked").withColumn("block", F.pmod(F.xxhash64("x_row"), "blocks").cast("int")).drop("blocks")
    y = y.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    apart = sum(F.bit_count(F.get("x_bits", F.lit(i)).bitwiseXOR(F.get("y_bits", F.lit(i)))) for i in range(BITS // 64))
    fits = (
        (F.col("x_comp") != F.col("y_comp"))
        & (F.col("y_linked") | (F.col("x_row") < F.col("y_row")))
        & F.coalesce(F.abs(F.col("x_dist") - F.col("y_dist")) <= band, F.lit(True))
        & (100 * F.least("x_n", "y_n") >= s.percent * F.greatest("x_n", "y_n"))
        & ((100 + s.percent) * F.least("x_s", "y_s") >= s.percent * (F.col("x_n") + F.col("y_n")))
        & ((100 + s.percent) * (F.col("x_n") + F.col("y_n") - apart) >= 2 * s.percent * (F.col("x_n") + F.col("y_n")))
    )
    pairs = x.join(y, ["tok", "block"]).filter(fits)
    return pairs.select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b")).distinct()
