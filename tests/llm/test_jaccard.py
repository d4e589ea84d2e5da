import random

import pytest

from tessel.llm import jaccard
from tests.llm import cases


def brute(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i), r[0])) for i, r in enumerate(rows)), key=repr)


def near(seed, percent_edits):
    """A cluster with chains: copies of copies with edits, beside passages shared by texts that are not alike."""
    r = random.Random(seed)
    passage = cases.words(r, 40)
    out, texts = [], [cases.words(r, 150)]
    for _ in range(40):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, percent_edits)):
            t[r.randrange(len(t))] = f"e{r.random()}"
        texts.append(t)
    texts += [cases.words(r, 30) + passage + cases.words(r, 30) for _ in range(25)]
    texts += [[f"x{r.randint(0, 3)}"] * r.randint(1, 30) for _ in range(20)]
    for i, t in enumerate(texts):
        out.append((i, " ".join(t), None, None, None, None, None, None, None, None))
    return out


@pytest.mark.parametrize("k, percent, edits", [(4, 85, 4), (5, 80, 8), (2, 60, 20)])
def test_components_are_exact(spark, k, percent, edits):
    rows = near(k, edits)
    got = jaccard.classes(spark.createDataFrame(rows, cases.SCHEMA), jaccard.Settings(k, percent))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k, percent)


def test_edge_cases(spark):
    rows = cases.rows()
    got = jaccard.classes(cases.documents(spark), jaccard.Settings(4, 85)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4, 85)


def test_one_of_each_group_stays(spark):
    docs = cases.documents(spark)
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    expected = {d for d, _, c in brute(cases.rows(), 5, 80) if d is None or d == c}
    assert set(ids) == expected and len(ids) == len(set(ids))


def test_rows_with_repeated_and_missing_ids(spark):
    r = random.Random(4)
    a, b, c = (" ".join(cases.words(r, 60)) for _ in range(3))
    near_a = a + " more"
    rows = [(3, a), (5, a), (5, b), (5, b), (3, near_a), (None, a), (None, a), (7, c), (8, None), (8, None), (9, " "), (2, near_a)]
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, th int, root int, key int")
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr)
    assert got == sorted([(2, near_a), (5, b), (None, a), (None, a), (7, c), (8, None), (8, None), (9, " ")], key=repr)


def test_filters_refuse_pairs_before_sets_are_attached(spark):
    """Pairs that pass: those of the candidates whose sizes and prefixes under both hash orders allow a link; no link is lost."""
    s = jaccard.Settings(1, 80)
    sets = {i: jaccard.np.sort(jaccard.np.random.default_rng(i % 4).integers(0, 2**63, 100 + i).astype(jaccard.np.uint64)) for i in range(12)}
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "row long, set binary")
    pairs = [(i, j) for i in sets for j in sets if i < j]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {tuple(r) for r in jaccard.intersected(df, len(pairs), table, s).collect()}
    many = {tuple(r) for r in jaccard.intersected(df, 10**9, table, s).collect()}  # sets too many to send to all executors
    links = {tuple(r)[:2] for r in jaccard.verified(df, len(pairs), table, s).filter("linked").collect()}
    assert got == many and links <= got and len(got) < len(pairs)
    brute = set()
    for i, j in pairs:
        x, y = sets[i], sets[j]
        least = min(s.depth(len(x)), s.depth(len(y)))
        common = [len(set(x[p].tolist()) & set(y[q].tolist())) for p, q in ((slice(s.prefix(len(x))), slice(s.prefix(len(y)))), (slice(-s.prefix(len(x)), None), slice(-s.prefix(len(y)), None)))]
        if 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and min(common) >= least:
            brute.add((i, j))
    assert got == brute


def test_empty_table(spark):
    assert jaccard.classes(cases.empty(spark)).count() == 0
    assert jaccard.deduplicated(cases.empty(spark)).count() == 0
