import zlib
from collections import Counter

import numpy as np
import pytest

from tessel.llm import sharding
from tests.llm import cases


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 1000, 65537])
def test_permutation_and_its_inverse(n):
    x = np.arange(n)
    p = sharding.permuted(x, n, 7)
    assert sorted(p) == list(x) and (sharding.permuted(p, n, 7, inverse=True) == x).all()
    shard, slot = sharding.place(x, n, 40, 7)
    assert (sharding.row_at(shard, slot, n, 40, 7) == x).all()


def test_shards_are_gapless_even_and_reproducible(spark):
    docs, data = cases.documents(spark), cases.rows()
    got = sharding.sharded(docs, 7).collect()
    again = sharding.sharded(docs.repartition(5), 7).collect()
    key = lambda r: repr((r.doc_id, r.size, r.text_crc32, r.shard, r.slot))
    assert sorted(map(key, got)) == sorted(map(key, again))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_empty_table(spark):
    assert sharding.sharded(cases.empty(spark), 40).count() == 0
