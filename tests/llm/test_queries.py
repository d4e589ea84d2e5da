"""The queries as they are registered, with their production settings, against brute force on a whole small table."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessel.llm.queries import QUERIES
from tests.llm import test_pii

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, d=SF):
    return [r.asDict() for r in QUERIES[name](spark, d).collect()]


def held(i, of):
    return zlib.crc32(str(i).encode()) % of == 0


def test_op1(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if not held(i, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    got = rows(spark, "op1_lm_scoring", d)
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 10), len(ws), sum(w in count for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    out = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op2(spark, texts):
    got = rows(spark, "op2_personal_data")
    assert len(got) == len(texts)
    for r in got:
        base = sorted(test_pii.brute(texts[r["doc_id"]] or ""), key=lambda s: s[:2])
        kinds = ("email", "ip", "card", "phone")
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == j for s in base) for j in range(4)]
        digest = ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert set(filter(None, digest.split(","))) <= set(r["spans"].split(","))


def test_op4(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            want.add((i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())))
    got = rows(spark, "op4_packing")
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:j]) for j in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(places) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1


def test_op7(spark, texts):
    got = rows(spark, "op7_sharding")
    assert len(got) == len(texts) and {r["law"] for r in got} == {"rows"}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), None)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots.get(k, [])) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, texts):
    got = rows(spark, "op9_mixing")
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        assert r["p_sound"] + r["p_poor"] + r["p_toxic"] == pytest.approx(1) and r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1)
        assert r["tokens"] == len((texts[r["doc_id"]] or "").encode().split())
    total = sum(r["tokens"] for r in got)
    assert sum(r["tokens"] * r["rate"] for r in got) == pytest.approx(total, rel=0.05)


def test_op10(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = rows(spark, "op10_quality_classifier", d)
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"], 5) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    asked = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(y == p for y, p in asked) >= 0.9 * len(asked) and len(asked) > 30
