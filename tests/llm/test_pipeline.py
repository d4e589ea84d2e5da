"""The stages on a small corpus: columns kept, decisions taken, and the whole run."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_jaccard import brute


def folder(spark, tmp_path, docs):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(f"file://{tmp_path}/documents.parquet")
    cases.labels(spark).write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_stages(spark, tmp_path):
    d = folder(spark, tmp_path, cases.documents(spark))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, d)
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())
    once = corpus_pipeline.near_duplicates(spark, docs, d)
    assert {r.doc_id for r in once.collect()} == {i for i, _, c in brute(cases.rows(), 5, 80) if i is None or i == c}
    clean = corpus_pipeline.personal_data(spark, docs, d)
    assert clean.columns == docs.columns and all(r.text is None or r.n_chars == len(r.text) for r in clean.collect())
    assert not any("@mail.example.com" in (r.text or "") for r in clean.collect())
    mixed = corpus_pipeline.mix(spark, docs, d)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(docs.collect())


def test_run(spark, tmp_path):
    d = folder(spark, tmp_path, cases.documents(spark))
    got = corpus_pipeline.run(spark, d).collect()
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert got and max(fill.values()) <= 2048


def test_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, cases.empty(spark))).count() == 0


def test_mixing_keeps_a_corpus_without_toxic_documents(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 40 + id % 50), x -> concat('word', hash(id, x) % 500))) AS text", "'en' AS lang", "'web' AS source", "0 AS n_chars")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs.select("doc_id", F.lit(0).alias("toxic")).write.parquet(f"file://{tmp_path}/labels.parquet")
    d = f"file://{tmp_path}"
    mixed = corpus_pipeline.mix(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert [r.doc_id for r in mixed.select("doc_id").orderBy("doc_id").collect()] == list(range(3000))


def test_columns_that_have_the_names_of_helpers(spark, tmp_path):
    d = folder(spark, tmp_path, cases.documents(spark))
    names = ["_score", "_mix", "_copy", "_th", "root", "rate", "p", "t", "k", "n", "body", "_body", "_text", "piece", "length"]
    docs = spark.read.parquet(f"{d}/documents.parquet").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns[-len(names) :] == names
        assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in docs.collect())
    assert corpus_pipeline.pack(spark, docs, d).count() > 0


def test_stages_on_very_long_texts(spark, tmp_path):
    long = " ".join(f"word{i % 977} of the text" for i in range(60_000)) + " mail a.person@example.org"
    rows = [(1, long, "en", "web", len(long)), (2, long + " end", "en", "web", len(long) + 4), (3, "x" * 1_000_000, None, None, 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = folder(spark, tmp_path, docs)
    got = {}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in (("near", corpus_pipeline.near_duplicates), ("pii", corpus_pipeline.personal_data), ("mix", corpus_pipeline.mix)):
        docs = stage(spark, docs, d)
        got[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(got["near"]) == {1, 3}
    assert "a.person@example.org" not in got["pii"][1] and got["pii"][1].startswith(long[:1000])
    assert {1, 3} == set(got["mix"])
    assert sum(r.length for r in corpus_pipeline.pack(spark, docs, d).collect()) > 100_000
