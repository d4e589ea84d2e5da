"""The queries of this subpackage: each applies its operator, with production settings, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import ann, cnn, jaccard, lm, mixing, packing, pii, rules, sharding, warc
from tessel.llm.shared import remainder, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 10) == 0).alias("held_out"))
    part = F.floor(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / 10)
    model = lm.fit(docs.filter("not held_out"), part=part)
    return lm.score(docs, model, ["doc_id", "held_out"])


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.found(docs, pii.fit(docs), ["doc_id"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), jaccard.Settings(words=4, percent=85))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), ["doc_id"]).drop("rejected_by", "n_distinct")


#: Shares of all tokens that the mix should have of each domain of the labelled table.
TARGETS = {"sound": 0.95, "poor": 0.01, "toxic": 0.04}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table; a null label counts as unknown."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "sound")
    return labels.select("doc_id", domain.alias("domain"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    p = cnn.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return cnn.scored(docs, p, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_personal_data": op2_personal_data,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLES: dict[str, str] = {
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], chr(10)))
            WHEN len(ws) > 0 THEN [array_to_string(ws, chr(10))] ELSE [] END) AS k FROM w),
        n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.c + ny.c - i)),
        r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT w.doc_id, CAST(coalesce(any_value(n.c), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
        FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op8_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls FROM w),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], chr(10)) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM d) GROUP BY doc_id),
        t AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
          CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
          CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, x, ws, string_split(x, chr(10)) AS al FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
        m AS (SELECT *, len(list_filter(al, lambda v: regexp_matches(v, '^[ \t]*([-*]|\x{2022})'))) AS nb, len(list_filter(al, lambda v: regexp_matches(v, '(\.\.\.|\x{2026})[ \t\r]*$'))) AS ne FROM t)
        SELECT * EXCLUDE (x, ws, al, nb, ne), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
          NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_words / 5)
            OR word_chars < 2 * n_words OR word_chars > 18 * n_words OR 10 * length(regexp_replace(x, '[^A-Za-z\x{80}-\x{10FFFF}]+', '', 'g')) < 3 * word_chars
            OR (len(al) > 1 AND nb >= 3 AND 10 * nb > 9 * len(al)) OR (len(al) > 1 AND ne >= 3 AND 10 * ne > 5 * len(al))
            OR (n_words >= 50 AND len(list_distinct(ws)) < 10)) AS kept FROM m""",
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
          CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (d)""",
}
