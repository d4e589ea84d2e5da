"""Documents that try every edge: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, score double, tok string, word string, c int"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(["th", "er", "on", "ing", "ed", "a", "is", "of"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    base = words(r, 120)
    texts: list[str | None] = [None, "", " \t\n", "one", "Two WORDS", "ünï cödé ① \U0001f600 end", "x" * 5000, "a b c d e " * 400]
    texts += [" ".join(base)] * 4
    for k in (1, 2, 3, 8, 30):
        t = list(base)
        for i in r.sample(range(len(t)), k):
            t[i] = f"edit{k}{i}"
        texts.append(" ".join(t))
    texts += ["mail bob.b@mail.example.com or +1 (202) 555-0143, host 10.0.0.1, card 4111 1111 1111 1111.", "line one here\nline one here\nother # $ %", "Café " + " ".join(base[:50]).upper()]
    texts += [" ".join(words(r, r.randint(3, 200))) for _ in range(n - len(texts))]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 2}", None if t is None else len(t), 1, 0.5, "t", "w", 3) for i, t in enumerate(texts)]
    out.append(out[8])  # a row repeated as it is
    out.append((None, "no id but text of four words", None, None, None, None, None, None, None, None))
    return out


def documents(spark: SparkSession, **k) -> DataFrame:
    return spark.createDataFrame(rows(**k), SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, None if i == 7 else int(i % 4 > 0), None if i == 9 else int(i % 6 == 0)) for i in range(60)] + [(None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
