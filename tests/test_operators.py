import datetime as dt

from pyspark.sql import functions as F

from tessel.operators import relational as rel
from tessel.streaming import windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 20), (4, None, None)], "id int, g string, v int")
    assert rows(rel.distinct_on(df, ["g"], [rel.ordered("v", True)])) == [(2, "a", 20), (3, "b", 20), (4, None, None)]
    assert [r.id for r in rel.with_ties(df, 2, [("v", True)]).collect()][0] == 4
    assert len(rel.with_ties(df.filter("v IS NOT NULL"), 1, [("v", True)]).collect()) == 2
    got = rel.groups_frame(F.sum("v"), [], "v", 1, 0, df, "s").select("id", "s")
    assert rows(got) == [(1, 10), (2, 50), (3, 50), (4, 40)]
    assert rows(rel.rollup_with_total(df.filter("false"), ["g"], F.count("*").alias("n"))) == [(None, 0)]
    assert len(rows(rel.rollup_with_total(df, ["g"], F.count("*").alias("n")))) == 4


def test_upsert_and_as_of(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string")
    assert rows(rel.upsert(t, new, ["k"], None)) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(rel.upsert(t, new, ["k"], {"v": F.col("new.v")})) == [(1, "a"), (2, "z"), (3, "c")]
    quotes = spark.createDataFrame([("x", 1, 10), ("x", 5, 50)], "s string, t int, q int")
    trades = spark.createDataFrame([("x", 0), ("x", 1), ("x", 7), ("y", 3)], "s string, t int")
    assert rows(rel.as_of(trades, quotes, ["s"], "t", ["q"])) == [("x", 0, None), ("x", 1, 10), ("x", 7, 50), ("y", 3, None)]


def test_as_of_with_one_hot_key(spark):
    """Whatever the number of stretches, and with ties at their edges, the result is that of a loop."""
    trades = [("hot" if i % 10 else "cold", i // 3) for i in range(200)] + [(None, 5), ("none", 9)]
    quotes = [("hot", t, t * 10) for t in (0, 7, 7 + 20, 40)] + [("cold", 30, 1), (None, 3, 2)]
    want = []
    for s, t in trades:
        found = [q for k, u, q in quotes if k == s and u <= t]
        want.append((s, t, found[-1] if found else None))
    a, b = spark.createDataFrame(trades, "s string, t int"), spark.createDataFrame(quotes, "s string, t int, q int")
    for split in (1, 2, 32):
        assert rows(rel.as_of(a, b, ["s"], "t", ["q"], split)) == sorted(want, key=repr)


def test_windows_in_batch_and_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(t0 + dt.timedelta(minutes=m), "u", m) for m in (0, 1, 6, 30)]
    df = spark.createDataFrame(data, "ts timestamp, u string, v int")
    batch = windows.tumbling(df, "ts", "5 minutes", ["u"], F.count("*").alias("n"))
    assert sorted(r.n for r in batch.collect()) == [1, 1, 2]
    assert sorted(r.n for r in windows.sessions(df, "ts", "10 minutes", ["u"], F.count("*").alias("n")).collect()) == [1, 3]
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "ts", "5 minutes", ["u"], F.count("*").alias("n")).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 1, 2]
