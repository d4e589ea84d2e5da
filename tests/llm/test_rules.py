import re
from collections import Counter

from pyspark.sql import functions as F

from tessel.llm import rules
from tests.llm import cases


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics(spark):
    docs = cases.documents(spark)
    got = rules.judged(docs, ["doc_id"]).collect()
    text = {r[0]: r[1] for r in cases.rows()}
    assert len(got) == docs.count()
    for r in got:
        want = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_order_changes_no_verdict_and_cheap_rejections_come_first(spark):
    docs = cases.documents(spark)
    t = rules.Text(F.coalesce(F.col("text"), F.lit("")))
    names = list(rules.RULES)
    verdicts = [sorted(docs.select("doc_id", rules.cascade(t, rules.RULES, o).isNull().alias("k")).collect(), key=repr) for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]
    plan = rules.planned(docs, {"never": lambda t: t.n_words < 0, "often": lambda t: t.n_words < 1000})
    assert [n for n, _, _ in plan] == ["often", "never"]


def test_with_and_without_figures(spark):
    docs = cases.documents(spark)
    a, b = (sorted((r.doc_id or -1, r.kept) for r in rules.judged(docs, ["doc_id"], figures=f).collect()) for f in (True, False))
    assert a == b


def test_each_rule_rejects_what_it_is_for(spark):
    prose = "The quick brown fox jumps over the lazy dog while seven other animals of the forest look on. "
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} lies" for i in range(80))
    texts = {
        "few_words": "only three words", "repetition": "one two three four five six " * 40, "symbols": "# $ % & " * 9 + prose, "short_words": " ".join(f"{a} {b}" for a in "abcdefghij" for b in "klmnopqrst"),
        "long_words": " ".join("x" * 25 + chr(97 + i) for i in range(26)), "few_letters": " ".join(f"12{i} {i * i}.{i}" for i in range(40)),
        "duplicate_lines": "\n".join(["same line"] * 9 + [f"other{i}" for i in range(4)]),
        "bullets": "\n".join(f"- point number {i} of a list" for i in range(12)), "ellipses": "\n".join(f"sentence number {i} breaks off ..." for i in range(9)),
        "few_distinct": "one two three four five six seven " * 10,
    }
    t = rules.Text(F.col("t"))
    df = spark.createDataFrame([*texts.items(), ("sound", prose), ("sound2", long)], "name string, t string")
    for r in df.select("name", *[F.coalesce(rule(t), F.lit(False)).alias(n) for n, rule in rules.RULES.items()]).collect():
        hit = {n for n in rules.RULES if r[n]}
        assert (r.name in hit) if r.name in rules.RULES else not hit, (r.name, hit)


def test_later_rules_are_not_evaluated_for_rejected_texts(spark):
    """The dear rule fails on any text that it sees: the cascade must reject those before."""
    dear = lambda t: F.assert_true(~t.text.startswith("bad")).isNotNull()
    df = spark.createDataFrame([("bad text",), ("good text " * 20,), ("bad again",)], "text string")
    t = rules.Text(F.col("text"))
    got = df.select(rules.cascade(t, {"few_words": rules.RULES["few_words"], "dear": dear}, ["few_words", "dear"]).alias("by")).collect()
    assert [r.by for r in got] == ["few_words", None, "few_words"]


def test_the_sample_is_from_the_whole_table(spark):
    docs = spark.range(20_000).select(F.concat(F.lit("text "), F.col("id")).alias("text"), F.col("id"))
    got = [int(r[0].split()[1]) for r in rules.sampled(docs, "text", 1000).collect()]
    assert 800 < len(got) < 1200 and min(got) < 500 and max(got) > 19_500


def test_no_python_and_no_shuffle(spark):
    plan = rules.judged(cases.documents(spark), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert rules.judged(cases.empty(spark), ["doc_id"]).count() == 0
