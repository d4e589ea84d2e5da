"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition on a text that rejects it. On a bounded sample of texts, chosen by hash, the cascade measures what
share each rule rejects and how long it takes to evaluate on the text, orders the rules by rejection per cost, and
evaluates them as one CASE, whose branches Spark evaluates in turn: for a text that an early rule rejects, what later rules
would compute from it is never computed. The order changes the cost alone; the verdict is the same under any order.

Figures of the text that a caller asks for beside the verdict are computed for every row, and rules read them at no cost;
all other rules compute theirs inside the CASE.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, where a column's expression would be repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    found = let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    return F.when(F.instr(text, "\n") > 0, found).otherwise(F.lit(0).cast("long"))


def repeated_words(w: Column, distinct: Column, n: int = 5) -> Column:
    """Words in windows of n words that occur twice or more in the text, the first occurrence included. w: the words; distinct:
    how many different ones.

    Windows are compared by 64-bit hash. Where a window occurs again, each of its words has occurred before, so texts with
    fewer than n repeated words stop at once. Texts whose windows are all distinct, nearly all others, stop there; in the
    rest (hash, place) pairs are sorted, neighbours compared, and the union of the windows' ranges is summed.
    """

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            at = F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
            return let(F.sort_array(at), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x).cast("long"))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(pairs, twice))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    return F.when((F.size(w) <= n) | (F.size(w) - distinct < n), F.lit(0).cast("long")).otherwise(let(grams, covered))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and the FIGURES of each text, in one scan; its words are cut once."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(w: Column, d: Column) -> Column:
        chars = F.length(F.array_join(w, "")).cast("long")
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), d.cast("long").alias("n_distinct"), repeated_words(w, d).alias("n_repeat_words"))

    stats = let(words(t), lambda w: let(distinct(w), lambda d: of_words(w, d)))
    found = docs.select(*keep, stats.alias("s"), symbols(t).alias("n_symbols"), duplicate_lines(t).alias("n_dup_lines"))
    return found.select(*keep, "s.n_words", "s.word_chars", "n_symbols", "n_dup_lines", "s.n_repeat_words", "s.n_distinct")


def distinct(w: Column) -> Column:
    return F.size(F.array_distinct(w))


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


#: The figures that statistics() computes, each from a text (never null).
FIGURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)).cast("long"),
    "word_chars": lambda t: F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
    "n_symbols": symbols,
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": lambda t: let(words(t), lambda w: repeated_words(w, distinct(w))),
    "n_distinct": lambda t: distinct(words(t)).cast("long"),
}


class Text:
    """What rules ask of a text: its figures, by name, from columns where there are some, else computed where asked."""

    def __init__(self, text: Column, known: dict[str, Column] | None = None):
        self.text, self.known = text, known or {}

    def __getattr__(self, figure: str) -> Column:
        if figure not in FIGURES:
            raise AttributeError(figure)
        return self.known[figure] if figure in self.known else FIGURES[figure](self.text)


Rules = dict[str, Callable[[Text], Column]]


def _lines(t: Text, body: Callable[[Column], Column]) -> Column:
    """body of the lines; false for a text of a single line, which isn't cut."""
    return F.when(F.instr(t.text, "\n") > 0, let(F.split(t.text, "\n"), body)).otherwise(F.lit(False))


def _mostly(lines: Column, pattern: str, tenths: int) -> Column:
    """Three lines or more are like the pattern, and more than so many tenths of all."""
    return let(F.size(F.filter(lines, lambda x: x.rlike(pattern))), lambda n: (n >= 3) & (10 * n > tenths * F.size(lines)))


#: Bounds after the published heuristics for web text, on the lenient side.
RULES: Rules = {
    "few_words": lambda t: t.n_words < 10,
    "repetition": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "duplicate_lines": lambda t: let(t.n_dup_lines, lambda n: (n >= 3) & (10 * n > 3 * t.n_words / 5)),
    "short_words": lambda t: t.word_chars < 2 * t.n_words,
    "long_words": lambda t: t.word_chars > 18 * t.n_words,
    "few_letters": lambda t: 10 * F.length(F.regexp_replace(t.text, r"[^A-Za-z\x{80}-\x{10FFFF}]+", "")) < 3 * t.word_chars,
    "bullets": lambda t: _lines(t, lambda a: _mostly(a, r"^[ \t]*([-*]|\x{2022})", 9)),
    "ellipses": lambda t: _lines(t, lambda a: _mostly(a, r"(\.\.\.|\x{2026})[ \t\r]*$", 5)),
    "few_distinct": lambda t: (t.n_words >= 50) & (t.n_distinct < 10),
}


def cascade(text: Text, rules: Rules, order: list[str] | None = None) -> Column:
    """The name of the first rule, in the given order, that rejects the text; null if none does. A null condition passes."""
    found = None
    for name in order or list(rules):
        found = F.when(rules[name](text), F.lit(name)) if found is None else found.when(rules[name](text), F.lit(name))
    return F.lit(None).cast("string") if found is None else found


def planned(sample: DataFrame, rules: Rules, text: str = "text", known: list[str] = (), repeats: int = 2) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds on the sample) by falling rejection per cost.

    sample: small and already written, with the texts and the known figures. A rule's cost is the shortest of its runs
    less that of a run that only reads.
    """
    t = Text(F.coalesce(F.col(text), F.lit("")), {n: F.col(n) for n in known})
    read = F.sum(F.length(t.text) + F.lit(0))

    def run(*what: Column) -> tuple[float, float]:
        spent, share = [], 0.0
        for _ in range(repeats):
            began = time.perf_counter()
            share = sample.agg(read, *what).first()[-1]
            spent.append(time.perf_counter() - began)
        return min(spent), share or 0.0

    run()  # the first job compiles and warms up
    base, _ = run()
    found = []
    for name, rule in rules.items():
        spent, share = run(F.avg(F.when(rule(t), 1.0).otherwise(0.0)))
        found.append((name, share, max(spent - base, 1e-3)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0]))


def sampled(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About `rows` texts at most, chosen by hash over the whole table, not from its first part."""
    n = docs.count()
    some = docs.select(F.coalesce(F.col(text), F.lit("")).alias(text))
    return some if n <= rows else some.filter(F.pmod(F.xxhash64(text, F.lit(41)), F.lit(1 << 30)) < F.lit(int((1 << 30) * rows / n)))


def judged(docs: DataFrame, keep: list[str], text: str = "text", rules: Rules = RULES, sample_rows: int = 2000, figures: bool = True) -> DataFrame:
    """The kept columns, with figures the statistics and base_failed, and rejected_by and kept.

    Null and empty texts have no words and fail. Repeated rows are judged alike; other columns do not matter; an empty
    table gives an empty result. Rules are ordered on about sample_rows texts, by hash; that decides the order alone.
    With figures all of them are computed for every row, and the rules that read only these cost nothing more.
    """
    some = sampled(docs, text, sample_rows)
    known = list(FIGURES) if figures else []
    sample = written(statistics(some, [text], text) if figures else some, "rules-sample")
    order = [n for n, _, _ in planned(sample, rules, text, known)]
    body = "_text_" + uuid.uuid4().hex
    rows = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    rows = statistics(rows, [*keep, body], body) if figures else rows.select(*keep, body)
    found = rows.withColumn("rejected_by", cascade(Text(F.col(body), {n: F.col(n) for n in known}), rules, order)).drop(body)
    if not figures:
        return found.withColumn("kept", F.col("rejected_by").isNull())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
