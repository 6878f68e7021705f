from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import quality, queries
from lumenfold.llm.common import words

SEP = r"[^\x20\x09-\x0D]+"


def brute(text):
    w = re.findall(SEP, text or "")
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(SEP, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h " * 3, "x " * 40, " ".join(map(str, range(5000))) + " " + " ".join(map(str, range(20))), "l1 word\n\nl1 word\n \nl1 word ", "a b # | <x> 😀é", "a b c d e f g h i a b c d e f g h j", " nbsp stays one"]


def test_statistics(spark, docs):
    got = quality.with_statistics(docs(TEXTS)).orderBy("doc_id").collect()
    assert [(r.stats.n_words, r.stats.word_chars, r.stats.n_symbols, r.stats.n_dup_lines, r.stats.n_repeat_words) for r in got] == [brute(t) for t in TEXTS]


def test_base_rule_and_repeated_rows(spark, docs):
    twice = docs(TEXTS).unionByName(docs(TEXTS))
    got = quality.apply_rules(twice, []).select("doc_id", "base_failed", "kept", "rule").collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        n, *_, repeated = brute(TEXTS[r.doc_id])
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        assert r.kept == (not r.base_failed) and r.rule is None


def test_covering_finds_the_thresholds():
    cells = [({"a": a, "b": b}, int(a > 50 or b > 70), int(not (a > 50 or b > 70))) for a in range(0, 100, 7) for b in range(0, 100, 7)]
    rules = quality.learn_rules(cells, ["a", "b"])
    wrong = sum(any(r.covers(row) for r in rules) != bool(bad) for row, bad, _ in cells)
    assert rules and wrong <= 0.05 * len(cells)


@pytest.mark.parametrize("cells", [[], [({"a": 1}, 0, 5)], [({"a": 1}, 5, 0)], [({"a": 1}, 3, 3)]])
def test_covering_without_contrast(cells):
    for rule in quality.learn_rules(cells, ["a"]):
        assert rule.conditions


def test_learned_list_applies(spark, docs):
    good = ["word " + " ".join(f"w{k}x{j}" for j in range(30)) for k in range(40)]
    bad = [" ".join(f"w{k}x{j}###" for j in range(30)) for k in range(40)]
    d = docs(good + bad)
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(0, 80, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    rules = quality.quality_rules(d, labels)
    kept = {r.doc_id for r in quality.apply_rules(d, rules).filter("kept").collect()}
    assert rules and kept == set(range(40))


def test_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(docs(TEXTS), labels) == []
    assert quality.apply_rules(docs([]), quality.quality_rules(docs([]), labels)).count() == 0


def test_the_conditional_is_the_rule_list(spark):
    """The CASE expression against the rules read one after another, on sf0.001 and a list of every kind of condition."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = quality.quality_rules(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    c = quality.Condition
    made = [quality.Rule((c("symbols", True, 100), c("line_words", False, 9000))), quality.Rule((c("word_length", False, 4500),), keep=True), quality.Rule((c("capitals", True, 20), c("marks", False, 50), c("repeats", False, 10)))]
    for rules in (learned, made):
        cols = quality.features()
        got = quality.apply_rules(docs.select("doc_id", "text"), rules).select("rule", "kept", "base_failed", *(x.alias(n) for n, x in cols.items())).collect()
        for r in got:
            first = next((k for k, rule in enumerate(rules, 1) if rule.covers(r.asDict())), None)
            assert r.rule == first
            assert r.kept == (not r.base_failed and (first is None or rules[first - 1].keep))
    assert len({r.rule for r in got}) > 2


def test_clashing_names_pass_through(spark, docs):
    d = docs(TEXTS).selectExpr("doc_id", "text", "'a' AS _w", "'b' AS _L", "'c' AS n_words")
    got = quality.apply_rules(d, []).collect()
    assert all((r._w, r._L, r.n_words) == ("a", "b", "c") for r in got) and len(got) == len(TEXTS)


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 8, 9, 13])
def test_repeated_windows_of_any_width(spark, docs, width):
    def covered(text):
        w = re.findall(SEP, text or "")
        at = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
        c = Counter(at)
        return len({j for k, x in enumerate(at) if c[x] > 1 for j in range(k, k + width)})

    texts = [*TEXTS, "a b a b a b a b c " * 2, "b a " * 9 + "a", " ".join("ab"[k * k % 7 % 2] for k in range(60)), "ab c a bc " * 2, " ".join(map(str, range(width))), " ".join(map(str, range(width - 1))) * 2]
    got = docs(texts).select("doc_id", quality.repeated_window_words(words(F.col("text")), width).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in got] == [covered(t) for t in texts]


def test_stutters_and_distinct_words(spark, docs):
    got = quality.with_statistics(docs(TEXTS)).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS):
        w = re.findall(SEP, t or "")
        assert (r.stats.n_distinct_words, r.stats.n_stutters) == (len(set(w)), sum(x == y for x, y in zip(w, w[1:])))


@pytest.mark.parametrize("only", [queries.COUNTS, ("n_words",), ("n_lines", "n_digits"), ("n_symbols",)])
def test_only_counts_that_are_asked_for(spark, docs, only):
    some, every = quality.with_statistics(docs(TEXTS), only=only), quality.with_statistics(docs(TEXTS))
    assert set(some.schema["stats"].dataType.names) == set(only)
    counts = [f"stats.{n}" for n in only]
    assert some.select("doc_id", *counts).orderBy("doc_id").collect() == every.select("doc_id", *counts).orderBy("doc_id").collect()


def test_quality_statistics_work_per_word(spark):
    """No window reads all its words, no sort compares by a lambda, and no count is computed that isn't returned."""
    plan = queries.quality_statistics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "n_repeat_words" in plan and "xxhash64" in plan
    assert not re.search(r"xxhash64\(slice|array_sort|n_stutters|n_distinct_words", plan)
