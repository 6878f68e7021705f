from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenfold.llm import line_dedup


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: i is not None and len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != i
        keep = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def check(spark, rows):
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_lines string")
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(d).collect()]
    assert sorted(got, key=str) == brute(rows)


LINE = "All rights reserved."


def test_cases(spark):
    long = "\n".join([f"line number {k}" for k in range(3000)] + [LINE])
    check(spark, [(5, f"{LINE}\nown line of five\n{LINE}"), (3, f" {LINE.upper()}\t\nshort"), (7, None), (8, ""), (9, "\n\n"), (10, long), (11, long), (None, LINE), (3, LINE), (12, "short"), (13, "short"), (12, f"{LINE}x")])


def test_blanks(spark):
    blank = " \t\x0b\x0c\r"
    check(spark, [(1, f"{blank}a shared line{blank}"), (2, "A SHARED LINE"), (3, "\u00a0a shared line"), (4, "a" + " " * 200_000 + "b"), (5, "x" + blank * 3)])


def test_repeated_rows_hold_once(spark):
    check(spark, [(1, "only in document one"), (1, "only in document one")])


def test_empty_table(spark):
    check(spark, [])


def test_hot_line(spark):
    check(spark, [(k, f"{LINE}\nunique line {k}") for k in range(400)])


def test_three_documents(spark):
    d = spark.createDataFrame([(1, "in two documents\nin three documents"), (2, "in two documents\nin three documents"), (3, "in three documents")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(d, min_docs=3).collect()}
    assert got == {1: "in two documents\nin three documents", 2: "in two documents", 3: ""}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.sampled_from([LINE, " " + LINE.lower(), "tiny", "", "another shared line", "Ünïcode line é"]), max_size=6).map("\n".join)), max_size=8))
def test_like_brute_force(spark, rows):
    check(spark, rows)


def test_clashing_names_pass_through(spark):
    d = spark.createDataFrame([(1, f"{LINE}\nx", "a", "b"), (2, LINE, "a", "b")], "doc_id long, text string, _text_hash string, _Drops string")
    assert {(r.doc_id, r.text, r._text_hash, r._Drops) for r in line_dedup.dedup_lines(d).collect()} == {(1, f"{LINE}\nx", "a", "b"), (2, "", "a", "b")}
