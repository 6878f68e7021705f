"""Embedding and document near-dedup, and connected components, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import components as by_rounds
from lumenfold.llm import embedding_dedup, near_dedup
from lumenfold.llm.common import whole_groups
from lumenfold.llm.components import _least, _meet, connected_components


def components(vertices, links):
    up = {v: v for v in vertices}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 300)], [(5, 9), (9, 5), (5, 9), (2, 9), (100, 101)]])
def test_components(spark, links):
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == components({v for x in real for v in x}, real)


def test_random_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert got == components({v for x in real for v in x}, real)


@pytest.mark.parametrize("hub", [0, 5000])
def test_a_hub_is_dealt_out(spark, hub):
    """A vertex with nearly all edges, as the smallest and as the largest of its component."""
    links = [(hub, k) for k in range(1, 3000)] + [(9000 + k, 9001 + k) for k in range(20)]
    d = spark.createDataFrame(links, "a long, b long").repartition(8)
    assert {r.vertex: r.component for r in connected_components(d).collect()} == components({v for x in links for v in x}, links)
    seen = d.unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = [max(r["count"] for r in _meet(seen, _least(seen), t).groupBy(F.spark_partition_id()).count().collect()) for t in (None, 2 * len(links))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most[1] < 2000 < 2999 < most[0]


@pytest.mark.parametrize(("links", "rounds"), [([(0, k) for k in range(1, 9)] + [(20, 21), (21, 20), (20, 22)], 0), ([(0, 1), (1, 2)], 1), ([(0, 2), (1, 2), (2, 3)], 1)])
def test_stars_need_no_round(spark, monkeypatch, links, rounds):
    """Edges that are stars around least vertices are the result: neither made again nor confirmed by a round."""
    star, calls = by_rounds._star, []
    monkeypatch.setattr(by_rounds, "_star", lambda *x: calls.append(1) or star(*x))
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components({v for x in links for v in x}, links)
    assert len(calls) == 2 * rounds


# ---------------------------------------------------------------- embeddings


def embedding_truth(rows):
    n, links = {}, []
    ok = [(i, np.array(v, dtype=float), y) for i, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, *_ in rows:
        n.setdefault(i, 0)
    for k, (i, v, y) in enumerate(ok):
        for j, w, z in ok[:k]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links.append((i, j))
                n[i] += 1
                n[j] += 1
    return n, components([i for i, *_ in rows], links)


@pytest.mark.parametrize("block", [4, 1024])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    rows = [(k, (centres[k % 5] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.12).tolist(), k % 2) for k in range(150)]
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(6)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, rows[1][1], None), (305, [float("inf")] * 16, 1), (306, [], 1), (307, [1.0, 2.0], 1), (308, [2.0, 4.0], 1)]
    d = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, n_links string")
    n, c = embedding_truth(rows)
    got = embedding_dedup.near_dedup(d, block=block, recall=0.9999999).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], c[i], c[i] == i) for i in n}
    assert len(got) == len(rows)


def rows_truth(rows):
    """(vec_id, n_links, component_id) row by row: a row is a vector of its own, whatever its id."""
    ok = [k for k, (_, v, y) in enumerate(rows) if v and y is not None and any(v)]
    links = [(j, k) for k in ok for j in ok if j < k and rows[j][2] == rows[k][2] and len(rows[j][1]) == len(rows[k][1]) and np.dot(rows[j][1], rows[k][1]) / np.sqrt(np.dot(rows[j][1], rows[j][1]) * np.dot(rows[k][1], rows[k][1])) >= 0.98]
    part = components(range(len(rows)), links)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[part[k]] = min(least.get(part[k], i), i)
    n = [sum(k in x for x in links) for k in range(len(rows))]
    return sorted(((rows[k][0], n[k], least.get(part[k])) for k in range(len(rows))), key=str)


def test_repeated_and_null_vec_ids(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 12))
    rows = [(int(rng.integers(0, 25)) if rng.random() < 0.8 else None, (centres[k % 4] + rng.normal(size=12) * 0.1).tolist(), k % 2) for k in range(80)]
    rows += [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (1, [1.0, 0.0], 0), (None, [5.0, 5.0, 5.0], 1), (None, [5.0, 5.0, 5.0], 1), (None, None, 1), (7, None, None), (7, [], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_dedup(d, block=8, recall=0.9999999).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == rows_truth(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_sign_bits_pass_every_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    for rows in (100, 10**6):
        bits, tables = embedding_dedup.plan_tables(rows, 0.98, 0.99999)
        n, limit = bits * tables, embedding_dedup.most_apart(0.98, bits * tables)
        x = rng.normal(size=(20_000, n))
        y = 0.98 * x + math.sqrt(1 - 0.98**2) * rng.normal(size=x.shape)  # projections of a pair at the threshold
        assert ((x > 0) != (y > 0)).sum(axis=1).max() <= limit < n / 2


def test_no_embeddings(spark):
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tables_follow_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = embedding_dedup.plan_tables(n, 0.98, 0.999)
        meet = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - meet) ** tables <= 0.001 < (1 - meet) ** (tables - 1)


# ---------------------------------------------------------------- documents


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def document_truth(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    return dict(sets), components([i for i, _ in rows if i is not None], links)


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(30))
    bases = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(6)]
    texts = [None, "", " \n", "one", "ONE", "one two", "One\ttwo", "the the the the", "THE the the the the"]
    for b in bases:
        texts += near_copies(rng, b, 12, 4)
    texts += near_copies(rng, bases[0], 60, 9)
    texts += [" ".join(word() for _ in range(40)) for _ in range(40)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("width", "percent", "node_rows", "depth"), [(3, 85, 512, 4), (5, 80, 4, 2), (3, 85, 3, 1)])
def test_documents(spark, width, percent, node_rows, depth):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    sets, c = document_truth(rows, width, percent)
    got = near_dedup.near_dedup(d, width=width, percent=percent, node_rows=node_rows, depth=depth).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c[i], c[i] == i) for i in c}


@pytest.mark.parametrize(("least", "items"), [(0, 1 << 22), (0, 300), (70, 1)])
def test_no_link_rests_on_the_sketch_alone(spark, monkeypatch, least, items):
    """Sketches that let (nearly) everything through: stars, forests and nodes are still exact, in any number of parts."""
    monkeypatch.setattr(near_dedup, "least_agreement", lambda percent: least)
    monkeypatch.setattr(near_dedup, "ITEMS_TOGETHER", items)
    rows = corpus()
    sets, c = document_truth(rows, 3, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, node_rows=3, depth=1).collect()
    assert {r.doc_id: r.component_id for r in got} == c


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_nodes_of_all_levels_are_compared_in_one_pass(spark, monkeypatch, depth):
    """One pass for all small nodes and one for those that stay large, however deep; few tables are written."""
    calls, written = [], []
    candidates, write = near_dedup._candidates_of, near_dedup.materialise
    monkeypatch.setattr(near_dedup, "_candidates_of", lambda *x: calls.append(1) or candidates(*x))
    monkeypatch.setattr(near_dedup, "materialise", lambda x: written.append(1) or write(x))
    rows = corpus()
    sets, c = document_truth(rows, 3, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, node_rows=3, depth=depth).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), c[i]) for i in c}
    assert len(calls) == 2 and len(written) <= 22


@pytest.mark.parametrize("together", [1, 3])
def test_documents_of_many_pairs_are_met_in_several_places(spark, monkeypatch, together):
    monkeypatch.setattr(near_dedup, "PAIRS_TOGETHER", together)
    rows = corpus()
    c = document_truth(rows, 3, 85)[1]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85, node_rows=3, depth=2).collect()
    assert {r.doc_id: r.component_id for r in got} == c


def test_a_node_gives_few_pairs_all_and_many_as_a_forest():
    rng = np.random.default_rng(3)
    for m, copies in ((30, 2), (40, 20)):
        base = rng.integers(0, 256, (m // copies + 1, near_dedup.SKETCH))
        sketch = base[np.arange(m) // copies].astype(np.uint8)
        ids, n = rng.permutation(10 * m)[:m].astype(np.int64), np.full(m, 100)
        left, right, suspects = near_dedup._forest_of_node(ids, n, sketch, np.zeros(m, dtype=bool), 85)
        group = {i: k // copies for k, i in enumerate(ids.tolist())}
        assert all(group[a] == group[b] and a != b for a, b in zip(left.tolist(), right.tolist()))
        pairs = {frozenset(x) for x in zip(left.tolist(), right.tolist())}
        if copies == 2:
            assert len(pairs) == len(left) == m // 2 and len(suspects) == 0
        else:
            assert len(pairs) == len(left) == m - 2 and sorted(suspects.tolist()) == sorted(ids.tolist())


def test_groups_stay_whole_after_a_join_on_the_group(spark):
    """With a join that becomes a broadcast only when it runs, and rows of a group in all partitions."""
    rows = spark.range(20_000).select((F.col("id") % 500).alias("node"), F.col("id").alias("a"), F.repeat(F.lit("x"), 300).alias("pad")).repartition(8, "a")
    sizes = rows.groupBy("node").agg(F.count("*").alias("rows"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        joined = whole_groups(rows.join(sizes, "node").select("node", "a", "pad"), "node", "a")
        tasks = joined.withColumn("task", F.spark_partition_id()).groupBy("node").agg(F.count_distinct("task").alias("tasks")).agg(F.max("tasks")).first()[0]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tasks == 1 and "REPARTITION_BY_COL" in plan


@pytest.mark.parametrize("few_pairs", [-1, 0, 2])
def test_a_row_whose_best_partner_fails_still_finds_the_others(few_pairs):
    """Whatever a node gives, forest or pairs, the row is a suspect or all its pairs are there."""
    rng = np.random.default_rng(5)
    one = rng.integers(0, 256, near_dedup.SKETCH).astype(np.uint8)
    sketch = np.stack([np.where(rng.random(near_dedup.SKETCH) < share, one, rng.integers(0, 256, near_dedup.SKETCH)).astype(np.uint8) for share in (1, 0.95, 0.9, 0.88, 0.86)])
    near_dedup.FEW_PAIRS, held = few_pairs, near_dedup.FEW_PAIRS
    try:
        left, right, suspects = near_dedup._forest_of_node(np.arange(5), np.full(5, 100), sketch, np.zeros(5, dtype=bool), 80)
    finally:
        near_dedup.FEW_PAIRS = held
    assert len(left) == 10 and len(suspects) == 0 if few_pairs == 2 else len(left) == 4 and len(suspects) == 5
    assert len(set(zip(left.tolist(), right.tolist()))) == len(left)


def test_filter_grows_with_the_ids_and_is_left_out_beyond_its_bound():
    assert near_dedup.filter_words(0) == near_dedup.filter_words(500) == 64
    assert near_dedup.filter_words(10**6) == 1 << 17 and near_dedup.filter_words(10**9) is None


def test_recall_at_the_last_level(spark):
    """2,000 pairs of similarity 0.85 exactly; nodes of one row at most, so each pair must share ``depth`` tokens."""
    rows = []
    for k in range(2000):
        shared = [f"p{k}w{i}" for i in range(34)]
        rows += [(2 * k + side, " ".join([*shared, *(f"p{k}s{side}w{i}" for i in range(3))])) for side in (0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_dedup(d, width=1, percent=85, node_rows=1, depth=4)
    assert got.filter("doc_id % 2 = 1 AND component_id <> doc_id - 1").count() <= 3


def test_trees_follow_recall():
    for percent, depth in ((85, 4), (80, 4), (80, 2), (85, 1)):
        trees, apart = near_dedup.plan_trees(percent, 0.9999, depth), 1 - (percent / 100) ** depth
        assert apart**trees <= 0.0001 < apart ** (trees - 1)


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_and_sketch_together_keep_the_recall(percent):
    j = percent / 100
    agree, least = j + (1 - j) / 256, near_dedup.least_agreement(percent)
    by_sketch = sum(math.comb(near_dedup.SKETCH, k) * agree**k * (1 - agree) ** (near_dedup.SKETCH - k) for k in range(least))
    by_trees = (1 - j**near_dedup.DEPTH) ** near_dedup.plan_trees(percent)
    assert by_sketch + by_trees <= 1 - near_dedup.RECALL


def test_repeated_and_null_ids(spark):
    rng = random.Random(1)
    text = " ".join(f"w{k}" for k in range(60))
    near = near_copies(rng, text, 1, 1)[0]
    d = spark.createDataFrame([(7, text), (7, text), (3, near), (None, text), (None, None)], "doc_id long, text string")
    got = near_dedup.near_dedup(d, width=3, percent=85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(3, 3, True), (7, 3, False), (7, 3, False)]
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None and r.n_shingles == 0)
    assert len(got) == 5


def test_no_documents(spark, docs):
    assert near_dedup.near_dedup(docs([])).count() == 0
    assert [r.kept for r in near_dedup.near_dedup(docs([None, ""])).collect()] == [True, True]


def test_long_text(spark, docs):
    long = " ".join(f"w{k}" for k in range(30_000))
    got = near_dedup.near_dedup(docs([long, long + " more"])).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(29_996, 0), (29_997, 0)]


def test_shared_counts_in_blocks():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40))) for _ in range(9)]
    expected = [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert near_dedup.shared_counts(sets, cells=20).tolist() == expected == near_dedup.shared_counts(sets).tolist()
