from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import toxicity


def test_marginals_like_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(40):
        starts, lengths = toxicity._spread(rng.integers(0, 6, 4))
        s, t = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
        p, pairs = toxicity.marginals(s, starts, lengths, 0.3, t, pairs=True)
        expected, joint = np.zeros_like(s), np.zeros((2, 2))
        for a, n in zip(starts, lengths):
            total, each, both = 0.0, np.zeros(n), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=int(n)):
                w = np.exp(sum((s[a + i] + 0.3) * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
                total += w
                each += w * np.array(y)
                for i in range(1, n):
                    both[y[i - 1], y[i]] += w
            if n:
                expected[a : a + n] = each / total
                joint += both / total
        assert np.allclose(p, expected) and np.allclose(pairs, joint)


def corpus(n=400):
    rng = random.Random(5)
    plain = ["alder", "birch", "cedar", "douglas", "elm", "fir", "gum", "hazel"]
    texts, toxic = [], []
    for k in range(n):
        words = rng.choices(plain, k=rng.randint(5, 60))
        if k % 4 == 0:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Vilething!", "vilethings,", "rottenness"]))
        texts.append(" ".join(words))
        toxic.append(int(k % 4 == 0))
    return texts, toxic


def test_held_out_accuracy_and_spans(spark, docs):
    texts, toxic = corpus()
    d = docs(texts + [None, "", "alder " * 30_000])
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic)] + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit_on_labels(d, labels, fit_toxic=60, fit_clean=120)
    got = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    assert sum((got[k].score >= 0.3) != bool(y) for k, y in enumerate(toxic)) <= 4
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[400].score == got[401].score < 0.3 and got[402].score < 0.3
    for k, y in enumerate(toxic):
        found = [texts[k][s.start : s.stop].lower() for s in got[k].spans]
        assert all("vile" in x or "rotten" in x for x in found)
        assert not y or found
    same = toxicity.fit_on_labels(d.repartition(3), labels, fit_toxic=60, fit_clean=120)
    assert np.array_equal(model.weights, same.weights)


def test_held_out_labels_arent_read(spark, docs):
    texts, toxic = corpus(200)
    held = {r.doc_id for r in docs(texts).filter(toxicity.held_out(F.col("doc_id"))).collect()}
    assert 20 < len(held) < 80
    make = lambda flip: spark.createDataFrame([(k, 1 - y if flip and k in held else y) for k, y in enumerate(toxic)], "doc_id long, toxic int")
    a, b = (toxicity.fit_on_labels(docs(texts), make(f), fit_toxic=40, fit_clean=40) for f in (False, True))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.logistic, b.logistic)


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1)], [(0, 0)]])
def test_without_both_classes_scores_are_zero(spark, docs, labels):
    d = docs(["alder birch", None])
    model = toxicity.fit_on_labels(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [(r.score, r.spans) for r in toxicity.score_documents(d, model).collect()] == [(0.0, []), (0.0, [])]


def test_empty_table(spark, docs):
    assert toxicity.score_documents(docs([]), toxicity.ToxicityModel()).count() == 0


def test_long_texts_arent_trained_on_but_scored(spark, docs):
    texts, toxic = corpus(120)
    long = [f"{texts[0]} " * 2000, texts[1]]
    labels = lambda n: spark.createDataFrame([(k, y) for k, y in enumerate([*toxic, 1, 0][:n])], "doc_id long, toxic int")
    a = toxicity.fit_on_labels(docs(texts), labels(120))
    b = toxicity.fit_on_labels(docs([*texts, long[0]]), labels(121))
    assert np.array_equal(a.weights, b.weights)
    assert toxicity.score_documents(docs(long), a).count() == 2
