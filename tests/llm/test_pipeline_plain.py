"""The whole pipeline against the plain Python versions of its stages, one after another."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import test_line_dedup
import test_near
import test_pii
import test_quality
from tokenizers import Tokenizer

import corpus_pipeline
from lumenfold.llm import pii, quality


def features(text):
    t = text or ""
    n_words, word_chars, symbols, dup_lines, repeated = test_quality.brute(text)
    words = re.findall(test_quality.SEP, t)
    n_lines = sum(bool(re.search(test_quality.SEP, x)) for x in t.split("\n"))
    count = lambda p: len(re.findall(p, t))
    per = lambda a, b: a * 1000 // b if b else 0
    failed = n_words < 20 or 100 * repeated > 30 * n_words
    stutters = sum(a == b for a, b in zip(words, words[1:]))
    return failed, {
        "symbols": per(symbols, n_words),
        "marks": per(count("[!?]"), n_words),
        "capitals": per(count("[A-Z]"), word_chars),
        "digits": per(count("[0-9]"), word_chars),
        "word_length": per(word_chars, n_words),
        "stutters": per(stutters, n_words),
        "repeats": per(repeated, n_words),
        "dup_lines": per(dup_lines, n_lines),
        "line_words": per(n_words, n_lines),
    }


def keeps(rules, text):
    failed, row = features(text)
    return not failed and next((r.keep for r in rules if r.covers(row)), True)


def corpus():
    rng = random.Random(31)
    word = lambda: rng.choice(["river", "stone", "Winter", "market", "glass", "signal"]) + str(rng.randrange(60))
    line = lambda: " ".join(word() for _ in range(rng.randint(5, 14)))
    shared = [line() for _ in range(5)]
    texts = []
    for _ in range(40):
        lines = [line() for _ in range(rng.randint(4, 9))]
        if rng.random() < 0.6:
            lines.insert(rng.randrange(len(lines)), rng.choice(shared))
        if rng.random() < 0.7:
            lines.append(f"reach {test_pii.random_value(rng)} or {test_pii.random_value(rng)}")
        texts.append("\n".join(lines))
    texts += [t for base in texts[:10] for t in test_near.near_copies(rng, base.replace("\n", " "), 2, 3)]
    texts += [" ".join(word() + "###" for _ in range(40)) for _ in range(25)]
    texts += ["the same eight words come here again and " * 9, "too short", "", None, texts[3], texts[3]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[j]) for k, j in enumerate(order)], [(k, int("###" not in (texts[j] or ""))) for k, j in enumerate(order) if k % 4]


def test_run_like_the_plain_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(test_pii, "KEY", pii.DEMO_KEY)
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    rules = quality.quality_rules(docs, marks)
    assert rules

    left = [(i, t) for i, t in rows if keeps(rules, t)]
    left = [(i, t) for i, t, *_ in test_line_dedup.brute(left)]
    _, component = test_near.document_truth(left, 5, 80)
    copies = len(left)
    left = [(i, t) for i, t in left if component[i] == i]
    assert 20 < len(left) < copies < len(rows)
    left = {i: test_pii.plain(t) for i, t in left}
    assert sum(n for _, n in left.values()) > 10

    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(left)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, (text, _) in left.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
