from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenfold.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 5000), st.sampled_from([256, 512, 1024, 2048, 4096])), max_size=40), st.booleans())
def test_every_id_lies_in_one_piece(lengths, last):
    windows, left = packing.pack([(k, 0, n) for k, n in enumerate(lengths)], packing.TIERS, last)
    assert not (last and left)
    spans = defaultdict(list)
    for tier, items in windows:
        assert tier in packing.TIERS and sum(x.length for x in items) <= tier
        for x in items:
            spans[x.doc].append((x.start, x.length))
    for x in left:
        spans[x.doc].append((x.start, x.length))
    assert sum(sum(x.length for x in items) < tier for tier, items in windows) <= int(last)
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(spans[k]):
            assert start == at and length > 0
            at += length
        assert at == n


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the and \n\t'sß漢😀0#<|endoftext|>\x1c\x85"), st.characters(exclude_categories=["Cs"]))))
def test_tokens_like_the_library(text):
    packed = packing.file_tokenizer(FILE, public_tokenizers.PATTERN)(text)
    assert np.frombuffer(packed, dtype="<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def check(spark, d, rows, **options):
    got = packing.pack_documents(d, FILE, public_tokenizers.PATTERN, with_ids=True, **options).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pieces[0].tier and len({(r.tier, r.step) for r in pieces}) == 1
    assert set(by_doc) == {i for i, _ in rows}
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == ids and {r.doc_tokens for r in pieces} == {len(ids)}
    return by_sequence


def test_documents(spark, docs):
    texts = [None, "", "hello world", "hello world", "the quick brown fox " * 3000, "é" * 700] + [f"document {k} " * (k % 90) for k in range(300)]
    sequences = check(spark, docs(texts).coalesce(2), list(enumerate(texts)), block_tokens=10_000)
    full = sum(sum(r.length for r in p) == p[0].tier for p in sequences.values())
    assert full >= len(sequences) - 2


def test_null_id_and_empty_table(spark, docs):
    d = docs(["a b c"]).selectExpr("CAST(NULL AS long) AS doc_id", "text")
    check(spark, d, [(None, "a b c")])
    assert packing.pack_documents(docs([]), FILE, public_tokenizers.PATTERN).count() == 0


def test_every_code_point_like_the_library():
    tokenizer = packing.file_tokenizer(FILE, public_tokenizers.PATTERN)
    for start in range(0, 0x110000, 256):
        text = "".join(f"{c}a {c}1{c}{c} x{c} \n" for c in map(chr, range(start, start + 256)) if not "\ud800" <= c <= "\udfff")
        assert np.frombuffer(tokenizer(text), dtype="<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_word_of_the_vocabulary_is_reached_by_merges():
    letters, model = packing.byte_letters(), LIBRARY.model
    for word, i in LIBRARY.get_vocab(with_added_tokens=False).items():
        assert [t.id for t in model.tokenize(word)] == [i]
    assert len(set(letters.values())) == 256


@pytest.mark.parametrize("text", [" " * 1_500_000 + "x", "ab" * 50_000, "#!" * 50_000, "\n" * 200_000, "a<|endoftext|><|endoftext|> b"])
def test_long_runs_and_special_strings(text):
    packed = packing.file_tokenizer(FILE, public_tokenizers.PATTERN)(text)
    assert np.frombuffer(packed, dtype="<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_windows_are_numbered_by_tier():
    counts: dict[int, int] = {}
    windows = [(t, []) for t in (256, 2048, 256, 256, 2048)]
    assert packing.window_numbers(windows, counts) == [0, 0, 1, 2, 1]
    assert packing.window_numbers([(256, [])], counts) == [3]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_steps_are_balanced_over_all_tasks(spark, docs, monkeypatch, broadcast_rows):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast_rows)
    d = docs([f"document {k} " * (k % 190) for k in range(400)]).repartition(4)
    got = packing.pack_documents(d, FILE, public_tokenizers.PATTERN, step_tokens=4096, block_tokens=5000).collect()
    assert len({r.sequence_id >> packing.TASK_BITS for r in got}) == 4
    held = defaultdict(set)
    for r in got:
        held[r.tier, r.step].add(r.sequence_id)
    for tier in packing.TIERS:
        steps = sorted(k for t, k in held if t == tier)
        assert steps == list(range(len(steps)))
        assert all(len(held[tier, k]) == 4096 // tier for k in steps[:-1])
