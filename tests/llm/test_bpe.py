from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(FILE)
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN, known_pieces=50)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abeth iou\n\t  '\"sté ß漢😀0123#\x1c\x85"), st.characters(exclude_categories=["Cs"]))))
def test_like_the_library(text):
    ids = CODEC.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def naive(piece: bytes) -> list[int]:
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        ranked = [(RANKS[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in RANKS]
        if not ranked:
            return [RANKS[p] for p in parts]
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_segment_tree_merges_leftmost_lowest():
    rng = random.Random(3)
    for _ in range(300):
        piece = bytes(rng.choice(b"aabbthe \xc3\xa9") for _ in range(rng.randint(1, 40)))
        assert piece in RANKS or CODEC.merge(piece) == naive(piece)


def test_long_piece():
    text = "the" * 40_000
    assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)


@pytest.mark.parametrize("texts", [[], [None, "", "hello", "hello", "wörld\n\n  x", "a" * 5000]])
def test_documents(spark, docs, texts):
    d = docs(texts)
    got = {r.doc_id: r for r in bpe.round_trip(d, FILE, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = REFERENCE.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(d, FILE, public_tokenizers.PATTERN), FILE, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.bytes) for r in back} == {k: (t or "").encode() for k, t in enumerate(texts)}


def test_null_ids_and_repeated_rows(spark, docs):
    d = docs(["a b", "a b"]).unionByName(docs(["a b"])).selectExpr("if(doc_id = 1, null, doc_id) AS doc_id", "text")
    got = bpe.round_trip(d, FILE, public_tokenizers.PATTERN).collect()
    assert sorted(str(r.doc_id) for r in got) == ["0", "0", "None"] and len({r.ids_sha256 for r in got}) == 1
