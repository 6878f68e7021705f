"""Byte-level BPE encoding and decoding with public rank files.

A piece's byte positions are the leaves of a segment tree; a leaf holds the rank of the pair that
starts there, packed with the position, so the root names the leftmost pair of lowest rank. Each
merge updates the merged position, its live left neighbour and the swallowed position: three
logarithmic point updates.

Cases. A null text counts as empty and has no ids. Repeated rows get equal results; an empty table
gives an empty one. Very long pieces cost n log n. The table of known pieces is bounded, so memory
doesn't grow with the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pair that has no rank.
NO_PAIR = (1 << 62) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for one rank file; ``known_pieces`` bounds the table of encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, known_pieces: int = 1_000_000, known_length: int = 48):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.known_pieces, self.known_length = known_pieces, known_length

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        size = 1 << (n - 1).bit_length()
        shift = size.bit_length()
        mask = (1 << shift) - 1
        end = list(range(1, n + 1))  # of the token that starts here
        before = list(range(-1, n - 1))  # start of the live token to the left
        tree = [NO_PAIR] * (2 * size)
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                if b < a:
                    a = b
                if tree[k] == a:
                    return
                tree[k] = a

        def pair(i: int) -> int:
            j = end[i]
            r = ranks.get(piece[i : end[j]]) if j < n else None
            return NO_PAIR if r is None else r << shift | i

        while (low := tree[1]) != NO_PAIR:
            i = low & mask
            j = end[i]
            put(j, NO_PAIR)
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _packed(self, piece: str) -> bytes:
        out = np.array(self.merge(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= self.known_length:
            if len(self.known) >= self.known_pieces:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, packed = self.known.get, self._packed
        return b"".join([known(p) or packed(p) for p in self.split(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec_of(rank_file: str, pattern: str) -> Codec:
    """One per Python worker: later tasks find its table of pieces filled."""
    return Codec(read_ranks(rank_file), pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(rank_file, pattern)
        for b in batches:
            ids = [codec.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<long>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(rank_file, pattern)
        for b in batches:
            found = [codec.decode(ids or []) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and keeps digests.

    The digests are taken where the ids are made, so neither ids nor bytes leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(rank_file, pattern)
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in b.column("text").to_pylist():
                packed = codec.encode_packed(text or "")
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(packed).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
