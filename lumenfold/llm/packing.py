"""Hierarchical multi-length packing of documents into token sequences.

Documents are cut into whole windows of the largest tier; what remains is routed to the smallest
tier that holds it. Each tier, longest first, opens a window per item and fills its gap from the
shorter tiers, whole items first (the longest that fits), then a cut. Windows end full, and full
windows are powers of two, so only the last sequence of a task can need padding.

Packing is local to a task: documents are tokenised and packed where they are read, without a
shuffle, in blocks of bounded size. What is left of a block joins the next one. A repeated task
reads the same rows in the same order and makes the same sequences.

Training steps are balanced over the whole table: the pieces are written once, windows are counted
by task and tier, and each window's place among all windows of its tier names its step. So every
step of a tier holds equally many windows, but for the tier's last.

Cases. A null or empty text is the closing id alone. A null doc_id is packed like any other.
Repeated rows are packed once each. Very long texts are cut into windows, and endless runs of one
kind of character are encoded whole. The string of a special token gets that token's id, as the
tokenizer file's library does by default. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenfold.llm.common import materialise

TIERS = (256, 512, 1024, 2048)
#: Tokens that are packed together, and tokens in one training step.
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 15
#: Windows of a task are numbered in the lower bits of sequence_id.
TASK_BITS = 36
#: Window counts, one a task and tier, are broadcast up to this many rows, and joined by a shuffle beyond it.
BROADCAST_ROWS = 200_000


@dataclass(order=True)
class Item:
    """A stretch of one document: ``length`` of its ids from ``start``."""

    length: int
    doc: int
    start: int


class Shelf:
    """Items of one tier, in order of length, then document."""

    def __init__(self) -> None:
        self.items: list[Item] = []

    def __len__(self) -> int:
        return len(self.items)

    def add(self, item: Item) -> None:
        insort(self.items, item)

    def longest_within(self, room: int) -> Item | None:
        k = bisect_right(self.items, room, key=lambda x: x.length)
        return self.items.pop(k - 1) if k else None


def pack(lengths: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[Item]]], list[Item]]:
    """Windows (tier, items) for stretches (document, start, length), and stretches that are left.

    With ``last`` nothing is left: the final window of a shorter total is padded.
    """
    top = tiers[-1]
    shelves = [Shelf() for _ in tiers]
    windows: list[tuple[int, list[Item]]] = []

    def route(item: Item) -> None:
        shelves[bisect_left(tiers, item.length)].add(item)

    for doc, start, length in lengths:
        while length >= top:
            windows.append((top, [Item(top, doc, start)]))
            start, length = start + top, length - top
        if length:
            route(Item(length, doc, start))

    def cut(room: int, below: int) -> Item | None:
        """``room`` ids off the longest item at hand; the rest goes back to the tier of its size."""
        for shelf in reversed(shelves[: below + 1]):
            if shelf.items:
                whole = shelf.items.pop()
                route(Item(whole.length - room, whole.doc, whole.start + room))
                return Item(room, whole.doc, whole.start)
        return None

    for k in range(len(tiers) - 1, -1, -1):
        while shelves[k].items:
            opened = shelves[k].items.pop()
            held, room = [opened], tiers[k] - opened.length
            while room:
                fit = next((x for shelf in reversed(shelves[:k] or shelves[:1]) if (x := shelf.longest_within(room))), None)
                fit = fit or cut(room, k)
                if fit is None:
                    break
                held.append(fit)
                room -= fit.length
            if room and not last:
                return windows, sorted(held + [x for s in shelves for x in s.items], key=lambda x: (x.doc, x.start))
            windows.append((tiers[k], held))
    return windows, []


def window_numbers(windows: list[tuple[int, list[Item]]], counts: dict[int, int]) -> list[int]:
    """Number of each window within its tier; ``counts`` carries the windows so far from block to block."""
    out = []
    for tier, _ in windows:
        out.append(counts.get(tier, 0))
        counts[tier] = out[-1] + 1
    return out


def with_steps(packed: DataFrame, step_tokens: int) -> DataFrame:
    """``step`` for ``window``, over a written table: the windows of a tier, task after task, in groups of ``step_tokens``."""
    rows = packed.withColumn("_task", F.shiftright("sequence_id", TASK_BITS))
    made = rows.groupBy("_task", "tier").agg((F.max("window") + 1).alias("made"))
    earlier = Window.partitionBy("tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # the window function sees one row a task and tier, not the pieces
    before = materialise(made.withColumn("before", F.coalesce(F.sum("made").over(earlier), F.lit(0))).drop("made"))
    if before.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    place = F.col("before") + F.col("window")
    return rows.join(before, ["_task", "tier"]).withColumn("step", F.floor(place * F.col("tier") / max(step_tokens, 1)).cast("long"))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1, then from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class FileTokenizer:
    """Ids of the ``tokenizers`` file with ``add_special_tokens=False``, as packed 32-bit integers.

    The file's vocabulary is handed to a faster byte-level encoder, which splits by the same pattern
    and merges by the same ranks; a byte-level vocabulary numbers its merges in order. A text
    that the encoder refuses (its pattern has a limit of its own) goes to the file's own library.
    """

    def __init__(self, path: str, pattern: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        special = {t["content"]: t["id"] for t in found["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in found["model"]["vocab"].items() if word not in special}
        self.native = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def __call__(self, text: str) -> bytes:
        try:
            return self.native.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def file_tokenizer(path: str, pattern: str) -> FileTokenizer:
    """One per Python worker, which later tasks find ready."""
    return FileTokenizer(path, pattern)


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, *, tiers: tuple[int, ...] = TIERS, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step.

    ``with_ids`` adds the piece's token ids. sequence_id holds the task's number in its upper bits;
    a step is named by (tier, step).
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize: Callable[[str], bytes] = file_tokenizer(tokenizer_file, pattern)
        context = TaskContext.get()
        base, made, counts = (context.partitionId() if context else 0) << TASK_BITS, 0, {}
        names: dict[int, tuple] = {}
        waiting: list[tuple[int, int, int]] = []
        size, serial = 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting, names, size
            windows, left = pack(waiting, tiers, last)
            rows = []
            for (tier, items), number in zip(windows, window_numbers(windows, counts)):
                offset = 0
                for x in items:
                    doc_id, packed = names[x.doc]
                    ids = packed[4 * x.start : 4 * (x.start + x.length)]
                    rows.append((doc_id, x.start, x.length, zlib.crc32(ids), len(packed) // 4, base + made, offset, tier, number) + ((np.frombuffer(ids, dtype="<u4").astype("int64"),) if with_ids else ()))
                    offset += x.length
                made += 1
            waiting = [(x.doc, x.start, x.length) for x in left]
            names = {d: names[d] for d, *_ in waiting}
            size = sum(n for *_, n in waiting)
            for k in range(0, len(rows), 20_000):
                part = zip(*rows[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(part, fields)], [n for n, _ in fields])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                packed = tokenize(text or "") + end
                names[serial] = (doc_id, packed)
                waiting.append((serial, 0, len(packed) // 4))
                size, serial = size + len(packed) // 4, serial + 1
                if size >= block_tokens:
                    yield from flush(False)
        yield from flush(True)

    fields = [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", pa.int32()), ("window", pa.int64())]
    schema = ", ".join(f"{n} {'int' if kind == pa.int32() else 'long'}" for n, kind in fields)
    if with_ids:
        fields, schema = [*fields, ("ids", pa.list_(pa.int64()))], f"{schema}, ids array<long>"
    packed = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return with_steps(packed, step_tokens).select(*("step" if n == "window" else n for n, _ in fields))
