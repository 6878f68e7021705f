"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, connected components.

Equal vectors of a label are one class from the start. Every class gets a bucket in each of several
tables; classes meet where label, length, table and signs agree. They meet twice: first with nothing
but their sign bits, which tell whom no pair at the threshold can be near; then the classes that are
left, with their vectors, and cosines are computed in double precision. A pair that meets in several
tables counts in the first of them, so link counts need no pair table: a bucket returns counts for
its classes and a spanning forest of its links.

A bucket larger than ``block`` is split into blocks, and each pair of blocks is a task's unit of its
own: work on a hot bucket spreads over the cluster, rows are never dropped, and pairs are counted
but not emitted. The number of tables follows from the target recall at the threshold.

Cases. Null, empty or zero vectors and vectors with null or non-finite components link with
nothing, nor do vectors of null label or of unequal lengths. Rows are told apart by their vectors,
not by vec_id: a repeated vec_id is another vector, with links of its own, and so is a null one,
which never names a component unless no other id is there (then component_id is null). An empty
table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import hash128, join_per_key, materialise, whole_groups
from lumenfold.llm.components import connected_components

THRESHOLD, RECALL, BLOCK = 0.98, 0.99999, 1024


def plan_tables(rows: int, threshold: float, recall: float, bucket_rows: int = 32) -> tuple[int, int]:
    """Sign bits per table so that unlike vectors share small buckets, and tables for ``recall``."""
    bits = max(4, min(24, round(math.log2(max(rows, 1) / bucket_rows + 1))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def most_apart(threshold: float, total_bits: int) -> int:
    """Sign bits in which a pair at the threshold differs at most, but for a chance of about 10^-9."""
    differ = math.acos(threshold) / math.pi
    return math.ceil(total_bits * differ + 6 * math.sqrt(total_bits * differ * (1 - differ)))


def planes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits, tables]).standard_normal((dim, bits * tables))


def with_buckets(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Add ``signs``, the bucket number in each table, and ``sketch``, all their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            signs, sketches = [], []
            for v in b.column("vector").to_numpy(zero_copy_only=False):
                x = np.asarray(v, dtype=np.float64)
                if len(x) not in made:
                    made[len(x)] = planes(len(x), bits, tables, seed)
                above = x @ made[len(x)] > 0
                sketches.append(np.packbits(above).tobytes())
                signs.append(_buckets(above[None, :], bits)[0].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(signs, pa.list_(pa.int32())), pa.array(sketches, pa.binary())], [*b.schema.names, "signs", "sketch"])

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.mapInArrow(run, f"class long, label string, vector {kind}, size long, signs array<int>, sketch binary")


def _buckets(above: np.ndarray, bits: int) -> np.ndarray:
    return above.reshape(len(above), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _bits_of(sketches: pa.ChunkedArray, total_bits: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint8).reshape(len(sketches), -1)
    return np.unpackbits(packed, axis=1, count=total_bits)


def usable(embedding: str = "embedding") -> Column:
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0) & F.col("label").isNotNull(), F.lit(False))


def _bucket_links(threshold: float):
    """Rows (class, links, root) for sorted runs of rows that share (table, bucket, cell)."""

    def of_run(cells: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        x, side = cells["vector"], cells["side"]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = a if len(b) == 0 else b
        near = x[a] @ x[b].T >= threshold
        if b is a:
            np.fill_diagonal(near, False)
        first = np.ones_like(near)
        signs = cells["signs"]
        for t in range(int(cells["table"][0])):
            first &= signs[a, t][:, None] != signs[b, t][None, :]
        near &= first
        if not near.any():
            return
        ids, size = cells["class"], cells["size"]
        yield ids[a], near @ size[b], np.where(near, ids[b][None, :], np.iinfo(np.int64).max).min(axis=1)
        if b is not a:
            yield ids[b], near.T @ size[a], np.where(near.T, ids[a][None, :], np.iinfo(np.int64).max).min(axis=1)
        yield from _forest(near, ids[a], ids[b])

    return of_run


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spanning links of a block's graph (links count 0): each row with the least id it reaches there."""
    a, b = left.copy(), right.copy()
    far = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(near, b[None, :], far).min(axis=1))
        b2 = np.minimum(b, np.where(near, a2[:, None], far).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    for ids, roots in ((left, a), (right, b)):
        k = ids != roots
        yield ids[k], np.zeros(k.sum(), dtype=np.int64), roots[k]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells, of two rows or more, of batches that are sorted by cell."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        names = b.column("cell").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if held and names[start] != key:
                if sum(x.num_rows for x in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            key = names[start]
            held.append(b.slice(start, stop - start))
    if sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return a, (b if len(b) else a)


def _plausible(limit: int):
    """(class, table) of the rows of a cell that have a partner whose sign bits differ in ``limit`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            packed = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
            words = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
            a, b = _sides(t.column("side").to_numpy())
            apart = np.zeros((len(a), len(b)), dtype=np.uint16)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[a, k][:, None] ^ words[b, k][None, :])
            near = apart <= limit
            if a is b:
                np.fill_diagonal(near, False)
            k = np.unique(np.concatenate([a[near.any(axis=1)], b[near.any(axis=0)]]))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(t.column("class").to_numpy()[k]), pa.array(t.column("table").to_numpy()[k])], ["class", "table"])

    return run


def _compare(threshold: float, bits: int, tables: int):
    of_run = _bucket_links(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            c = {n: t.column(n).to_numpy() for n in ("class", "size", "side", "table")}
            x = np.vstack(t.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            c["vector"] = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            c["signs"] = _buckets(_bits_of(t.column("sketch"), bits * tables), bits)
            for ids, links, roots in of_run(c):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(np.where(roots == np.iinfo(np.int64).max, ids, roots))], ["class", "links", "root"])

    return run


def _dealt(rows: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """Rows (home, class, ...) with ``cell`` and ``side``, sorted by cell: each pair of a home's blocks is a cell.

    Block k meets blocks k.. as side 0 and blocks ..k as side 1. A home of one row has no cell.
    """
    large = materialise(rows.groupBy("home").agg(F.count("*").alias("n")).filter(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / block).cast("int")))
    placed = rows.withColumn("parts", F.lit(1)) if large.isEmpty() else join_per_key(rows, large, ["home"], "n", ["class"]).withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    spread = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.withColumn("side", F.when(F.col("part") <= F.col("other"), 0).otherwise(1)).withColumn("cell", F.xxhash64("home", F.least("part", "other"), F.greatest("part", "other")))
    return whole_groups(spread.select("cell", "side", *columns), "cell")


def near_dedup(vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    key0, key1 = (F.when(usable(), h) for h in hash128(F.col("label").cast("string"), F.col("embedding")))
    rows = materialise(vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").alias("vector"), key0.alias("k0"), key1.alias("k1")))
    grouped = rows.filter(F.col("k0").isNotNull()).groupBy("k0", "k1").agg(F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("size"))
    classes = materialise(grouped.withColumn("class", F.monotonically_increasing_id()))  # written, so the numbers stay
    per_label = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(per_label, threshold, recall)
    signed = materialise(with_buckets(classes.select("class", "label", "vector", "size"), bits, tables, seed))
    home = lambda table, bucket: F.xxhash64("label", F.size("vector"), table, bucket).alias("home")
    cells = signed.select("class", "label", "vector", "sketch", F.posexplode("signs").alias("table", "bucket")).select("class", "sketch", "table", home(F.col("table"), F.col("bucket")))
    close = materialise(_dealt(cells, block, ["class", "table", "sketch"]).mapInArrow(_plausible(most_apart(threshold, bits * tables)), "class long, table int").distinct())
    again = close.join(signed, "class").select("class", "size", "table", "vector", "sketch", home(F.col("table"), F.get("signs", F.col("table"))))
    found = materialise(_dealt(again, block, ["class", "size", "table", "vector", "sketch"]).mapInArrow(_compare(threshold, bits, tables), "class long, links long, root long"))
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter(F.col("class") != F.col("root")), "class", "root")
    linked = materialise(parts.withColumnRenamed("vertex", "class").join(classes.select("class", "least"), "class"))
    named = materialise(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    component = join_per_key(linked, named, ["component"], "n", ["class"]).select("class", "component_id")
    of_class = classes.select("k0", "k1", "class", "least", "size").join(counts, "class", "left").join(component, "class", "left")
    per_class = materialise(of_class.select("k0", "k1", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    out = join_per_key(rows.select("vec_id", "k0", "k1"), per_class, ["k0", "k1"], "size", ["vec_id"])
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
