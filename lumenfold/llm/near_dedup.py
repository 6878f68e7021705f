"""MinHash near-dedup: a chosen-path set similarity join, then connected components.

1. Each whole text becomes its set of word shingles (64-bit hashes), minwise tokens of that set
   and a sketch of 128 minwise bytes. Texts of equal sets are one class from here on.
2. In each of several independent trees every class walks down by minwise tokens: the node of a
   class is the path of tokens chosen so far. A node of at most ``node_rows`` classes is compared
   exhaustively, by sketch; a larger one branches by a further token. Nodes of all further levels are
   counted at once, so each row goes straight to its own, and all nodes are compared in one pass. A
   tree has ``depth`` minwise tokens of its own, so trees are independent. Two sets of similarity J share the node of the last
   level with chance J^depth, which sets the number of trees.
3. A node still large at ``depth`` holds near-copies of one text. Its smallest class is the pivot:
   all are compared with it, by sketch and then on the full sets. Those linked to it form its star
   and need no comparison with one another; the rest meet all rows of the node, block by block.
4. A node of few candidate pairs, at most two a row, gives them all. Any other gives a maximum
   spanning forest of them, at most one link a row, however many near-copies meet there. What it
   gives is confirmed on the full sets, once for all trees, and goes to connected components.
5. Where the candidates of a node with a forest still lie in several components, all its pairs across
   components are confirmed on the full sets, inside the node, and the components joined again. So no link is
   lost to the forest, and no node ever emits all its pairs.

Cases. Null texts and texts without words have an empty set and link with nothing. Fewer words
than a shingle are one shingle. Rows of equal doc_id are one document: a link of one is a link of
all. A row of null doc_id is its own group and isn't compared. An empty table gives an empty
result. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import join_per_key, materialise, whole_groups
from lumenfold.llm.components import star_forest

RECALL, DEPTH, NODE_ROWS = 0.9999, 4, 512
SKETCH = 128
#: A candidate's sketch agreement is at most so many standard deviations below that of the similarity sought.
SLACK = 4.5
#: Bits per id, and most words of 64 bits, of the filter that keeps texts without candidates from being shuffled.
FILTER_BITS, FILTER_WORDS = 8, 1 << 20
#: Pairs of one document that are verified in one place.
PAIRS_TOGETHER = 2000
#: A node gives all its candidate pairs if they are at most so many a row.
FEW_PAIRS = 2
#: Shingles of a node that are compared at once.
ITEMS_TOGETHER = 1 << 22


def plan_trees(percent: int, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Trees in one of which a pair at the threshold shares all ``depth`` tokens with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** depth))


# ---------------------------------------------------------------- sets of shingles


class Shingler:
    """Sorted 64-bit hashes of the distinct word shingles of a text; A-Z are lower-cased.

    The table of word hashes is bounded.
    """

    def __init__(self, width: int, known_words: int = 300_000):
        self.width, self.known_words = width, known_words
        self.known: dict[bytes, int] = {}
        rng = np.random.default_rng(width)
        self.mix = rng.integers(1, 1 << 63, width, dtype=np.uint64) | np.uint64(1)

    def _learn(self, word: bytes) -> int:
        if len(self.known) >= self.known_words:
            self.known.clear()
        self.known[word] = h = xxhash.xxh64_intdigest(word) or 1
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known, learn, w = self.known.get, self._learn, self.width
        h = np.array([known(x) or learn(x) for x in words] + [0] * max(0, w - len(words)), dtype=np.uint64)
        n = len(h) - w + 1
        x = np.zeros(n, dtype=np.uint64)
        for k in range(w):
            x += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(31))) * self.mix[k]
            x ^= x >> np.uint64(29)
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        return np.unique(x)


def describe_sets(docs: DataFrame, width: int, tokens: int) -> DataFrame:
    """(doc_id, n, f0, f1, tokens, sketch); f0 and f1 name the set, tokens are minwise, one a coordinate."""
    coords = tokens + SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        factors = np.random.default_rng(11).integers(1, 1 << 63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                s = shingler(text)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                least = np.full(coords, np.iinfo(np.uint64).max, dtype=np.uint64)
                for k in range(0, len(s), 1024):
                    np.minimum(least, (factors[:, None] * s[None, k : k + 1024]).min(axis=1), out=least)
                name = xxhash.xxh3_128_digest(s.tobytes())
                f0, f1 = np.frombuffer(name, dtype=np.int64).tolist()
                # the byte folds all bits: minima alone have zero upper bits
                last = least[-SKETCH:] * np.uint64(0x9E3779B97F4A7C15)
                rows.append((len(s), f0, f1, least[:-SKETCH].view(np.int64).tolist(), (last >> np.uint64(56)).astype(np.uint8).tobytes()))
            n, f0, f1, minwise, sketch = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(minwise, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "n", "f0", "f1", "tokens", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f0 long, f1 long, tokens array<long>, sketch binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, items) with all shingle hashes, and the pairs of ``docs`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in batches:
            items = [shingler(t).view(np.int64) for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id"), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.int64())), b.column("pairs_a"), b.column("pairs_b")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "items", "pairs_a", "pairs_b"])

    return docs.select("doc_id", "text", "pairs_a", "pairs_b").mapInArrow(run, "doc_id long, n long, items array<long>, pairs_a long, pairs_b long")


# ---------------------------------------------------------------- nodes


def least_agreement(percent: int) -> int:
    """Least agreeing sketch bytes of a candidate."""
    j = percent / 100
    return math.floor(SKETCH * (j - SLACK * math.sqrt(j * (1 - j) / SKETCH)))


def _forest_of_node(ids: np.ndarray, n: np.ndarray, sketch: np.ndarray, starred: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, suspects): all candidate pairs of the node and no suspects, if they are at most
    FEW_PAIRS a row; else a maximum spanning forest of them, by Prim's algorithm on sketch agreement,
    and every row that has a candidate partner.

    Starred rows need no pair with each other. Rows are compared one against the rest, so memory is
    linear in the node.
    """
    least = least_agreement(percent)
    m = len(ids)

    def row(i: int) -> np.ndarray:
        ok = (100 * np.minimum(n[i], n) >= percent * np.maximum(n[i], n)) & (ids != ids[i])
        if starred[i]:
            ok &= ~starred
        k = np.flatnonzero(ok)
        out = np.zeros(m, dtype=np.int64)
        out[k] = (sketch[k] == sketch[i]).sum(axis=1)
        return out

    if m == 2:
        k = np.array([0] if row(0)[1] >= least else [], dtype=int)
        return ids[k], ids[k + 1], ids[:0]
    best, source, done = np.zeros(m, dtype=np.int64), np.full(m, -1), np.zeros(m, dtype=bool)
    suspect = np.zeros(m, dtype=bool)
    left, right, pairs, all_pairs = [], [], 0, []
    i = 0
    for _ in range(m - 1):
        done[i] = True
        found = row(i)
        suspect[i] = (found >= least).any()
        further = np.flatnonzero((found >= least) & ~done)
        pairs += len(further)
        if pairs <= FEW_PAIRS * m:
            all_pairs += [(i, k) for k in further.tolist()]
        better = (found > best) & ~done
        best[better], source[better] = found[better], i
        waiting = np.where(done, -1, best)
        i = int(waiting.argmax())
        if waiting[i] >= least:
            left.append(ids[source[i]])
            right.append(ids[i])
            suspect[i] = True
    if pairs <= FEW_PAIRS * m:
        both = np.array(all_pairs, dtype=np.int64).reshape(-1, 2)
        return ids[both[:, 0]], ids[both[:, 1]], ids[:0]
    # the forest's links decide a node of two suspects
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), ids[suspect] if suspect.sum() > 2 else ids[:0]


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Whole groups of batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        names = np.stack([b.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for start, stop in zip(cuts, cuts[1:]):
            name = tuple(names[start].tolist())
            if held and name != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = name
            held.append(b.slice(start, stop - start))
    if held:
        yield now, pa.Table.from_batches(held)


def _compare_nodes(percent: int, rows_together: int = 20_000):
    """Over rows sorted by node: forest links (a, b), and suspects (node, a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, node = [], [], []

        def taken() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(node, pa.int64())], ["a", "b", "node"])
            for x in (a, b, node):
                x.clear()

        for (key,), t in _runs(batches, "node"):
            if t.num_rows < 2:
                continue
            ids, n, starred = (t.column(c).to_numpy() for c in ("rep", "n", "starred"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), SKETCH)
            left, right, suspects = _forest_of_node(ids, n, sketch, starred, percent)
            suspects = np.unique(suspects)
            a += np.minimum(left, right).tolist() + suspects.tolist()
            b += np.maximum(left, right).tolist() + [None] * len(suspects)
            node += [None] * len(left) + [int(key)] * len(suspects)
            if len(a) > rows_together:
                yield from taken()
        yield from taken()

    return run


def _candidates_of(rows: DataFrame, percent: int) -> DataFrame:
    grouped = whole_groups(rows.select("node", "rep", "n", "sketch", "starred"), "node", "rep")
    return grouped.mapInArrow(_compare_nodes(percent), "a long, b long, node long")


def _against_pivot(rows: DataFrame, percent: int) -> DataFrame:
    """Add ``near``: whether the sketch may be linked to that of the node's pivot."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a, p = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, SKETCH) for c in ("sketch", "pivot_sketch"))
            keep = [c for c in b.schema.names if c != "pivot_sketch"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array((a == p).sum(axis=1) >= least)], [*keep, "near"])

    return rows.mapInArrow(run, "node long, rep long, n long, sketch binary, pivot long, near boolean")


def _large_nodes(rows: DataFrame, node_rows: int) -> DataFrame:
    return materialise(rows.groupBy("node").agg(F.count("*").alias("rows")).filter(F.col("rows") > node_rows))


def candidate_pairs(reps: DataFrame, trees: int, percent: int, node_rows: int, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """Of classes (rep, n, tokens, sketch) that meet and look alike: forest links (a, b), a < b, and
    suspects (node, a), where b is null; and the rows of nodes that stay large, beside their pivots."""
    paths = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("tokens", t * depth + 1, F.lit(depth)))
    rows = reps.select("rep", "n", "sketch", F.posexplode(paths).alias("tree", "path")).withColumn("node", F.xxhash64("tree", F.element_at("path", 1))).drop("tree")
    large = _large_nodes(rows, node_rows)
    if large.isEmpty():
        return materialise(_candidates_of(_unstarred(rows), percent)), None
    marked = join_per_key(rows, large.withColumn("large", F.lit(True)), ["node"], "rows", ["rep"])
    placed = _further_down(marked.filter("large").drop("large"), node_rows, depth)
    small = _unstarred(marked.filter(F.col("large").isNull())).unionByName(_unstarred(placed.filter(~F.col("large"))))
    found = materialise(_candidates_of(small, percent))
    stay = placed.filter("large")
    return found, None if stay.isEmpty() else _beside_pivots(stay, percent)


def _unstarred(rows: DataFrame) -> DataFrame:
    return rows.select("rep", "n", "sketch", "node", F.lit(False).alias("starred"))


def _further_down(rows: DataFrame, node_rows: int, depth: int) -> DataFrame:
    """Rows of large nodes, each in the first node further down its path that isn't large, else in the
    last one, as a written table; ``large`` tells the latter.

    Nodes of all levels are counted together; a node's rows are among those of the one above it.
    """
    levels = [f"_node{k}" for k in range(1, depth)]
    for k, level in enumerate(levels):
        rows = rows.withColumn(level, F.xxhash64(levels[k - 1] if k else "node", F.element_at("path", k + 2)))
    if not levels:
        return materialise(rows.select("rep", "n", "sketch", "node", F.lit(True).alias("large")))
    rows = materialise(rows.select("rep", "n", "sketch", *levels))
    large = _large_nodes(rows.select(F.explode(F.array(*levels)).alias("node")), node_rows)
    total = large.agg(F.sum("rows")).first()[0]
    if total is None:
        return rows.select("rep", "n", "sketch", F.col(levels[0]).alias("node"), F.lit(False).alias("large"))
    for level in levels:
        rows = join_per_key(rows, large.select(F.col("node").alias(level), "rows", F.lit(True).alias(f"{level}_large")), [level], "rows", ["rep"], total)
    own = F.coalesce(*(F.when(F.col(f"{level}_large").isNull(), F.col(level)) for level in levels), F.col(levels[-1]))
    return materialise(rows.select("rep", "n", "sketch", own.alias("node"), F.col(f"{levels[-1]}_large").isNotNull().alias("large")))


def _beside_pivots(rows: DataFrame, percent: int) -> DataFrame:
    least = rows.groupBy("node").agg(F.min(F.struct("rep", "sketch")).alias("least"), F.count("*").alias("rows"))
    per_node = materialise(least.select("node", F.col("least.rep").alias("pivot"), F.col("least.sketch").alias("pivot_sketch"), "rows"))
    beside = join_per_key(rows.select("node", "rep", "n", "sketch"), per_node, ["node"], "rows", ["rep"])
    return materialise(_against_pivot(beside.select("node", "rep", "n", "sketch", "pivot", "pivot_sketch"), percent))


def star_links(docs: DataFrame, met: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of pivots that hold on the full sets."""
    looked_at = materialise(met.filter(F.col("near") & (F.col("rep") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    per_doc = pairs_of_each(looked_at)
    return materialise(confirmed_links(looked_at, per_doc, sets_of(docs, per_doc, width), percent))


def rest_pairs(met: DataFrame, star: DataFrame, percent: int, node_rows: int) -> DataFrame:
    """Candidates, as of ``candidate_pairs``, of large nodes' rows outside the star among all rows."""
    linked = star.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), F.lit(True).alias("_linked"))
    starred = F.col("_linked").isNotNull() | (F.col("rep") == F.col("pivot"))
    marked = materialise(met.join(linked, ["pivot", "rep"], "left").select("node", "rep", "n", "sketch", starred.alias("starred")))
    return materialise(_candidates_of(_cells(marked, node_rows), percent))


def _cells(met: DataFrame, node_rows: int) -> DataFrame:
    """Deal the rows of large nodes to cells of about two blocks, so that every pair meets but star with star.

    Starred rows and the rest are split into blocks of ``node_rows``. A cell is a block of stars and
    a block of the rest, or two blocks of the rest. A node without a rest has no cell.
    """
    blocks = lambda n: F.ceil(F.count_if(n) / node_rows).cast("int")
    split = materialise(met.groupBy("node").agg(F.count("*").alias("rows"), blocks(F.col("starred")).alias("stars"), blocks(~F.col("starred")).alias("rest")))
    up_to = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<bigint>"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    cell = lambda kind, x, y: F.xxhash64("node", F.lit(kind), x, y)
    stars, rest = F.col("stars"), F.col("rest")
    of_star = up_to(rest, lambda r: cell(0, own(stars), r))
    of_rest = F.concat(up_to(stars, lambda p: cell(0, p, own(rest))), up_to(rest, lambda q: cell(1, F.least(q, own(rest)), F.greatest(q, own(rest)))))
    dealt = join_per_key(met.select("node", "rep", "n", "sketch", "starred"), split, ["node"], "rows", ["rep"])
    return dealt.withColumn("node", F.explode(F.when(F.col("starred"), of_star).otherwise(of_rest)))


# ---------------------------------------------------------------- confirmation


def pairs_of_each(pairs: DataFrame) -> DataFrame:
    """(doc_id, pairs_a, pairs_b): the documents in the pairs, with their pairs on either side, as a written table."""
    end = lambda side, is_a: F.struct(F.col(side).alias("doc_id"), F.lit(is_a).alias("is_a"))
    ends = pairs.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("end")).select("end.*")
    return materialise(ends.groupBy("doc_id").agg(F.sum("is_a").alias("pairs_a"), F.sum(1 - F.col("is_a")).alias("pairs_b")))


def _places(side: str) -> Column:
    return F.ceil(F.col(f"pairs_{side}") / PAIRS_TOGETHER).cast("int")


def _with_items(pairs: DataFrame, sets: DataFrame, many: DataFrame | None, side: str) -> DataFrame:
    """Pairs with the full set of one side. A document of ``many`` pairs is met in several places, by salt."""
    items = F.col("items").alias(f"items_{side}")
    if many is None:
        return pairs.join(sets.select(F.col("doc_id").alias(side), items), side)
    other = "b" if side == "a" else "a"
    per_key = many.select(F.col("doc_id").alias(side), f"pairs_{side}", _places(side).alias("places")).filter("places > 1")
    salted = join_per_key(pairs, per_key, [side], f"pairs_{side}", [other]).withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("places", F.lit(1))).cast("int")).drop("places")
    copies = sets.filter(_places(side) > 0).select(F.col("doc_id").alias(side), items, F.explode(F.sequence(F.lit(0), _places(side) - 1)).alias("salt"))
    return salted.join(copies, [side, "salt"]).drop("salt")


def filter_words(n: int) -> int | None:
    """Words for ``n`` ids at FILTER_BITS bits each; None where that is more than a broadcast should hold."""
    words = 1 << max(6, math.ceil(math.log2(max(1, n) * FILTER_BITS / 64)))
    return words if words <= FILTER_WORDS else None


def _maybe_listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` that may be in ``ids``, a written table, by a broadcast one-hash Bloom filter.

    It only saves shuffled text; the join after it decides. It has filter_words(ids) rows, and where
    those would be too many there is no filter.
    """
    words = filter_words(ids.count())
    if words is None:
        return docs
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(words)).alias("_word")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(1), c), F.lit(64)).cast("int"))
    bits = ids.select(word("doc_id"), bit("doc_id").alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    marked = docs.join(F.broadcast(bits), word("doc_id") == bits["_word"])
    return marked.filter(F.col("_bits").bitwiseAND(bit(F.col("doc_id"))) != 0).drop("_word", "_bits")


def sets_of(docs: DataFrame, per_doc: DataFrame, width: int) -> DataFrame:
    """Full sets of the documents in ``per_doc``, with their numbers of pairs, as a written table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(full_sets(_maybe_listed(texts, per_doc).join(per_doc, "doc_id"), width))


def confirmed_links(pairs: DataFrame, per_doc: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    most = per_doc.agg(F.max(F.greatest("pairs_a", "pairs_b"))).first()[0] or 0
    many = materialise(per_doc.filter(F.greatest("pairs_a", "pairs_b") > PAIRS_TOGETHER)) if most > PAIRS_TOGETHER else None
    both = _with_items(_with_items(pairs, sets, many, "a"), sets, many, "b")
    counted = both.select("a", "b", F.size(F.array_intersect("items_a", "items_b")).alias("shared"), (F.size("items_a") + F.size("items_b")).alias("total"))
    return counted.filter(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


def shared_counts(sets: list[np.ndarray], cells: int = 1 << 24) -> np.ndarray:
    """Intersection sizes of all pairs, by products of 0/1 blocks of bounded size."""
    m = len(sets)
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((m, m), dtype=np.float32)
    step = max(1, cells // m)
    for start in range(0, len(names), step):
        k = slice(*np.searchsorted(at, [start, start + step]))
        block = np.zeros((m, min(step, len(names) - start)), dtype=np.float32)
        block[owner[k], at[k] - start] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _joined_components(ids: np.ndarray, parts: np.ndarray, n: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Pairs (component, least component it is linked to) of a node's rows."""
    linked = (100 * shared >= percent * (n[:, None] + n[None, :] - shared)) & (parts[:, None] != parts[None, :])
    root = parts.copy()
    while linked.any():  # each row takes the least component of its links and of its own component
        least = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        name, where = np.unique(parts, return_inverse=True)
        of_part = np.full(len(name), np.iinfo(np.int64).max)
        np.minimum.at(of_part, where, least)
        if (of_part[where] == root).all():
            break
        root = of_part[where]
    k = np.flatnonzero(root != parts)
    return np.unique(np.stack([parts[k], root[k]], axis=1), axis=0)


def _confirm_nodes(percent: int):
    """Over rows (node, part, a, component, n, items) sorted by these: exact links that join components, as a forest.

    A part holds the shingles of all rows of a node whose hashes fall there; intersections add up
    over parts, so no more than a part's shingles are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, shared = None, (), np.zeros((0, 0))

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                pairs = _joined_components(*rows, shared, percent)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["a", "b"])

        for (node, _), t in _runs(batches, "node", "part"):
            if node != now:
                yield from done()
                now, rows, shared = node, tuple(t.column(c).to_numpy() for c in ("a", "component", "n")), np.zeros((t.num_rows, t.num_rows), dtype=np.int64)
            shared += shared_counts([np.asarray(x, dtype=np.int64) for x in t.column("items").to_numpy(zero_copy_only=False)])
        yield from done()

    return run


def further_links(suspects: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between components that meet in a node: all its pairs across components, on full sets.

    Most nodes hold one component by now and are left out before any set is moved; None if all do.
    """
    named = suspects.join(parts.select(F.col("vertex").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    in_node = Window.partitionBy("node")
    spread = named.withColumn("x", F.min("component").over(in_node)).withColumn("y", F.max("component").over(in_node))
    open_rows = materialise(spread.filter("x < y").select("node", "a", "component"))
    if open_rows.isEmpty():
        return None
    sized = open_rows.join(sets.select(F.col("doc_id").alias("a"), "n"), "a").withColumn("parts", F.ceil(F.sum("n").over(in_node) / ITEMS_TOGETHER).cast("int"))
    rows = sized.groupBy("node", "a", "component").agg(F.max("parts").alias("parts"))
    split = rows.join(sets.select(F.col("doc_id").alias("a"), "n", "items"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    items = F.when(F.col("parts") == 1, F.col("items")).otherwise(F.filter("items", lambda x: F.pmod(x, F.col("parts")) == F.col("part")))
    dealt = whole_groups(split.select("node", "part", "a", "component", "n", items.alias("items")), "node", "part", "a")
    return materialise(dealt.mapInArrow(_confirm_nodes(percent), "a long, b long"))


def near_dedup(docs: DataFrame, *, width: int = 5, percent: int = 80, recall: float = RECALL, node_rows: int = NODE_ROWS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    trees = plan_trees(percent, recall, depth)
    sets = materialise(describe_sets(docs, width, trees * depth))
    listed = sets.filter(F.col("f0").isNotNull() & F.col("doc_id").isNotNull())
    reps = materialise(listed.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")))
    found, met = candidate_pairs(reps, trees, percent, node_rows, depth)
    star = None if met is None else star_links(docs, met, width, percent)
    if met is not None:
        found = found.unionByName(rest_pairs(met, star, percent, node_rows))
    pairs = materialise(found.filter(F.col("b").isNotNull()).select("a", "b").distinct())
    per_doc = pairs_of_each(pairs)
    sets_of_pairs = sets_of(docs, per_doc, width)
    links = confirmed_links(pairs, per_doc, sets_of_pairs, percent)
    parts = star_forest(links if star is None else links.unionByName(star))
    suspects = found.filter(F.col("b").isNull()).select("node", "a")
    more = further_links(suspects, parts, sets_of_pairs, percent)
    if more is not None and not more.isEmpty():
        parts = star_forest(parts.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(more))
    per_class = materialise(reps.select("f0", "f1", "size", "rep").join(parts.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select("f0", "f1", "size", F.coalesce("component", "rep").alias("component_id")))
    out = join_per_key(sets.select("doc_id", "n", "f0", "f1"), per_class, ["f0", "f1"], "size", ["doc_id"])
    least = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
