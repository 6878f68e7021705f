"""Secret scans: pattern candidates, judged by how many owners hold the same value corpus-wide.

Each text is scanned once, in its own row, by native regular expressions; only spans and 128-bit
hashes of the values go on, never the text. Hashes are counted by repository, then owner, then
value, each step pre-aggregated. A value that many owners hold is a widely copied example; one
that few hold, and that looks live (long, letters and digits mixed, many different characters), is
an owner-specific credential. Base spans always stay; bare high-entropy values add a span of kind
``owned`` when they are owner-specific.

A text of n matches costs about n^(4/3) steps: offsets are running sums in blocks of n^(1/3), and
whether a bare value overlaps a base span is found by bisection.

Cases. A null or empty text has no spans. A null owner or repository counts as one unnamed owner.
Repeated rows are scanned and counted row by row, so they get equal results. An empty table gives
an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import hash128, join_per_key, let, materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern drops the same matches as a filter would.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
MIN_ASSIGNED, MIN_VARIETY = 8, 10
MAX_OWNERS, MAX_REPOS = 2, 4

SPAN = "array<struct<start:int,kind:int,stop:int,h0:bigint,h1:bigint,live:boolean>>"


def looks_live(value: Column) -> Column:
    """Letters and digits mixed, 16 characters or more, MIN_VARIETY different ones."""
    return (F.char_length(value) >= 16) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_VARIETY)


def sums_before(values: Column) -> Column:
    """For each of some integers, the sum of those before it, in blocks of about the cube root of their number."""

    def in_blocks(width: Column) -> Column:
        def joined(blocks: Column) -> Column:
            sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x))
            starts = F.aggregate(sums, F.array(F.lit(0)), lambda out, x: F.array_append(out, F.element_at(out, -1) + x))
            inside = lambda b, start: F.transform(b, lambda x, i: F.aggregate(F.slice(b, F.lit(1), i), start, lambda n, y: n + y))
            return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b, k: inside(b, F.get(at, k)))))

        last = F.floor((F.size(values) - 1) / width).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * width + 1, width)), joined)

    width = F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(values)))).cast("int")
    return F.when(F.size(values) > 0, let(width, in_blocks)).otherwise(F.array().cast("array<int>"))


def overlaps(span: Column, known: Column) -> Column:
    """Whether ``span`` meets one of some spans that are sorted and don't overlap: it meets the last that starts before its stop, or none."""

    def halve(x: Column, _: Column) -> Column:
        middle = F.shiftright(x["low"] + x["high"], 1)
        before = F.get(known, middle)["start"] < span["stop"]
        low, high = F.when(before, middle + 1).otherwise(x["low"]), F.when(before, x["high"]).otherwise(middle)
        return F.when(x["low"] < x["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(x)

    whole = F.struct(F.lit(0).alias("low"), F.size(known).alias("high"))
    rounds = F.sequence(F.lit(0), F.char_length(F.bin(F.size(known))))
    last = F.aggregate(rounds, whole, halve, lambda x: x["low"]) - 1
    return F.coalesce(F.get(known, last)["stop"] > span["start"], F.lit(False))


def spans_of(text: Column, pattern: str, kind: int, value=lambda match: match, keep=lambda value: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches as (start, kind, stop, h0, h1, live), in code points."""

    def placed(matches: Column) -> Column:
        def of(rest: Column) -> Column:
            steps = F.transform(matches, lambda m, i: F.char_length(F.get(rest, i)) + F.char_length(m))

            def span(before: Column):
                def at(m: Column, i: Column) -> Column:
                    start = F.get(before, i) + F.char_length(F.get(rest, i))
                    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(m)).alias("stop"), m.alias("match"))

                return F.transform(matches, at)

            return let(let(steps, sums_before), span)

        return let(F.split(text, pattern, -1), of)

    def finished(s: Column) -> Column:
        v = value(s["match"])
        h0, h1 = hash128(v)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), h0.alias("h0"), h1.alias("h1"), looks_live(v).alias("live"))

    found = F.filter(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), lambda s: keep(value(s["match"])))
    return F.when(text.rlike(pattern), F.transform(found, finished)).otherwise(F.array()).cast(SPAN)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(row, doc_id, owner, repository, base, bare) for every row, as a written table."""
    body = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        spans_of(body, ASSIGN, 1, lambda m: F.regexp_extract(m, ASSIGN, 2), lambda v: F.char_length(v) >= MIN_ASSIGNED),
        spans_of(body, ACCESS, 2),
        spans_of(body, HEX, 3),
    )
    found = docs.select("doc_id", owner.alias("owner"), repository.alias("repository"), F.array_sort(base).alias("base"), spans_of(body, BARE, 4, keep=looks_live).alias("bare"))
    of_kind = lambda k: F.filter("base", lambda b: b["kind"] == k)
    clear = let(F.struct(*(of_kind(k).alias(KINDS[k - 1]) for k in (1, 2, 3))), lambda known: F.filter("bare", lambda s: ~(overlaps(s, known["assign"]) | overlaps(s, known["access"]) | overlaps(s, known["hex"]))))
    return materialise(found.withColumn("bare", F.when(F.size("bare") > 0, clear).otherwise(F.col("bare"))).withColumn("row", F.monotonically_increasing_id()))


def ownership(held: DataFrame) -> DataFrame:
    """(h0, h1, n, repos, owners) of rows (h0, h1, owner, repository), each level pre-aggregated."""
    value = ["h0", "h1"]
    by_repo = held.groupBy(*value, F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy(*value, "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy(*value).agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, owner: Column | None = None, repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document: counts, ``base`` and ``spans`` as text, and live and example values held.

    The owner is the ``source`` and the repository is (source, lang), unless given.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = candidates(docs, owner, repository)
    some = F.size("base") + F.size("bare") > 0
    held = found.filter(some).select("row", "owner", "repository", F.explode(F.concat("base", "bare")).alias("s")).select("row", "owner", "repository", "s.*")
    per_value = materialise(ownership(held).withColumn("own", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).select("h0", "h1", "n", "own"))
    span = F.struct("start", "kind", "stop")
    is_live = F.col("own") & F.col("live")
    judged = (
        join_per_key(held.drop("owner", "repository"), per_value, ["h0", "h1"], "n", ["row", "start"])
        .groupBy("row")
        .agg(
            F.array_sort(F.collect_list(F.when((F.col("kind") < 4) | is_live, span))).alias("all"),
            F.count_if(is_live).alias("n_live"),
            F.count_if(~F.col("own")).alias("n_example"),
        )
    )
    none = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    with_spans = found.filter(some).join(judged, "row").select("doc_id", "base", "all", "n_live", "n_example")
    without = found.filter(~some).select("doc_id", "base", empty.alias("all"), none.alias("n_live"), none.alias("n_example"))
    kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return with_spans.unionByName(without).select("doc_id", *(kind(k).alias(f"n_{KINDS[k - 1]}") for k in (1, 2, 3)), _written(F.col("base")).alias("base"), _written(F.col("all")).alias("spans"), "n_live", "n_example")
