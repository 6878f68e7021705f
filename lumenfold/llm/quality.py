"""Quality rules: learned decision lists over text statistics, as native Spark conditionals.

Every statistic of a document is computed inside its own row, so scoring is one scan without a
shuffle. The decision list is learned on the driver from grouped label counts: sequential
covering grows a conjunction of thresholds on one part of the labelled rows, prunes it on the
other, removes what it covers and starts again. The list becomes one CASE expression.

Cases. A null or empty text has no words: all statistics are 0 and it fails the base rule. A null
doc_id is kept as a row. Repeated rows and ties are judged row by row, equally. An empty table
gives an empty result; without usable labels the list is empty and the default verdict "keep"
holds. Extra columns pass through, whatever their names, except that ``stats``, ``base_failed``,
``rule`` and ``kept`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fresh, let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


# ---------------------------------------------------------------- statistics of one text


def window_hashes(tokens: Column, width: int) -> Column:
    """A 64-bit hash of each ``width``-word window, in order; there must be ``width`` words or more.

    Words are hashed in pairs, then pairs of pairs, so that a word is read twice and not by every
    window that holds it. Where a window would pass the end, the hash means nothing and is cut off.
    """

    def widened(hashes: Column, step: int) -> Column:
        return let(hashes, lambda hs: F.zip_with(hs, F.slice(hs, step + 1, F.size(hs)), lambda x, y: F.xxhash64(x, y)))

    found, span = tokens, 1
    while span < width:
        step = min(span, width - span)
        found, span = widened(found, step), span + step
    return F.slice(found, 1, F.size(tokens) - (width - 1))


def repeated_window_words(tokens: Column, width: int = WINDOW) -> Column:
    """Words that lie in a ``width``-word window which occurs twice or more in the text.

    Windows are compared by a 64-bit hash first and, where hashes agree, word by word.
    """

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-width - 1).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"))
        return F.aggregate(starts, first, step, lambda acc: acc["n"])

    def twin(ranked: Column, ws: Column, x: Column, other: Column) -> Column:
        y = F.get(ranked, other)
        return F.coalesce((y["h"] == x["h"]) & (F.slice(ws, y["p"], width) == F.slice(ws, x["p"], width)), F.lit(False))

    def repeats(ws: Column, hashes: Column) -> Column:
        entries = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p")))
        return let(
            F.sort_array(entries),  # array_sort would compare by an interpreted lambda
            lambda ranked: covered(F.sort_array(F.transform(F.filter(ranked, lambda x, k: twin(ranked, ws, x, k - 1) | twin(ranked, ws, x, k + 1)), lambda x: x["p"]))),
        )

    def of(ws: Column) -> Column:
        hashes = F.when(F.size(ws) >= width, window_hashes(ws, width))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), repeats(ws, hs)).otherwise(F.lit(0).cast("long")))

    return F.coalesce(let(tokens, of), F.lit(0).cast("long"))


def with_statistics(docs: DataFrame, text: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """Add one struct column ``stats`` of long counts: the contract's four and those the rules use, or some of them.

    Counts of words are taken inside one lambda, where the planner can't leave out those that nobody
    reads; ``only`` does.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def asked(counts: dict[str, Column]) -> list[Column]:
        return [c.cast("long").alias(n) for n, c in counts.items() if only is None or n in only]

    def of_words(ws: Column) -> Column:
        same_as_next = F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda x, y: x.eqNullSafe(y))
        return F.struct(
            *asked(
                {
                    "n_words": F.size(ws),
                    "word_chars": F.char_length(F.array_join(ws, "")),
                    "n_distinct_words": F.size(F.array_distinct(ws)),
                    "n_stutters": F.size(F.array_remove(same_as_next, False)),
                    "n_repeat_words": repeated_window_words(ws),
                }
            )
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(*asked({"n_lines": F.size(ls), "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls))}))

    def count(pattern: str) -> Column:
        return F.char_length(body) - F.char_length(F.regexp_replace(body, pattern, ""))

    w, l = fresh(docs, "w"), fresh(docs, "l")
    characters = {"n_symbols": count(SYMBOLS), "n_marks": count(r"[!?]"), "n_capitals": count(r"[A-Z]"), "n_digits": count(r"[0-9]")}
    return (
        docs.withColumn(w, let(words(F.col(text)), of_words))
        .withColumn(l, let(lines, of_lines))
        .withColumn("stats", F.struct(f"{w}.*", f"{l}.*", *asked(characters)))
        .drop(w, l)
    )


def features(s: str = "stats") -> dict[str, Column]:
    """Integer features in thousandths; a text without words has 0 everywhere."""

    def per(count: str, total: str) -> Column:
        return F.coalesce(F.floor(F.col(f"{s}.{count}") * 1000 / F.nullif(F.col(f"{s}.{total}"), F.lit(0))), F.lit(0)).cast("long")

    return {
        "symbols": per("n_symbols", "n_words"),
        "marks": per("n_marks", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "digits": per("n_digits", "word_chars"),
        "word_length": per("word_chars", "n_words"),
        "stutters": per("n_stutters", "n_words"),
        "repeats": per("n_repeat_words", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "line_words": per("n_words", "n_lines"),
    }


# ---------------------------------------------------------------- learning the list


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def holds(self, row: dict[str, int]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, cols: dict[str, Column]) -> Column:
        return cols[self.feature] > self.threshold if self.above else cols[self.feature] <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    keep: bool = False

    def covers(self, row: dict[str, int]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def column(self, cols: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(cols)
        return out


#: A row of labelled statistics: feature values, documents labelled bad, documents labelled good.
Cell = tuple[dict[str, int], int, int]


def _counts(cells: Sequence[Cell], conditions: Sequence[Condition]) -> tuple[int, int]:
    bad = good = 0
    for row, b, g in cells:
        if all(c.holds(row) for c in conditions):
            bad, good = bad + b, good + g
    return bad, good


def _precision(bad: int, good: int) -> float:
    return (bad + 1) / (bad + good + 2)


def _candidates(cells: Sequence[Cell], names: Sequence[str], cuts: int) -> list[Condition]:
    """Thresholds midway between neighbouring values, at most ``cuts`` quantiles a feature."""
    out = []
    for name in names:
        values = sorted({row[name] for row, *_ in cells})
        gaps = [(a + b) // 2 for a, b in zip(values, values[1:])]
        picked = gaps if len(gaps) <= cuts else [gaps[k * (len(gaps) - 1) // (cuts - 1)] for k in range(cuts)]
        out += [Condition(name, above, t) for t in sorted(set(picked)) for above in (True, False)]
    return out


def _grow(cells: Sequence[Cell], names: Sequence[str], cuts: int, most: int) -> list[Condition]:
    """Add the condition of largest information gain until the rule covers no good document."""
    rule: list[Condition] = []
    inside = list(cells)
    for _ in range(most):
        bad, good = sum(c[1] for c in inside), sum(c[2] for c in inside)
        if not good or not bad:
            break
        base, best, gain = math.log2(bad / (bad + good)), None, 0.0
        for c in _candidates(inside, names, cuts):
            b, g = _counts(inside, [c])
            if b and (x := b * (math.log2(b / (b + g)) - base)) > gain + 1e-9:
                best, gain = c, x
        if best is None:
            break
        rule.append(best)
        inside = [x for x in inside if best.holds(x[0])]
    return rule


def _prune(cells: Sequence[Cell], rule: list[Condition]) -> list[Condition]:
    """Drop final conditions while that doesn't lower the precision on the pruning part."""
    while len(rule) > 1 and _precision(*_counts(cells, rule[:-1])) >= _precision(*_counts(cells, rule)):
        rule = rule[:-1]
    return rule


def learn_rules(cells: Sequence[Cell], names: Sequence[str], *, min_precision: float = 0.9, min_bad: int = 3, max_rules: int = 12, max_conditions: int = 4, cuts: int = 48) -> list[Rule]:
    """Sequential covering of the bad documents; a rule must hold its precision on all cells left."""
    left, rules = sorted(cells, key=lambda c: tuple(c[0][n] for n in names)), []
    while len(rules) < max_rules and sum(c[1] for c in left) >= min_bad:
        grow_on, prune_on = [c for k, c in enumerate(left) if k % 3], left[::3]
        rule = _prune(prune_on, _grow(grow_on, names, cuts, max_conditions))
        bad, good = _counts(left, rule)
        if not rule or bad < min_bad or _precision(bad, good) < min_precision:
            break
        rules.append(Rule(tuple(rule)))
        left = [c for c in left if not rules[-1].covers(c[0])]
    return rules


def base_failed(s: str = "stats") -> Column:
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


def labelled_cells(docs: DataFrame, labels: DataFrame, fit_rows: int) -> list[Cell]:
    """Grouped label counts of at most ``fit_rows`` labelled documents, those of smallest id hash.

    The sample of ids is bounded, which bounds the broadcast; so is the number of groups collected.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    cols = features()
    # a filter on base_failed would be pushed below the join and read every document's statistics
    groups = rows.select("quality", base_failed().alias("failed"), *(c.alias(n) for n, c in cols.items())).groupBy("failed", *cols).agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("quality") == 0, 0).otherwise(1)).alias("good"))
    return [({n: r[n] for n in cols}, r["bad"], r["good"]) for r in groups.collect() if not r["failed"]]


def quality_rules(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 12_000) -> list[Rule]:
    return learn_rules(labelled_cells(docs, labels, fit_rows), list(features()))


def apply_rules(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``stats``, ``base_failed``, ``rule`` (number of the first rule that fires) and ``kept``."""
    cols, chain = features(), F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        chain = F.when(rule.column(cols), F.lit(k)).otherwise(chain)
    verdict = F.lit(True)
    for k, rule in enumerate(rules, 1):
        verdict = F.when(F.col("rule") == k, F.lit(rule.keep)).otherwise(verdict)
    return with_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", chain).withColumn("kept", ~F.col("base_failed") & verdict)
