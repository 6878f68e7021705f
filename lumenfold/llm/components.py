"""Distributed connected components: alternating large-star and small-star rounds on an edge table.

Each round is a map-side combined minimum per vertex and a join back on the vertex. Where a vertex
holds a large share of all edges, its minimum is broadcast and its edges stay dealt out, so no
vertex's neighbours meet in one task. Rounds are written to the shared folder, so neither lineage nor
a lost executor costs earlier rounds. Rounds end when all edges form stars around least vertices.
Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import join_per_key, materialise
from lumenfold.skew import has_heavy


def _least(seen: DataFrame) -> DataFrame:
    return seen.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))


def _meet(seen: DataFrame, least: DataFrame, total: int | None) -> DataFrame:
    """Every edge with the least vertex around its ``a``."""
    return seen.join(least.drop("n"), "a") if total is None else join_per_key(seen, least, ["a"], "n", ["b"], total)


def _star(edges: DataFrame, large: bool, total: int | None) -> DataFrame:
    """edges: (a, b) with b < a. Large star looks at both directions, small star at the smaller side.

    ``total``, if given, bounds the edges seen, of which some vertex holds a large share.
    """
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = _least(seen)
    met = _meet(seen, least, total)
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _measure(edges: DataFrame) -> tuple[int, int, int]:
    """Of distinct edges (a, b) with b < a: their number, the most of one vertex, and the vertices that
    keep them from being stars around their least vertices, i.e. have a smaller neighbour and another one.

    Degrees are counted with a map-side combine.
    """
    ends = edges.select("a", F.lit(1).alias("smaller")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("smaller")))
    degrees = ends.groupBy("a").agg(F.count("*").alias("n"), F.sum("smaller").alias("smaller"))
    row = degrees.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count_if((F.col("smaller") > 0) & (F.col("n") > 1)).alias("open")).first()
    return (row["n"] or 0) // 2, row["most"] or 0, row["open"]


def star_forest(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(vertex, component), as a written table: each linked vertex but the smallest of each component.

    Self links and rows with a null end are ignored; repeated links count once. Without links the
    result is empty.
    """
    l, r = F.col(left).cast("long"), F.col(right).cast("long")
    edges = materialise(links.filter(l.isNotNull() & r.isNotNull() & (l != r)).select(F.greatest(l, r).alias("a"), F.least(l, r).alias("b")).distinct())
    number, most, still_open = _measure(edges)
    while still_open:
        total = 2 * number if has_heavy(most, 2 * number) else None
        edges = materialise(_star(_star(edges, True, total), False, total))
        number, most, still_open = _measure(edges)
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(vertex, component): each linked vertex with the smallest vertex it reaches."""
    stars = star_forest(links, left, right)
    return stars.unionByName(stars.select(F.col("component").alias("vertex"), "component").distinct())
