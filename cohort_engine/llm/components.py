"""Connected components of a table of links, by alternating large-star and
small-star rounds (Kiveris et al., 2014).  Links stay in Spark; every round is
a few equi-joins and map-side-combined minima, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_engine.llm.store import written

ROUNDS = 60                     # far above log^2 of any number of nodes


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links (a, b), a > b.  Large star: each node ties its larger neighbours
    to its smallest neighbour (or itself); small star: each node ties its
    smaller neighbours and itself to the smallest of them."""
    if small:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    tied = near.join(least, near["u"] == least["w"])
    if small:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w"), F.col("m")))
    else:
        out = tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b of long): root is
    the smallest node reachable, itself included.  Null ends are left out."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    last = mark(edges)
    for _ in range(ROUNDS):
        edges = written(_star(_star(edges, False), True), "links")
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct())
