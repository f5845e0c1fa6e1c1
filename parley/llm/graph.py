"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.scratch import Scratch


def _pull(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: neighbours hang on the least node near them. Minima are combined before
    the shuffle, and the join back to the edges has one row a node on its other side."""
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a row (a, b) of ``both``: b is a neighbour of a; in a small step b < a already
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    told = both.join(low, "a")
    if small:
        hung = told.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    else:
        hung = told.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the least node that it reaches.

    Alternating large and small star steps (Kiveris et al. 2014): the number of rounds grows
    with the logarithm of the longest chain. Links may repeat and stand in either order; a link
    of a node with itself is ignored, null ends too.
    """
    edges = scratch.save(
        links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        after = scratch.save(_pull(_pull(edges, small=False), small=True))
        scratch.drop(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
