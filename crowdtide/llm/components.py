"""Connected components by alternating large and small stars; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); the root is the least node of the component.

    A large star links every greater neighbour of a node to the least node around it, a small star does so for the smaller ones; both keep components, and
    a few rounds leave stars.  Rows stay at most as many as edges.  Each round ends in the shared folder; two numbers per round reach the driver.
    """
    e = _down(edges.select("a", "b"))
    before = None
    while True:
        e = stored(e, name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _down(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        e = _down(joined.select("a", F.col("m").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))))
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater to the smaller node."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
