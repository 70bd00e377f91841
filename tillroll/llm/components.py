"""Connected components of a link table by alternating star joins.

Each round replaces links by links to smaller nodes (large star: a node's
larger neighbours point to its smallest neighbour; small star: its smaller
neighbours do) until every node points to the smallest node of its component.
Every step is an aggregate and a join over links, written to the shared folder;
no component is gathered in one place. The smallest neighbours are written
before they are joined, so adaptive execution can split a node of many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.store import materialize


def _digest(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _stars(links: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step on links u > v (``rows`` of them)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")),
                        "least", 2 * rows)
    large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
    large = materialize(large, "large", rows)
    low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low", rows)
    small = large.join(low, "u").select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return small.filter("u != v").distinct()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b; at most ``rows``):
    root is the smallest node that can be reached."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u != v").distinct(), "edges", rows)
    before = _digest(edges)
    while before[0]:
        edges = materialize(_stars(edges, before[0]), "edges", 2 * before[0])
        now = _digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
