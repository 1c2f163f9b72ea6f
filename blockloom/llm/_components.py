"""Connected components of a table of links, by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternates two steps that keep components: each node's larger neighbours are
    linked to its smallest, then its smaller ones are.  Stops when no link changes.
    Every step sends one row a link, so a node of many links costs no more than
    they do, and partial minima keep its group out of a single task.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Links whose larger end kept it as a neighbour are covered: each node has its smaller side in ``large``.
        large = materialize(large.where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = materialize(small.where("a <> b").distinct(), "links")
        # At rest every node has one link, to a node that has none itself.
        many = after.groupBy("a").count().where("count > 1").limit(1).count()
        chained = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() if not many else 1
        links = after
        if not many and not chained:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError("components did not settle")
