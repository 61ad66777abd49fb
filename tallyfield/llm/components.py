"""Connected components of a table of links, by stars that shrink to one centre each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import written


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): for each linked node the smallest node that links reach from it.

    Each round hangs the larger neighbours of every node on its smallest one, then the smaller
    ones likewise. Both are a minimum per node and a join, the tables of a round are written, and
    the number of rounds grows with the logarithm of the longest path. Isolated nodes and links
    of a node with itself give no row.
    """
    a, b = F.col(left), F.col(right)
    edges = written(
        links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        )
        large = written(large.distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where(F.col("u") != F.col("v"))
        edges = written(small.distinct(), "small-stars")
        now = tuple(
            edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
