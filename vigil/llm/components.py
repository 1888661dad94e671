"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import forget, written


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> node, component (its smallest node). Nodes without a link are not named.

    Each round groups by node and joins the minima back, so a node with very many links is
    summed before it moves and its join partition can be split. Rounds grow with the logarithm
    of the longest path; their tables are written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        large = large.union(least.where(a != F.col("m")).select("a", F.col("m").alias("b"))).where(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, written(small, "links")
        forget(last)
        r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (r.n, r.s):
            break
        mark = (r.n, r.s)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(a.alias("node"), b.alias("component")).union(edges.select(b.alias("node"), b.alias("component"))).distinct()
