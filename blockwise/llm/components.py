"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import fixed, skew_left_join


def components(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``node, root`` for the nodes of ``links`` (``a, b``, longs): root is the smallest node of the component.

    With ``roots`` (what this returned for earlier links) the components of all links together: the new ones
    are closed over the roots of their nodes, so earlier links are not walked again.

    Alternates large-star and small-star steps until the links are stars: every node's larger (then smaller)
    neighbours are moved to its smallest neighbour. The number of rounds grows with the logarithm of the number
    of nodes; each step is a written table, so that no plan holds more than one, and no neighbourhood is
    collected: the smallest neighbour is an aggregate with map-side combine, joined back to the links.
    """
    a, b = F.col("a"), F.col("b")
    if roots is not None:
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        links = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        a, b = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
    edges = fixed(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while (loose := _most_ends(edges)) > 1:  # every link goes from its larger node u to its smaller one v
        low = edges.union(edges.select("v", "u")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        large = fixed(large.union(low.where("u <> m").select("u", F.col("m").alias("v"))), "links-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = fixed(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    if roots is not None and not loose:
        return roots
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    stars = stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    if roots is not None:
        stars = fixed(stars, "roots")
        moved = skew_left_join(roots, stars.select(F.col("node").alias("root"), F.col("root").alias("low")), "root")
        stars = moved.select("node", F.coalesce("low", "root").alias("root")).union(stars.join(roots, "node", "left_anti"))
    return fixed(stars, "roots")


def _most_ends(edges: DataFrame) -> int:
    """The largest of the nodes' numbers of links to a smaller node, and one more if it has links to larger ones.

    0 without links; 1 if the links are stars: no node has two smaller neighbours, or a smaller and a larger one.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("ends")).agg(F.max("ends")).first()[0] or 0
