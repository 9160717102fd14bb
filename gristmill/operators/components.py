"""Connected components of an edge table, by label propagation to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.runtime import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id of each id's component, for ids with an edge.

    ``edges``: a, b. Large-star and small-star rounds: the neighbours of a node are linked to
    its smallest neighbour, so paths shorten by halves, stars of any size are settled at once
    and no adjacency list is collected. Links and their smallest ends are found by partial
    aggregates; each round is cut. Null ends and loops are ignored.
    """
    links = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, move to its smallest neighbour
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(smallest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .union(smallest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = cut(small)
        state = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if seen == (state.n, state.h):
            break
        seen = (state.n, state.h)
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
