"""Connected components of links between texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loofold.session import written_table


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, drawn towards the least neighbour of each end, twice.

    The first half is written, as the second reads it twice and the plan would hold it twice.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    large = written_table(large, "links")
    below = large.groupBy("u").agg(F.min("v").alias("m"))
    drawn = large.join(below, "u")
    return (
        drawn.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(drawn.select("u", F.col("m").alias("v")))
        .where("u > v")
        .distinct()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node of its component) of every linked node but the roots.

    Large-star and small-star rounds until nothing moves; each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round at most.
    """
    pair = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    edges = written_table(links.select(*pair).where("u > v").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, edges = state, written_table(_star(edges), "links")
