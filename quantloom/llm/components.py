"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import stored

MAX_ROUNDS = 60


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Per ``u``: the least of itself and its neighbours ``v``; combined before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``label`` (the least node it is connected with) for every node of an edge
    except the labels themselves.

    Each round links every node to the least node seen around it; a star of any
    size shrinks in one round. Rounds are stored in the shared folder, so a
    lost executor costs one round at most. Edges to oneself or with a null end
    are left out.
    """
    now = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter(F.col("u") < F.col("v")).distinct()
    now = stored(now, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter(F.col("v") > F.col("u")).select("v", F.col("m").alias("u")).filter(F.col("v") > F.col("u")).distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = _least_neighbour(down)
        small = down.join(least, "u").select(F.col("v"), F.col("m").alias("u")).filter(F.col("v") > F.col("u"))
        now = stored(small.unionByName(least.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("v").alias("node"), F.col("u").alias("label"))
        seen = state
    raise RuntimeError(f"no fixed point in {MAX_ROUNDS} rounds")
