"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import materialise, release

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any ordered type -> (node, root): root is the smallest node reachable.

    Self-loops, repeated edges and null ends are ignored; an empty edge table gives an empty result. Minima are
    aggregated map-side, so a node with very many links never lands in one task; each round is written to the
    shared folder."""
    ends = edges.where("u is not null and v is not null and u <> v")
    state = materialise(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        nxt = materialise(_small_star(_large_star(state)), "links")
        release(state)
        state = nxt
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
