"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, join_hot

PER_TASK = 100_000  # edges of a state in one file, so that small graphs leave few files


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(both, least, ["u"], 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_hot(down, least, ["u"], n).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (columns u, v; longs): component is the smallest id reachable.

    Neighbourhoods are never gathered: each star step takes a minimum per vertex (combined
    before the shuffle) and joins it back; the edges of vertices with very many of them stay
    where they are, and the few minima of these vertices are broadcast. Each round is
    checkpointed; a state is two longs per edge. Null ends and loops are ignored; repeated
    edges count once; no edges give no rows.
    """
    state = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:  # a handful of rounds
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        large = cut(_large_star(state, now[0]))
        state = cut(_small_star(large, now[0]).coalesce(max(1, -(-now[0] // PER_TASK))))
    return state.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(state.select("v", "v").distinct())
