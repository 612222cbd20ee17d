"""One pass of moving single documents between the parts of their group to raise the sum of composite norms.

State: moves (ord, grp, child) with child in 0..k-1; any number of groups is refined at once.
Composites are held wide, one column per child, so that a pass touches each feature cell once:

    comp (grp, feature, s0 .. s{k-1})     dots (ord, grp, child, d0 .. d{k-1})
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.plans.iteration import small

EPSILON = 1e-12
#: Composites of at most this many numbers may be broadcast (about 8 bytes each).
BROADCAST_CELLS = 4_000_000


def wide_composite(u: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """(grp, feature, s0..): composites of the parts."""
    sums = [F.sum(F.when(F.col("child") == j, F.col("w")).otherwise(0.0)).alias(f"s{j}") for j in range(k)]
    return u.join(state, "ord").groupBy("grp", "feature").agg(*sums)


def wide_norms(comp: DataFrame, k: int) -> DataFrame:
    """(grp, norms array, total): norms of the parts' composites and their sum."""
    each = [F.sqrt(F.sum(F.col(f"s{j}") * F.col(f"s{j}"))) for j in range(k)]
    grouped = comp.groupBy("grp").agg(F.array(*each).alias("norms"))
    return grouped.withColumn("total", F.aggregate("norms", F.lit(0.0), lambda t, x: t + x))


def gain_of_move(dots: Column, norms: Column, child: Column, j: Column, n: Column) -> Column:
    """Change of the norms' sum when a unit document (n = 1; 0: no features) moves from child to j."""
    own, other = F.get(norms, child), F.get(norms, j)
    leave = F.sqrt(F.greatest(F.lit(0.0), own * own + n - 2 * F.get(dots, child)))
    join = F.sqrt(F.greatest(F.lit(0.0), other * other + n + 2 * F.get(dots, j)))
    return leave + join - own - other


def best_moves(u: DataFrame, state: DataFrame, comp: DataFrame, norms: DataFrame, k: int) -> DataFrame:
    """(ord, grp, child, to, gain): every document's best other part (the lowest of equals)."""
    sums = F.array(*[F.sum(F.col("w") * F.col(f"s{j}")) for j in range(k)])
    own = F.sum(F.col("w") * F.col("w"))
    near = small(comp, BROADCAST_CELLS // k)  # then the features stay where they are, by document
    dots = u.join(state, "ord").join(near, ["grp", "feature"]).groupBy("ord", "grp", "child").agg(sums.alias("dots"), own.alias("n"))
    joined = dots.join(norms, "grp")
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: j != F.col("child"))
    options = F.transform(others, lambda j: F.struct(F.round(gain_of_move(F.col("dots"), F.col("norms"), F.col("child"), j, F.col("n")), 12).alias("gain"), (-j).alias("j")))
    return joined.withColumn("best", F.array_max(options)).select("ord", "grp", "child", (-F.col("best.j")).alias("to"), F.col("best.gain").alias("gain"))
