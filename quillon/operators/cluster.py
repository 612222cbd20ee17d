"""Cluster operators over unit features u (ord, feature, w) and assign (ord, cluster_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.rand import DEFAULT_SEED, hash_rand
from quillon.operators.weights import normalize, top_features, with_first
from quillon.plans.iteration import cut, small


def composite(u: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster_id, feature, s): sum of the members' unit vectors, combined before the shuffle."""
    return u.join(assign, "ord").groupBy("cluster_id", "feature").agg(F.sum("w").alias("s"))


def centroid(comp: DataFrame) -> DataFrame:
    """(cluster_id, feature, w): the normalised composite."""
    squared = comp.groupBy("cluster_id").agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    w = F.when(F.col("q") > 0, F.col("s") / F.sqrt("q")).otherwise(0.0)
    return comp.join(squared, "cluster_id").select("cluster_id", "feature", w.alias("w"))


def cluster_sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def points(u: DataFrame, assign: DataFrame, docs: DataFrame) -> DataFrame:
    """(cluster_id, ord, doc_id, point): similarity of every document to its cluster's centroid; 0 without features."""
    cents = centroid(composite(u, assign)).withColumnRenamed("w", "c")
    dots = u.join(assign, "ord").join(cents, ["cluster_id", "feature"]).groupBy("ord").agg(F.sum(F.col("w") * F.col("c")).alias("point"))
    return docs.join(assign, "ord").join(dots, "ord", "left").select("cluster_id", "ord", "doc_id", F.coalesce("point", F.lit(0.0)).alias("point"))


def sorted_points(found: DataFrame) -> DataFrame:
    """Points with pos (1..) by similarity descending, then ord."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("point", 9)), "ord")
    return found.withColumn("pos", F.row_number().over(order).cast("long"))


def centroid_top(cents: DataFrame, features: DataFrame, n: int = 50) -> DataFrame:
    """(cluster_id, rank, feature, w): the n heaviest features of each centroid, ties to the later vocabulary entry."""
    first = features.groupBy("feature").agg(F.min("ord").alias("first"))
    ranked = top_features(cents.join(first, "feature"), n, "cluster_id", "w", "rank")
    return ranked.select("cluster_id", "rank", "feature", "w")


def remove_members(assign: DataFrame, docs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """assign without the documents of these names (doc_id); composites of the rest follow from it."""
    gone = docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("ord")
    return assign.join(gone, "ord", "left_anti")


def by_size(assign: DataFrame) -> DataFrame:
    """(cluster_id, size, place): clusters from the largest on, equal ones by id; places of a few rows, one per cluster."""
    order = Window.orderBy(F.desc("size"), "cluster_id")
    return cluster_sizes(assign).withColumn("place", F.row_number().over(order).cast("long"))


def composite_norms(comp: DataFrame) -> DataFrame:
    """(cluster_id, norm)."""
    return comp.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))


def sectioned_gain(u: DataFrame, parent: DataFrame, child: DataFrame) -> DataFrame:
    """(cluster_id, gain): sum of the child composites' norms minus the parent's.

    parent: (ord, cluster_id); child: (ord, cluster_id, child).
    """
    own = composite_norms(composite(u, parent)).withColumnRenamed("norm", "own")
    parts = u.join(child, "ord").groupBy("cluster_id", "child", "feature").agg(F.sum("w").alias("s"))
    norms = parts.groupBy("cluster_id", "child").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    total = norms.groupBy("cluster_id").agg(F.sum("norm").alias("parts"))
    return own.join(total, "cluster_id").select("cluster_id", (F.col("parts") - F.col("own")).alias("gain"))


def choose_randomly(docs: DataFrame, k: int, seed: int = DEFAULT_SEED, tag: str = "random") -> DataFrame:
    """min(k, size) distinct documents, uniformly: the k smallest keyed random numbers (a top-k, no sort)."""
    return docs.select("ord", hash_rand(seed, tag, F.col("ord")).alias("r")).orderBy("r", "ord").limit(k)


def seed_weight(closest: Column, seed: int, tag: str, ord_: Column) -> Column:
    """Exponential race: the smallest value falls on a document with probability proportional to its weight."""
    return F.when(closest > 1e-12, -F.log(hash_rand(seed, tag, ord_)) / closest)


def similarity_to(u: DataFrame, one: DataFrame) -> DataFrame:
    """(ord, sim) of all documents that share a feature with the one vector (feature, x)."""
    return u.join(small(one), "feature").groupBy("ord").agg(F.sum(F.col("w") * F.col("x")).alias("sim"))


def choose_smartly(u: DataFrame, docs: DataFrame, k: int, seed: int = DEFAULT_SEED, tag: str = "smart") -> list[int]:
    """k seed documents (ords): the first uniform, each next with probability proportional to its smallest cosine distance.

    A weighted draw without prefix sums: every document runs an exponential race with its
    weight as rate, and the winner is a top-1. Where all weights vanish (all documents equal
    seeds) the smallest ord is drawn, so seeds can repeat.
    """
    first = choose_randomly(docs, 1, seed, f"{tag}-0").first()
    if first is None:
        return []
    seeds, closest = [first["ord"]], docs.select("ord", F.lit(None).cast("double").alias("closest"))
    for i in range(1, k):
        near = similarity_to(u, u.filter(F.col("ord") == seeds[-1]).select("feature", F.col("w").alias("x")))
        distance = F.lit(1.0) - F.coalesce("sim", F.lit(0.0))
        closest = cut(closest.join(near, "ord", "left").select("ord", F.greatest(F.lit(0.0), F.least(F.coalesce("closest", distance), distance)).alias("closest")))
        race = closest.select("ord", seed_weight(F.col("closest"), seed, f"{tag}-{i}", F.col("ord")).alias("race"))
        seeds.append(race.orderBy(F.asc_nulls_last("race"), "ord").first()["ord"])
    return seeds


def section(u: DataFrame, docs: DataFrame, seeds: list[int]) -> DataFrame:
    """(ord, cluster_id): every document with the seed of highest similarity, the first of equals; absent pairs count 0."""
    k = len(seeds)
    places = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(seeds)], "seed long, idx int")
    chosen = u.join(F.broadcast(places), F.col("ord") == F.col("seed")).select("feature", "idx", F.col("w").alias("x"))
    sims = u.join(small(chosen), "feature").groupBy("ord", "idx").agg(F.sum(F.col("w") * F.col("x")).alias("sim"))
    by_doc = sims.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("idx", "sim"))).alias("sims"))  # at most k entries
    full = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(F.round(F.coalesce(F.try_element_at("sims", i), F.lit(0.0)), 9).alias("sim"), (-i).alias("i")))
    best = F.when(F.col("sims").isNull(), 0).otherwise(-F.array_max(full)["i"])
    return docs.select("ord").join(by_doc, "ord", "left").select("ord", best.cast("long").alias("cluster_id"))


def unit(features: DataFrame) -> DataFrame:
    """(ord, feature, w): normalised features."""
    return normalize(features).select("ord", "feature", "w")


__all__ = ["centroid", "centroid_top", "choose_randomly", "choose_smartly", "cluster_sizes", "composite", "composite_norms", "points", "section", "sectioned_gain", "seed_weight", "similarity_to", "sorted_points", "unit", "with_first"]
