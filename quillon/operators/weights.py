"""Weighting and pruning of features (ord, feature, value), and vector functions in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans import iteration
from quillon.plans.iteration import number_rows, stage


def vocabulary(features: DataFrame) -> DataFrame:
    """(feature, code): dense codes in order of first document, then feature."""
    first = features.groupBy("feature").agg(F.min("ord").alias("first"))
    return number_rows(first, "code", "first", "feature").select("feature", "code")


def count_df(features: DataFrame) -> DataFrame:
    """(feature, df): documents that hold each feature."""
    return features.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))


def idf(features: DataFrame, n_docs: int, df: DataFrame | None = None) -> DataFrame:
    """value * ln(n_docs / df); a feature missing from df counts 1. Zero results stay."""
    counted = df if df is not None else count_df(features)
    joined = features.join(counted, "feature", "left")
    return joined.select("ord", "feature", (F.col("value") * F.log(F.lit(float(n_docs)) / F.coalesce("df", F.lit(1)))).alias("value"))


def standard_score(features: DataFrame) -> DataFrame:
    """10 (x - mean) / sd + 50 over all stored values of the corpus; sd 0 gives 50."""
    stats = features.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    scaled = F.when(F.col("sd") > 0, F.col("value") - F.col("mean")).otherwise(0.0) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    # one row by construction
    return features.join(F.broadcast(stats)).select("ord", "feature", (10 * scaled + 50).alias("value"))


def top_features(features: DataFrame, n: int, key: str = "ord", value: str = "value", rank: str | None = None) -> DataFrame:
    """The n features of largest absolute value of each key.

    Ties go to the feature that entered the vocabulary later: the larger (first, feature)
    pair, which orders like the dense code but needs no global numbering. Where the frame has
    no column ``first`` the larger feature wins.
    """
    ties = [F.desc("first"), F.desc("feature")] if "first" in features.columns else [F.desc("feature")]
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs(value), 9)), *ties)
    name = rank or "__rank"
    ranked = features.withColumn(name, F.row_number().over(order).cast("long")).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def firsts(features: DataFrame) -> DataFrame:
    """(feature, first): the smallest ord that holds each feature."""
    return features.groupBy("feature").agg(F.min("ord").alias("first"))


def heaviest(features: DataFrame, n: int, value: str = "value", rank: str | None = None) -> DataFrame:
    """The n features of largest absolute value of each ord, ties to the later vocabulary entry.

    Only features within the first n places or tied with them meet their first documents, so
    the join on features moves about n rows a document, not all of them.
    """
    order = Window.partitionBy("ord").orderBy(F.desc(F.round(F.abs(value), 9)))
    near = features.withColumn("__place", F.rank().over(order)).filter(F.col("__place") <= n).drop("__place")
    return top_features(near.join(firsts(features), "feature").select(*features.columns, "first"), n, "ord", value, rank)


def heaviest_idf(features: DataFrame, n_docs: int, n: int) -> DataFrame:
    """``heaviest`` features of ``idf``, without moving all features to their counts.

    Only features of two documents or more are counted in a table; any other has df 1 and its
    own document as first. While that table may be broadcast, the features stay where they are
    and about n rows a document are shuffled for each partition that holds some of its features.
    Of a larger table the features of most documents are broadcast, so only the rows of rarer
    ones, the fewest of all, are moved to their counts.
    """
    counted = stage(features.groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.min("ord").alias("first")).filter("df > 1"), "counted")
    least = least_df(counted)
    if least <= 2:
        joined = features.join(F.broadcast(counted), "feature", "left")
    else:
        often, seldom = F.broadcast(counted.filter(F.col("df") >= least)), counted.filter(F.col("df") < least)
        rare = features.join(often, "feature", "left_anti").join(seldom, "feature", "left")
        joined = features.join(often, "feature").select(*features.columns, "df", "first").union(rare.select(*features.columns, "df", "first"))
    value = F.col("value") * F.log(F.lit(float(n_docs)) / F.coalesce("df", F.lit(1)))
    weighted = joined.select("ord", "feature", value.alias("value"), F.coalesce("first", "ord").alias("first"))
    order = Window.partitionBy("ord").orderBy(F.desc(F.round(F.abs("value"), 9)), F.desc("first"), F.desc("feature"))
    return weighted.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).select("ord", "feature", "value")


def least_df(counted: DataFrame) -> int:
    """The smallest df from which on the features of a table (feature, df) may be broadcast."""
    least, total = 1 << 62, 0
    for r in counted.groupBy("df").count().orderBy(F.desc("df")).toLocalIterator():  # a row per df, so about the root of the features' number
        total += r["count"]
        if total > iteration.BROADCAST_ROWS:
            return least
        least = r["df"]
    return 2


def with_first(features: DataFrame) -> DataFrame:
    """Features with ``first``, the smallest ord that holds them."""
    return features.join(features.groupBy("feature").agg(F.min("ord").alias("first")), "feature").select(*features.columns, "first")


def norms(features: DataFrame, key: str = "ord", value: str = "value") -> DataFrame:
    """(key, n, norm_squared, norm)."""
    squared = F.sum(F.col(value) * F.col(value))
    return features.groupBy(key).agg(F.count(F.lit(1)).alias("n"), squared.alias("norm_squared"), F.sqrt(squared).alias("norm"))


def normalize(features: DataFrame, key: str = "ord", value: str = "value", out: str = "w") -> DataFrame:
    """Features with ``out``, the value over the norm of its vector (0 for a norm of 0); one shuffle on the key."""
    squared = F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key))
    kept = [c for c in features.columns if c != out]
    return features.withColumn("__n", F.sqrt(squared)).select(*kept, F.when(F.col("__n") > 0, F.col(value) / F.col("__n")).otherwise(0.0).alias(out))


def add_vectors(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """a + sign * b over (ord, feature, value); cancelled features stay, with value 0."""
    both = a.select("ord", "feature", "value").union(b.select("ord", "feature", sign * F.col("value")))
    return both.groupBy("ord", "feature").agg(F.sum("value").alias("value"))


def pair_measures(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every measure for pairs (a, b) of vectors: inner, euclid_sq, euclid, cosine and jaccard.

    The inner product is an equi-join on (pair, feature); the distance follows from it and
    the norms, so no outer join over the union of features is needed. Pairs without a common
    feature and vectors without features count as 0.
    """
    size = norms(features).select("ord", "norm_squared")
    left = pairs.join(features.select(F.col("ord").alias("a"), "feature", F.col("value").alias("x")), "a")
    right = features.select(F.col("ord").alias("b"), "feature", F.col("value").alias("y"))
    inner = left.join(right, ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("inner"))
    zero = F.lit(0.0)
    whole = pairs.join(inner, ["a", "b"], "left").join(size.select(F.col("ord").alias("a"), F.col("norm_squared").alias("na")), "a", "left").join(size.select(F.col("ord").alias("b"), F.col("norm_squared").alias("nb")), "b", "left")
    filled = whole.select("a", "b", *[F.coalesce(c, zero).alias(c) for c in ("inner", "na", "nb")])
    squared = F.greatest(zero, F.col("na") + F.col("nb") - 2 * F.col("inner"))
    product = F.sqrt("na") * F.sqrt("nb")
    rest = F.sqrt("na") + F.sqrt("nb") - F.col("inner")
    ratio = lambda d: F.when(d != 0, F.col("inner") / d).otherwise(zero)
    return filled.select("a", "b", "inner", squared.alias("euclid_sq"), F.sqrt(squared).alias("euclid"), ratio(product).alias("cosine"), ratio(rest).alias("jaccard"))
