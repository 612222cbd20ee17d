"""Mixing sources to target weights by Poisson replication.

A source with target weight w_s, of n_s documents out of N, has mean repetition rate
``w_s * budget / n_s`` (budget: N unless given). Each document draws its number of copies
from the Poisson distribution of that mean by inverting the distribution function at a
uniform number that is a hash of seed and doc_id; the copies are exploded and the whole
table is put into a global random order by a second hash. Everything is a DataFrame
expression, and a rerun draws the same copies wherever a row happens to be processed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A Poisson mean above this is drawn as a sum of independent equal parts below it, so exp(-mean) never underflows.
PART = 16.0
#: Terms of the distribution function kept for one part: the rest of a Poisson(16) lies below 1e-22.
TERMS = 80
#: The table of sources is broadcast up to this many rows (about 700 bytes each); beyond, it is joined with salt.
BROADCAST_SOURCES = 5_000
SALTS = 32


def uniform(*parts: Column) -> Column:
    """52 bits of md5 over the parts joined by '|', as a double in [0, 1)."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, budget: float | None) -> DataFrame:
    """source, rate, parts (draws to add up) and cdf (of one part); sources of weight 0 have rate 0.

    weights None: the same weight for every source, null included. Given weights are
    normalised; sources that they lack get no copies.
    """
    counts = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sources"))
    # one row by construction, so broadcasting it is bounded
    joined = counts.join(F.broadcast(total))
    if weights is None:
        share = F.lit(1.0) / F.col("sources")
    else:
        whole = float(sum(weights.values())) or 1.0
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source") == F.lit(name), F.lit(w / whole)).otherwise(share)
    rate = share * (F.col("total").cast("double") if budget is None else F.lit(float(budget))) / F.col("n")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PART))).cast("int")
    rates = joined.select("source", rate.alias("rate")).select("source", "rate", parts.alias("parts"))
    mean = F.col("rate") / F.col("parts")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    grow = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * mean / k)).alias("cdf"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, grow, lambda s: s["cdf"])
    return rates.withColumn("cdf", cdf)


def _copies(docs: DataFrame, weights: dict[str, float] | None, budget: float | None, seed: int) -> DataFrame:
    """d (a struct of all columns of docs), copy (1..) and shuffle_key of every copy, in global random order."""
    rates = source_rates(docs.select("source"), weights, budget)
    left = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("d"))
    right = rates.select(F.col("source").alias("r_source"), "rate", "parts", "cdf")
    source = F.col("d.source")
    if rates.count() <= BROADCAST_SOURCES:
        joined = left.join(F.broadcast(right), source.eqNullSafe(F.col("r_source")))
    else:
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.withColumn("l_salt", F.pmod(F.hash("d.doc_id"), F.lit(SALTS))).join(right, source.eqNullSafe(F.col("r_source")) & (F.col("l_salt") == F.col("salt")))
    name = F.coalesce(F.col("d.doc_id").cast("string"), F.lit(""))
    drawn = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(str(seed)), name, j.cast("string")))
    copies = F.aggregate(drawn, F.lit(0), lambda total, u: total + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    rows = joined.filter(F.col("rate") > 0).select("d", copies.alias("n")).filter(F.col("n") > 0)
    exploded = rows.select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), name, F.col("copy").cast("string")))
    return exploded.withColumn("shuffle_key", key).orderBy("shuffle_key", "d.doc_id", "copy")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The columns of docs, copy (1..) and shuffle_key of every copy, in global random order.

    Documents are never shuffled by source, so a source that holds a third of the rows costs
    nothing extra; the only shuffle is the closing global sort. Null sources form a source of
    their own; repeated rows draw the same number of copies each; a null doc_id counts as the
    empty string in the hashes; null, empty and very long texts are carried as they are; an
    empty table gives an empty result. Columns of docs named copy or shuffle_key give way.
    """
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    return _copies(docs, weights, budget, seed).select(*[F.col("d")[c].alias(c) for c in names], "copy", "shuffle_key")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The same with the columns of docs only, all as they were, whatever their names."""
    return _copies(docs, weights, budget, seed).select(*[F.col("d")[c].alias(c) for c in docs.columns])
