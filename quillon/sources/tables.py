"""Adapters from Parquet tables to documents and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs (ord, doc_id) of the documents table."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("doc_id"))


def token_features(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """(ord, feature, value): how often each lower-cased token occurs in each document.

    Together: texts are shuffled instead of counts, so a partition holds all features of its documents.
    """
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    exploded = (docs.repartition("doc_id") if together else docs).select(F.col("doc_id").alias("ord"), F.explode(tokens).alias("feature"))
    return exploded.groupBy("ord", "feature").agg(F.count(F.lit(1)).cast("double").alias("value"))


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, feature, value) of the embeddings, a feature per position."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.posexplode("embedding").alias("pos", "x"))
    return rows.select("ord", F.col("pos").cast("string").alias("feature"), F.col("x").cast("double").alias("value")).filter("value <> 0")


def supplier_part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, feature, value): quantity of each part that a supplier has delivered."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ord"), F.col("l_partkey").cast("string").alias("feature"))
    return rows.agg(F.sum("l_quantity").alias("value"))


def user_event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, feature, value): events of each type by user."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ord"), F.col("event_type").alias("feature"))
    return rows.agg(F.count(F.lit(1)).cast("double").alias("value"))
