"""A corpus pipeline over documents: five operators, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from quillon.llm.common import stage, table
from quillon.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below the toxicity threshold.

    Null and empty texts score like texts without evidence and stay; repeated rows are judged
    alike; an empty table stays empty; extra columns, whatever their names, are kept.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle sets of similarity 0.8 or more.

    The smallest doc_id of a group stays (null last), of repeated rows one; rows of one id with
    different texts are judged apart; rows without words all stay.
    """
    return near_dedup.drop_near_duplicates(docs, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; every row is judged by its own text, null and empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to equal weights of their sources, in global random order; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of equal-length sequences in the order of the mix, read back: one row per (repeated) document.

    The order is that of the rows in the Parquet files that the stage reads. Null and empty
    texts give just the end id; null ids stay null; an empty table gives no rows.
    """
    folder = token_files.default_folder(spark)
    token_files.write_token_files(docs, folder, tokenizer_path(), end_id=2, order=token_files.file_order(docs))
    return token_files.read_documents(spark, folder)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

#: Learned scores, components and tokens are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
