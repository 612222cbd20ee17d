"""Some registered queries against their DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", ["tsv_parse", "vocab_codes", "vec_topn", "pair_jaccard", "vec_map_functions", "idf_weight", "cluster_points", "smart_seeds", "section_assign", "refine_one_pass", "classify_indexed", "classify_truncated", "text_corpus", "stream_classified", "phi_text", "theta_text", "random_strings", "standard_score", "centroid_text", "plsi_membership_norm", "split_tokens"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["plsi_membership", "plsi_membership_norm", "membership_text"])
def test_memberships_of_documents_without_tokens(spark, tmp_path, name):
    texts = ["red green red", None, "", "green blue", "!? --", "blue blue red"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert {r[0] for r in want} == {0, 3, 5}
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
