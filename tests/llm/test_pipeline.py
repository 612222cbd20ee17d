"""The queries of the subpackage on the smallest tables, and the pipeline against brute force."""

import sys
import zlib

import brute
import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from quillon.llm import oracles, queries
from quillon.llm.common import table


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    result = con.execute(oracles.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(plain, df.select(*columns).collect()), key=repr) == sorted(map(plain, result.fetchall()), key=repr)


def test_near_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    assert {r["doc_id"]: r["component_id"] for r in queries.op2_near_dedup(spark, SMALL).collect()} == brute.components(rows)


def test_secret_query(spark):
    rows = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    for r in queries.op8_secret_scan(spark, SMALL).collect():
        base = brute.secret_spans(rows[r["doc_id"]])
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(base) and set(base) <= set(r["spans"].split(",")) | {""}


def written(df, folder):
    """As a stage's output reaches the next one."""
    df.write.parquet(str(folder))
    return df.sparkSession.read.parquet(str(folder))


def tokens_of(rows):
    """(doc_id, CRC of the ids) of every row."""
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return sorted(((r["doc_id"], zlib.crc32(np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in rows), key=repr)


def test_stages(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    before = ids
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, SMALL), tmp_path / name)
        assert docs.columns == columns
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after < before
        if name == "near_dedup":
            assert len(set(brute.components([(r["doc_id"], r["text"]) for r in docs.collect()], 5).values())) == docs.count()
        before = after
    mixed = written(corpus_pipeline.mix_sources(spark, docs, SMALL), tmp_path / "mixed")
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} <= before
    want = tokens_of(mixed.collect())
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.write_tokens(spark, mixed, SMALL).collect()), key=repr) == want
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in found), key=repr) == want
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order != sorted(order)


HOSTILE = "doc_id long, text string, lang string, source string, n_chars long, copy long, shuffle_key string, score double, key string, h long, vertex long, n long, item_id long, __id long, gram long"


@pytest.fixture
def hostile(spark, tmp_path):
    """Documents with nulls in every column, repeated rows and ids, and columns named like the operators' own."""
    texts = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").limit(60).collect()]
    odd = [(None, None), (None, ""), (None, "no id but a text of its own that nothing else has"), (None, None), (5000, None), (5000, "one id with a first text here"), (5000, "one id with quite another text here"), (5001, " "), texts[0], texts[0], (5002, texts[1][1]), (5003, "w " * 50_000)]
    odd += [(5004, r["text"]) for r in table(spark, SMALL, "benchmark").limit(1).collect()] + [(None, r["text"]) for r in table(spark, SMALL, "benchmark").limit(1).collect()]
    rows = [(i, t, None, None if k % 3 else "s", None, 7, "x", 0.5, None, 1, 2, 3, 4, 5, 6) for k, (i, t) in enumerate(texts + odd)]
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    spark.createDataFrame(rows, HOSTILE).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages_on_hostile_rows(spark, hostile, tmp_path):
    docs = table(spark, hostile, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, hostile), tmp_path / name)
        assert docs.columns == columns
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert {(r["copy"], r["shuffle_key"], r["__id"]) for r in docs.collect()} == {(7, "x", 5)}
    clean = [(None, "no id but a text of its own that nothing else has"), (5000, "one id with a first text here"), (5000, "one id with quite another text here"), (5001, " "), (5000, None)]
    for name in ("toxicity", "near_dedup", "decontaminate"):
        assert all(kept[name].count(x) == 1 for x in clean) and kept[name].count((None, None)) == 2
    benchmark = table(spark, SMALL, "benchmark").first()["text"]
    assert not [x for x in kept["decontaminate"] if x[1] and benchmark in x[1]]
    assert len(kept["near_dedup"]) == len(set(kept["near_dedup"])) + 1
    found = corpus_pipeline.run(spark, hostile).collect()
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in found), key=repr) == tokens_of(docs.collect())


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_bytes_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    want = {i: x for (i, _), x in zip(rows, brute.without_repeats([t for _, t in rows]), strict=True)}
    found = queries.op3_repeated_bytes(spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found} == want and len(found) == len(rows)


def test_quality_query(spark):
    rows = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    found = queries.op4_quality_rules(spark, SMALL).collect()
    assert len(found) == len(rows)
    for r in found:
        counts = brute.quality_counts(rows[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_added_secrets_of_the_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    want = {i: [f"random:{a}:{b}" for a, b in spans] for (i, _), spans in zip(rows, brute.random_spans([t for _, t in rows]), strict=True)}
    found = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("random")] for r in queries.op8_secret_scan(spark, SMALL).collect()}
    assert found == want


def test_token_query(spark):
    rows = table(spark, SMALL, "documents").collect()
    found = queries.op9_token_files(spark, SMALL).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in rows)
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in found), key=repr) == tokens_of(rows)


def test_nothing_else_imports_the_subpackage():
    import pathlib

    top = pathlib.Path(sys.modules["quillon"].__file__).parent
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "quillon.llm" in p.read_text()]
