import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import strings, vectors
from quillon.operators import weights as wt

A, B = {"1": 1.0, "2": 2.0, "3": 3.0}, {"1": 3.0, "2": 2.0, "3": 1.0}


def value(spark, column, **maps):
    row = spark.createDataFrame([tuple(maps.values())], ", ".join(f"{k} map<string,double>" for k in maps))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "a", "b", "expected"),
    [
        (vectors.inner_product, A, {"1": 3.0, "2": 6.0, "3": 9.0}, 42),
        (vectors.euclid_distance_squared, A, {"1": 3.0, "2": 6.0, "3": 9.0}, 56),
        (vectors.cosine, A, {"1": 3.0, "2": 6.0, "3": 9.0}, 1),
        (vectors.cosine, A, B, 10 / 14),
        (vectors.jaccard, A, B, -3.973481),
        (vectors.inner_product, {"p": 1.0, "q": 2.0}, {"q": 3.0, "r": 4.0}, 6),
        (vectors.euclid_distance, {"p": 1.0, "q": 2.0}, {"q": 3.0, "r": 4.0}, 4.242641),
        (vectors.jaccard, {"p": 1.0, "q": 2.0}, {"q": 3.0, "r": 4.0}, 4.854102),
        (vectors.cosine, {}, {}, 0),
        (vectors.jaccard, {}, A, 0),
        (vectors.cosine, {"z": 0.0}, A, 0),
    ],
)
def test_pairs(spark, f, a, b, expected):
    assert value(spark, f(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(expected, abs=1e-6)


def test_single(spark):
    a = F.col("a")
    assert value(spark, vectors.norm(a), a=A) == pytest.approx(math.sqrt(14))
    assert [e["key"] for e in value(spark, vectors.sorted_items_abs(a), a={"1": 1.0, "2": -2.0, "3": 3.0})] == ["3", "2", "1"]
    assert [e["key"] for e in value(spark, vectors.sorted_items(a), a={"x": 1.0, "y": 1.0, "z": -9.0})] == ["y", "x", "z"]
    assert value(spark, vectors.resize(a, 2), a={"1": 1.0, "2": -2.0, "3": 3.0}) == {"2": -2.0, "3": 3.0}
    assert value(spark, vectors.resize(a, 5), a=A) == A
    assert value(spark, vectors.normalize(a), a={"z": 0.0}) == {"z": 0.0}
    assert value(spark, vectors.normalize(a), a={"x": 3.0, "y": 4.0}) == pytest.approx({"x": 0.6, "y": 0.8})
    assert value(spark, vectors.get(a, F.lit("no")), a=A) == 0
    assert value(spark, vectors.put(a, F.lit("1"), F.lit(0.0)), a=A) == {"1": 0.0, "2": 2.0, "3": 3.0}
    assert value(spark, vectors.clear(a), a=A) == {}
    assert value(spark, vectors.size(a), a=A) == 3


def test_delete_keeps_cancelled_keys(spark):
    assert value(spark, vectors.delete_vector(F.col("a"), F.col("b")), a=A, b=A) == {"1": 0.0, "2": 0.0, "3": 0.0}


def test_forms_agree(spark):
    rows = [(0, k, v) for k, v in A.items()] + [(1, k, v) for k, v in B.items()]
    features = spark.createDataFrame(rows, "ord long, feature string, value double")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    found = {(r["a"], r["b"]): r for r in wt.pair_measures(features, pairs).collect()}
    assert found[0, 1]["inner"] == 10 and found[0, 1]["euclid_sq"] == pytest.approx(8) and found[0, 1]["jaccard"] == pytest.approx(-3.973481)
    assert found[0, 2]["inner"] == 0 and found[0, 2]["cosine"] == 0 and found[0, 2]["euclid_sq"] == pytest.approx(14)


@pytest.mark.parametrize(("name", "expected"), [("a.tar.gz", "gz"), ("test", ""), ("test.tsv.", ""), (".x", "x")])
def test_extension(spark, name, expected):
    assert spark.range(1).select(strings.get_extension(F.lit(name))).first()[0] == expected


def test_split(spark):
    assert spark.range(1).select(strings.split_string(F.lit(",a;;b,é;"), ",;")).first()[0] == ["a", "b", "é"]
