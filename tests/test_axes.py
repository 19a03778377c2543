import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relatum.functions import axes
from relatum.operators.composer import _fit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, fit", [("Am", "Am", 1.0), ("Am", "C", 0.95), ("Am", "Em", 0.85), ("Am", "Dm", 0.85), ("Am", "A", 0.8), ("Am", "Bbm", 0.6), ("Db", "C#", 1.0), ("A minor", "Am", 1.0), ("undetected", "undetected", 1.0), ("Am", "?", 0.1), ("Am", None, 0.0)])
def test_key_compatibility(spark, a, b, fit):
    assert value(spark, axes.key_compatibility(F.lit(a), F.lit(b))) == fit


def test_key_compatibility_in_python_is_the_same(spark):
    names = [*axes.KEYS, "?", "G major"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for r in df.select("a", "b", axes.key_compatibility(F.col("a"), F.col("b")).alias("f")).collect():
        assert r.f == _fit(r.a, r.b)


@pytest.mark.parametrize("a, b, least, most", [("2023-07-15 10:00:00", "2023-07-15 18:00:00", 0.99, 1.0), ("2023-07-15 10:00:00", "2023-08-15 10:00:00", math.exp(-30.44 / 180) - 1e-9, math.exp(-30.44 / 180) + 1e-9), ("2023-07-15", None, 0, 0), ("soon", "2023-07-15", 0, 0)])
def test_temporal(spark, a, b, least, most):
    assert least <= value(spark, axes.temporal(F.lit(a), F.lit(b))) <= most


@pytest.mark.parametrize("a, b, score", [("/a/b/c", "/a/b/c", 1.0), ("/a/b/c", "/a/b/d", 0.5), ("/a/b", "/a/b/c", 0.7), ("/a", "/a/b/c/d", 0.35), ("/x", "/a/b/c/d/e/f", 0.1), ("", "", 1.0), ("", "/", 0.0)])
def test_provenance(spark, a, b, score):
    assert value(spark, axes.provenance(F.lit(a), F.lit(b))) == pytest.approx(score)


@pytest.mark.parametrize("a, b, score", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 1.0, 0.0], [1.0, 0.0, 0.0], 0.70710678), ([1.0], [-1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0], [0.0], 0.0)])
def test_cosine(spark, a, b, score):
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(axes.cosine(F.col("a"), F.col("b")).alias("x")).first()
    assert row["x"] == pytest.approx(score)


def test_sentinels_and_missing_values(spark):
    assert value(spark, axes.bpm(F.lit(-1.0), F.lit(100.0))) == 0
    assert value(spark, axes.brightness(F.lit(-1.0), F.lit(0.5))) == 0
    assert value(spark, axes.hue(F.lit(350.0), F.lit(10.0))) == pytest.approx(1 - 20 / 180)
    assert value(spark, axes.aspect(F.lit(0.0), F.lit(1.0))) == 0
    assert value(spark, axes.duration(F.lit(None).cast("double"), F.lit(1.0))) == 0


def test_best_match_weighs_seed_segments(spark):
    ddl = "s array<struct<vector: array<float>, area_frac: double>>, c array<struct<vector: array<float>, area_frac: double>>"
    row = spark.createDataFrame([([([1.0, 0.0], 0.75), ([0.0, 1.0], None)], [([1.0, 0.0], 0.1)])], ddl)
    assert row.select(axes.best_match(F.col("s"), F.col("c")).alias("x")).first()["x"] == pytest.approx(0.75 / 1.75)


numbers = st.floats(0, 500, allow_nan=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=20))
def test_scores_are_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    for f in (axes.bpm, axes.spectral, axes.color_temp, axes.palette, axes.aspect, axes.duration):
        for r in df.select(f(F.col("a"), F.col("b")).alias("x"), f(F.col("b"), F.col("a")).alias("y")).collect():
            assert 0 <= r.x <= 1 and r.x == pytest.approx(r.y)
