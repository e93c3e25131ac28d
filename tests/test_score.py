"""The formula, its levels and its null rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leesmaat.functions import score as S


def run(spark, rows):
    df = spark.createDataFrame(rows, "f double, s double, c double, p double")
    d = df.select(S.difficulty(F.col("f"), F.col("s"), F.col("c"), F.col("p")).alias("x"))
    return [tuple(r) for r in d.select("x", S.level(F.col("x")).alias("l")).collect()]


def test_published_values(spark):
    out = run(spark, [(5.2, 3.0, 4.5, 0.6), (5.364349123825101, 3.0, 4.0, 0.5)])
    assert out[0] == (pytest.approx(21.020445599999988, abs=1e-9), 1)
    assert out[1] == (pytest.approx(18.511612982419507, abs=1e-9), 1)


def test_any_null_gives_null(spark):
    full = [5.2, 3.0, 4.5, 0.6]
    rows = [tuple(None if i == k else v for i, v in enumerate(full)) for k in range(4)]
    assert run(spark, rows) == [(None, None)] * 4


def test_score_is_kept_within_bounds(spark):
    assert [r[0] for r in run(spark, [(0.0, 60.0, 30.0, 0.0), (9.0, 0.0, 0.0, 1.0)])] == [100.0, 0.0]


def test_level_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 33.999, 34.0, 45.9, 46.0, 57.9, 58.0, 100.0, None)], "x double")
    assert [r[0] for r in df.select(S.level(F.col("x"))).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, None]
    assert [r[0] for r in df.select(S.readers_struggling(S.level(F.col("x")))).collect()] == [14, 14, 29, 29, 53, 53, 78, 78, None]
