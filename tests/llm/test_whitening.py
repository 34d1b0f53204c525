"""Whitening against numpy on whole matrices, with vectors of every odd kind."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import whitening
from loomwork.llm.queries import op12_tiled_whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, n int, whitened double"


def vectors(spark, dims: int = 7):
    rng = random.Random(6)
    mixed = [[rng.gauss(0, 1 + k) + (k % 3) for k in range(dims)] for _ in range(60)]
    rows = [*mixed, mixed[0], mixed[0], mixed[1], None, [], mixed[2][:4], [*mixed[3][:-1], None], [*mixed[3][:-1], math.nan], [*mixed[3][:-1], math.inf], [*mixed[3][:-1], 1e30]]
    return spark.createDataFrame([(None if i == 5 else i % 50, r, "clash", 1, 2.0) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def expected(rows: list[list[float]], dims: int, k: int):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r] + [1_000_000] * (dims - len(r)) for r in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = lambda m: (m - s // n) - (s % n) / n
    v = centred(fit).T @ centred(fit) / n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    return n, centred(x) @ (axes[:, order] / np.sqrt(values[order])), [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x], values[order] / np.trace(v)


@pytest.mark.parametrize("block,row_block", [(3, 4), (32, 2048), (2, 1000), (1, 7)])
def test_whitened_vectors(spark, block, row_block):
    table = vectors(spark)
    rows = whitening.fixed_point(table.withColumnRenamed("x", "y"), "embedding")
    model = whitening.fit(rows, components=5, block=block, row_block=row_block)
    got = rows.select("embedding", "vec_id", whitening.whitened(rows, model).alias("r")).collect()
    assert len(got) == 65 and [r["vec_id"] for r in got].count(None) == 1
    n, want, deviation, explained = expected([r["embedding"] for r in got], 7, 5)
    found = np.array([r["r"]["whitened"] for r in got])
    sign = np.sign((found * want).sum(axis=0))
    assert model.n == n == 62 and np.abs(found - want * sign).max() < 1e-9
    assert [r["r"]["deviation"] for r in got] == deviation
    assert np.allclose(model.explained, explained, rtol=1e-12) and model.identity_error < 1e-9


def test_identity_error_is_measured(spark):
    """Weights that don't whiten give the error that numpy gives for them."""
    rows = whitening.fixed_point(vectors(spark).drop("x"), "embedding")
    model = whitening.fit(rows, components=4)
    model.weights *= 1.1
    distinct = rows.select("x").distinct()
    again = whitening.tiled_covariance(distinct, lambda x: model.whitened(whitening._matrix(x)), 4, model.n, block=2)
    assert np.allclose(np.abs(again - np.eye(4)).max(), 1.1**2 - 1)


def test_vectors_without_variance(spark):
    of = lambda rows: whitening.fixed_point(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>"), "embedding")
    for rows in ([], [[]], [[], []], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [None]):
        table = of(rows)
        model = whitening.fit(table)
        assert len(model.explained) == 0
        assert all(list(r["w"]["whitened"]) == [] and r["w"]["deviation"] == 0 for r in table.select(whitening.whitened(table, model).alias("w")).collect())
    flat = of([[1.0, 2.0, 0.0], [2.0, 2.0, 0.5], [4.0, 2.0, 1.5]])  # a line
    model = whitening.fit(flat)
    assert len(model.explained) == 1 and model.explained[0] == pytest.approx(1) and model.identity_error < 1e-9


def test_large_offsets_do_not_blur(spark):
    """Centred before they are multiplied: entries near 2**40 that differ in their last bits."""
    rows = [[float(2**40 + i % 3), float(i % 5)] for i in range(30)]
    table = whitening.fixed_point(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>"), "embedding")
    model = whitening.fit(table)
    assert model.identity_error < 1e-9
    got = table.select(whitening.whitened(table, model).alias("w")).select(F.posexplode("w.whitened").alias("at", "v")).groupBy("at").agg(F.max(F.abs("v")).alias("v")).collect()
    assert all(0.5 < r["v"] < 3 for r in got) and len(got) == 2


def test_a_deviation_beyond_a_long_is_null(spark):
    table = whitening.fixed_point(spark.createDataFrame([(0, [float(2**44)]), (1, [0.0]), (2, [1.0])], "vec_id bigint, embedding array<double>"), "embedding")
    model = whitening.fit(table)
    assert [r["w"]["deviation"] for r in table.select("vec_id", whitening.whitened(table, model).alias("w")).orderBy("vec_id").collect()] == [None] * 3


def test_query_has_sixteen_components(spark, sf_dir):
    got = op12_tiled_whitening(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert got.groupBy("component").count().filter(F.col("count") == n).count() == 16
    assert got.agg(F.max("identity_error")).first()[0] < 1e-6
    assert got.filter("component = 1").select("explained").distinct().count() == 1
