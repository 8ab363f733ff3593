"""Neighbour graphs and their layout in two dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqdrift.operators import layout as Y

SMALL = {"block_bytes": 60 * 8, "cell_bytes": 60 * 8}


def graph(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for p in pairs for a, b in (p, p[::-1])], "a long, b long")


def test_ring_has_a_known_spectrum(spark):
    n = 60
    found, values, residual = Y.graph_axes(graph(spark, [(i, (i + 1) % n) for i in range(n)]), 5)
    assert residual < 1e-5
    assert np.allclose(values, [1, *np.cos(2 * np.pi * np.array([1, 1, 2, 2]) / n)], atol=1e-9)
    axes = np.array([r.axes for r in found.orderBy("node").collect()])
    step = np.roll(axes, 1, axis=0) + np.roll(axes, -1, axis=0)
    assert np.allclose(step / 2, axes * values, atol=1e-5) and np.allclose(axes.T @ axes, np.eye(5), atol=1e-6)
    # The second and third axes of a ring are a circle.
    assert np.allclose((axes[:, 1:3] ** 2).sum(axis=1), 2 / n, atol=1e-5)


def test_complete_and_bipartite_graphs(spark):
    complete = [(i, j) for i in range(12) for j in range(i)]
    assert np.allclose(Y.graph_axes(graph(spark, complete), 3)[1], [1, -1 / 11, -1 / 11], atol=1e-8)
    star = [(0, i) for i in range(1, 9)]
    assert np.allclose(Y.graph_axes(graph(spark, star), 3)[1], [1, 0, 0], atol=1e-8)
    two = complete + [(i + 20, j + 20) for i, j in complete]
    assert np.allclose(Y.graph_axes(graph(spark, two), 3)[1], [1, 1, -1 / 11], atol=1e-8)


@pytest.fixture(scope="module")
def curve(spark):
    """A closed curve in ten dimensions with a little noise, far from the origin."""
    rng = np.random.default_rng(3)
    t = np.linspace(0, 2 * np.pi, 240, endpoint=False)
    x = np.stack((np.cos(t), np.sin(t)), axis=1) @ np.linalg.qr(rng.normal(size=(10, 2)))[0].T * 10 + rng.normal(size=(240, 10)) * 0.02 + 1e5
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "sample_id long, emb array<double>"), x


def test_graph_of_exact_neighbours(spark, curve):
    points, x = curve
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    near = np.argsort(far, axis=1)[:, 1:7]
    want = {(i, int(j)) for i in range(len(x)) for j in near[i]}
    got = {(r.a, r.b) for r in Y.neighbour_graph(points, 6, **SMALL).collect()}
    assert got == want | {(b, a) for a, b in want}


def test_layout_keeps_neighbours(spark, curve):
    points, x = curve
    places = Y.spectral_layout(points, 6).orderBy("sample_id").collect()
    p = np.array([r.place for r in places])
    assert p.shape == (240, 2)
    assert np.allclose(np.hypot(*p.T), np.hypot(*p.T).mean(), rtol=0.3)  # a circle again
    kept = Y.neighbour_preservation(points, spark.createDataFrame(places), 6).first()
    far = lambda v: np.argsort(((v[:, None] - v[None]) ** 2).sum(2), axis=1)[:, 1:7]
    want = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(far(x).tolist(), far(p).tolist(), strict=True)])
    assert kept.rows == 240 and np.isclose(kept.preserved, want) and want > 0.5


def test_every_row_is_placed(spark, curve):
    points, _ = curve
    odd = points.unionByName(spark.createDataFrame([(900, None)], points.schema)).withColumn("degree", F.lit(1))
    got = {r.sample_id: r.place for r in Y.spectral_layout(odd, 4).collect()}
    assert len(got) == 241 and got[900] is None and all(len(v) == 2 for i, v in got.items() if i != 900)
