"""The partitioned nearest-neighbour join, principal axes of wide rows, and what both mean for far-off or flat data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqdrift.operators import analysis as A
from seqdrift.operators import linalg as L
from seqdrift.operators import neighbours as N
from seqdrift.operators import scoring as H
from seqdrift.operators.transforms import PCA

#: Many cells, cells of several blocks, several slices.
SMALL = {"block_bytes": 60 * 8, "cell_bytes": 40 * 8}


def emb(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "sample_id long, emb array<double>")


def plain(train, new, k):
    return np.sort(np.sqrt(((new[:, None] - train[None]) ** 2).sum(2)), axis=1)[:, :k]


def clustered(rng):
    centres = rng.normal(size=(12, 3)) * 50
    return centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 3)), centres[rng.integers(0, 12, 60)] + rng.normal(size=(60, 3)) * 4


def tied(rng):
    grid = np.stack(np.meshgrid(*[np.arange(5.0)] * 3), -1).reshape(-1, 3)
    return np.concatenate((grid, grid[:40], np.full((150, 3), 2.0))), np.concatenate((grid[:30] + 0.5, np.full((40, 3), 2.0)))


def far_off(rng):
    return 1e8 + rng.normal(size=(300, 3)), 1e8 + rng.normal(size=(40, 3))


def mixed_scales(rng):
    return rng.normal(size=(300, 3)) * 10.0 ** rng.integers(-6, 7, (300, 1)), rng.normal(size=(40, 3)) * 10.0 ** rng.integers(-6, 7, (40, 1))


def noise(rng):
    return rng.normal(size=(200, 30)), rng.normal(size=(20, 30))


@pytest.mark.parametrize("make", [clustered, tied, far_off, mixed_scales, noise])
@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_neighbours(spark, make, sizes):
    rng = np.random.default_rng(5)
    train, new = make(rng)
    got = H.k_nearest_neighbors(emb(spark, train), emb(spark, new), 5, distances=True, **sizes).orderBy("sample_id").collect()
    assert np.allclose([r.distances for r in got], plain(train, new, 5), rtol=1e-9, atol=1e-12)
    scores = H.k_nearest_neighbors(emb(spark, train), emb(spark, new), 5, **sizes).orderBy("sample_id").collect()
    assert np.allclose([r.score for r in scores], plain(train, new, 5).mean(axis=1), rtol=1e-9, atol=1e-12)


def test_offsets_of_the_review(spark):
    """Unit spread far from the origin: no digit of a distance is lost to x^2 + y^2 - 2xy."""
    rng = np.random.default_rng(1)
    for offset in (1e6, 1e8):
        train, new = offset + rng.normal(size=(300, 4)), offset + rng.normal(size=(4, 4))
        got = H.k_nearest_neighbors(emb(spark, train), emb(spark, new), 3).orderBy("sample_id").collect()
        assert np.allclose([r.score for r in got], plain(train, new, 3).mean(axis=1), rtol=1e-12)


def test_neighbours_by_id(spark):
    """Ties go to the least ids, over all cells and blocks."""
    train, new = tied(None)
    reference = spark.createDataFrame([(1000 - i, [float(v) for v in x]) for i, x in enumerate(train)], "id long, x array<double>")
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(new)] + [(-1, None)], "nid long, x array<double>")
    got = {r.nid: [(f.distance, f.id) for f in r.found] for r in N.nearest_join(reference, rows, 7, **SMALL).collect()}
    want = {i: sorted((float(np.sqrt(((x - y) ** 2).sum())), 1000 - j) for j, y in enumerate(train))[:7] for i, x in enumerate(new)}
    assert got == want


def test_cells_are_ruled_out(spark):
    """In clusters most cells are never visited, and no cell that has a neighbour is missed."""
    rng = np.random.default_rng(9)
    train, new = clustered(rng)
    pivots = train[rng.choice(len(train), 40, replace=False)]
    cells = N.Cells(pivots, *np.zeros((3, 40)))
    cell, radius, reach = cells.of(train)
    cells.reach = reach.max()
    for j in range(40):
        cells.count[j], cells.low[j], cells.high[j] = (cell == j).sum(), radius[cell == j].min(), radius[cell == j].max()
    within = plain(train, new, 5)[:, -1]
    home, others = cells.home(new, 5), cells.others(new, within, 5)
    for i, x in enumerate(new):
        near = np.argsort(((train - x) ** 2).sum(1))[:5]
        assert set(cell[near]) <= {*home[i].tolist(), *others[i].tolist()}
    assert np.mean([len(h) + len(o) for h, o in zip(home, others, strict=True)]) < 12


def test_a_row_goes_once_to_a_bin_of_cells(spark, monkeypatch):
    """In noise every cell is needed, yet a row is sent to bins, not to cells; and no matrix or group outgrows its bound."""
    rng = np.random.default_rng(4)
    train, new = rng.normal(size=(600, 20)), rng.normal(size=(50, 20))
    sent, plain_visit = [], N._visit

    def visit(rows, reference, count, k, per_block, cells=None):
        sent.append((rows.selectExpr("max(size(places))").first()[0], len(count), max(count.values()), per_block))
        return plain_visit(rows, reference, count, k, per_block, cells)

    monkeypatch.setattr(N, "_visit", visit)
    got = H.k_nearest_neighbors(emb(spark, train), emb(spark, new), 5, distances=True, cell_bytes=10 * 160, block_bytes=200 * 160).orderBy("sample_id").collect()
    assert np.allclose([r.distances for r in got], plain(train, new, 5), rtol=1e-9, atol=1e-12)
    home, rest = sent
    assert home[1] >= 50 and rest[1] <= 6 and rest[0] <= rest[1] and rest[2] <= rest[3]


def test_flat_rows_have_cells_of_bounded_rows(spark, monkeypatch):
    """Rows of two numbers are few bytes: cells and blocks are bounded by rows too."""
    monkeypatch.setattr(N, "CELL_ROWS", 20)
    monkeypatch.setattr(N, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(900, 2))
    cells = N.Cells(rows[:45], *np.zeros((3, 45)))
    cells.count[:] = 20
    assert np.bincount(cells.bins(100)).max() <= 5
    got = H.k_nearest_neighbors(emb(spark, rows), emb(spark, rows[:200]), 4, distances=True).orderBy("sample_id").collect()
    assert np.allclose([r.distances for r in got], plain(rows, rows[:200], 4), rtol=1e-9, atol=1e-12)
    row, distances, _ = N.nearest_of(rows[:3], rows, np.arange(900), 4, np.array([0.0, 1e9, 0.0]))
    assert row.tolist() == [0, 1, 1, 1, 1, 2] and distances[0] == distances[5] == 0


def test_neighbours_of_odd_tables(spark):
    train, new = emb(spark, [[0.0], [1.0], [1.0], [5.0]]), emb(spark, [[1.0], [9.0]])
    with_null = new.unionByName(spark.createDataFrame([(9, None)], new.schema)).withColumns({"x": F.lit(1), "nid": F.lit(2), "row": F.lit(3), "cell": F.lit(4)})
    got = {r.sample_id: (r.score, r.x, r.nid, r.row, r.cell) for r in H.k_nearest_neighbors(train, with_null, 2).collect()}
    assert got == {0: (0.0, 1, 2, 3, 4), 1: (6.0, 1, 2, 3, 4), 9: (None, 1, 2, 3, 4)}
    assert H.k_nearest_neighbors(train, new.where("false"), 2).count() == 0
    for k in (0, 5):
        with pytest.raises(ValueError):
            H.k_nearest_neighbors(train, new, k)
    assert [r.score for r in H.k_nearest_neighbors(train, new, 4).orderBy("sample_id").collect()] == [1.25, 7.25]


def test_hot_vector_on_both_sides(spark):
    """One vector makes up most rows: its cell has many blocks, its visitors many slices."""
    rng = np.random.default_rng(2)
    train, new = np.concatenate((np.zeros((400, 2)), rng.normal(size=(40, 2)))), np.concatenate((np.zeros((150, 2)), rng.normal(size=(10, 2))))
    got = H.k_nearest_neighbors(emb(spark, train), emb(spark, new), 450 - 20, distances=True, **SMALL).orderBy("sample_id").collect()
    assert np.allclose([r.distances for r in got], plain(train, new, 430))


# Principal axes.


def wide_rows(rng, n, d, values):
    """n rows whose sample covariance has the given leading spread, off-centre."""
    axes = np.linalg.qr(rng.normal(size=(d, len(values))))[0]
    return rng.normal(size=(n, len(values))) * np.sqrt(values) @ axes.T + rng.normal(size=(n, d)) * 0.05 + rng.normal(size=d) * 3


def plain_axes(x, k, scaled=False):
    x = x - x.mean(axis=0)
    if scaled:
        x = x / x.std(axis=0)
    _, size, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:k].T
    return size**2 / (len(x) - 1), axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])


@pytest.mark.parametrize("scaled", [False, True])
def test_axes_from_passes(spark, scaled):
    rng = np.random.default_rng(3)
    x = wide_rows(rng, 400, 600, np.geomspace(100, 1, 25))
    found = L.leading_axes(emb(spark, x), 20, scaled=scaled)
    values, axes = plain_axes(x, 20, scaled)
    assert np.allclose(found.values, values[:20], rtol=1e-9) and np.isclose(found.total, values.sum())
    assert np.abs(found.axes - axes).max() < 1e-6
    dense = L.leading_axes(emb(spark, x), 20, scaled=scaled, dense_width=600)
    assert np.abs(dense.axes - found.axes).max() < 1e-6 and np.isclose(dense.total, found.total)


def test_axes_of_the_models_width(spark):
    """4096 wide: the driver asks for products with blocks of 30 vectors only."""
    rng = np.random.default_rng(4)
    x = wide_rows(rng, 300, 4096, np.geomspace(50, 2, 40))
    found = L.leading_axes(emb(spark, x), 20)
    values, axes = plain_axes(x, 20)
    assert np.allclose(found.values, values[:20], rtol=1e-9) and np.abs(found.axes - axes).max() < 1e-6


def test_axes_of_flat_and_small_tables(spark):
    x = np.outer(np.arange(6.0), [1.0, -2.0, 0.5])
    found = L.leading_axes(emb(spark, x), 3, dense_width=1)
    assert np.allclose(found.axes[:, 0], [-1 / np.sqrt(5.25), 2 / np.sqrt(5.25), -0.5 / np.sqrt(5.25)]) and np.allclose(found.values[1:], 0, atol=1e-9)
    same = L.leading_axes(emb(spark, np.ones((4, 3))), 2, dense_width=1)
    assert np.allclose(same.values, 0) and same.total == 0
    fitted = PCA(1, dense_width=1).fit(emb(spark, x)).fitted
    assert np.allclose(fitted["explained_variance_ratio"], [1.0])
    assert A.spectrum(emb(spark, x), 2).count() == 2
    with pytest.raises(ValueError):
        L.leading_axes(emb(spark, x).where("false"), 1)


# Singular covariances.


def test_singular_covariances_are_refused(spark):
    df = emb(spark, [[1.0, 2.0, 3.0]])
    flat = np.outer([1.0, 2, 3], [1.0, 2, 3])
    with pytest.raises(np.linalg.LinAlgError):
        H.mahalanobis_from_stats(F.col("emb"), np.zeros(3), covariance=flat)
    with pytest.raises(np.linalg.LinAlgError):
        H.gaussian_log_prob(df, np.zeros(3), flat)
    with pytest.raises(np.linalg.LinAlgError):
        H.mahalanobis_from_stats(F.col("emb"), np.zeros(2), covariance=np.array([[1.0, 2.0], [2.0, 1.0]]))
    eps = 1e-3
    score = df.select(H.mahalanobis_from_stats(F.col("emb"), np.zeros(3), covariance=flat, eps=eps)).first()[0]
    x = np.array([1.0, 2, 3])
    assert np.isclose(score, np.sqrt(x @ np.linalg.solve(flat + eps * np.eye(3), x)))


def test_mahalanobis_far_from_the_origin(spark):
    rng = np.random.default_rng(8)
    for offset in (1e6, 1e8):
        x = offset + rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3))
        d = x - x.mean(axis=0)
        want = np.sqrt(((d @ np.linalg.inv(d.T @ d / 199 + 1e-6 * np.eye(3))) * d).sum(1))
        got = [r.score for r in H.mahalanobis_distance(emb(spark, x), emb(spark, x)).orderBy("sample_id").collect()]
        assert np.allclose(got, want, rtol=1e-5)
