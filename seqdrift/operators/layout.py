"""Rows in two dimensions: a graph of nearest neighbours, laid out by the leading axes of its normalised adjacency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.operators.linalg import summed_matrix
from seqdrift.operators.neighbours import nearest_join
from seqdrift.operators.settle import settled
from seqdrift.operators.transforms import batched

#: Columns beside the wanted ones that a step carries, and columns of the space before it starts anew from the best.
OVERSAMPLE = 3
MOST_COLUMNS = 96


def neighbour_graph(points: DataFrame, k: int = 15, id_col: str = "sample_id", column: str = "emb", **sizes: int) -> DataFrame:
    """(a, b): each row with its k nearest other rows, both ways round, every edge once in each direction.

    Distances are exact and ties go to the least id, so the graph does not depend on how rows are split. Ids must be
    unique; null vectors have no edges.
    """
    rows = settled(points.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).where("x is not null"))
    found = nearest_join(rows, rows.withColumnRenamed("id", "nid"), k + 1, **sizes)
    pairs = found.select(F.col("nid").alias("a"), F.explode(F.slice(F.filter("found", lambda f: f["id"] != F.col("nid")), 1, k)["id"]).alias("b"))
    return settled(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())


def _combined(v, matrix: np.ndarray):
    return batched(v, lambda x: x @ matrix)


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Inner products of all columns of the arrays ``v``: ``width`` squared numbers, whatever the number of rows."""

    def partial(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros((width, width))
        for frame in frames:
            x = np.stack(frame["v"].to_numpy()).astype(float) if len(frame) else np.zeros((0, width))
            total += x.T @ x
        return total

    return summed_matrix(rows.select("v"), partial, width)


def _orthonormal(columns: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Combinations of ``columns`` (coefficients over what ``gram`` has the products of) with unit products; those that
    are rounding errors are left out."""
    size, turn = np.linalg.eigh(columns.T @ gram @ columns)
    kept = size > 1e-10 * max(size.max(initial=0), 1e-300)
    return columns @ turn[:, kept] / np.sqrt(size[kept])


def graph_axes(edges: DataFrame, components: int, tolerance: float = 1e-6, steps: int = 40) -> tuple[DataFrame, np.ndarray, float]:
    """((node, degree, axes), values, residual): leading eigenpairs of the symmetric graph's normalised adjacency
    D^-1/2 A D^-1/2, the known one of value 1 first.

    ``edges`` has (a, b) in both directions. The vectors are an array column, a row a node. A step multiplies the newest
    block by the matrix, which is one join of the edges with the vectors and one sum by node, and adds the residuals of
    the best axes so far to the space (a block Krylov space). The driver sees inner products of at most ``MOST_COLUMNS``
    columns. It ends when the wanted residuals are below ``tolerance``, or after ``steps``; the greatest residual left is
    returned and bounds how far each value is from an eigenvalue.
    """
    degrees = settled(edges.groupBy(F.col("a").alias("node")).agg(F.count("*").cast("double").alias("degree")))
    n = degrees.count()
    width = min(components + OVERSAMPLE, n)
    noise = [F.xxhash64("node", F.lit(i)) / float(1 << 63) for i in range(1, width)]
    # The space's columns, then their images, in one array.
    rows = settled(degrees.withColumn("v", F.array(F.sqrt("degree"), *noise)))

    def image(rows: DataFrame, block: np.ndarray) -> DataFrame:
        """Add ``new``, combinations of ``v``, and ``next``, the matrix times them."""
        made = rows.withColumn("new", _combined(F.col("v"), block))
        sent = made.select(F.col("node").alias("a"), F.transform("new", lambda x: x / F.sqrt("degree")).alias("q"))
        sums = edges.join(sent, "a").groupBy(F.col("b").alias("node")).agg(*[F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(block.shape[1])])
        back = F.transform(F.array(*[f"s{i}" for i in range(block.shape[1])]), lambda x: x / F.sqrt("degree"))
        return made.join(sums, "node").withColumn("next", back)

    def added(rows: DataFrame, m: int, keep: np.ndarray | None, block: np.ndarray) -> tuple[DataFrame, int]:
        """The space with a new block, and how many columns it has; with ``keep``, its old columns combined to fewer."""
        made, base, images = image(rows, block), F.slice("v", 1, m), F.slice("v", m + 1, m)
        if keep is not None:
            base, images, m = _combined(base, keep), _combined(images, keep), keep.shape[1]
        return settled(made.select("node", "degree", F.concat(base, "new", images, "next").alias("v"))), m + block.shape[1]

    gram = _gram(rows, width)
    start = image(rows, _orthonormal(np.eye(width), gram))
    rows = settled(start.select("node", "degree", F.concat("new", "next").alias("v")))
    m = len(rows.select("v").first()[0]) // 2
    for step in range(steps + 1):
        gram = _gram(rows, 2 * m)
        # Rayleigh-Ritz in the space, whose columns are orthonormal up to rounding.
        metric = gram[:m, :m]
        size, turn = np.linalg.eigh(metric)
        white = turn / np.sqrt(np.maximum(size, 1e-12))
        small = white.T @ gram[:m, m:] @ white
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][: min(width, m)]
        values, axes = values[order], white @ turn[:, order]
        residual = np.vstack((-axes * values, axes))
        left = np.sqrt(np.maximum(np.diag(residual.T @ gram @ residual), 0))
        worst = float(left[:components].max())
        if worst <= tolerance or step == steps or m >= n:
            break
        basis = np.vstack((np.eye(m), np.zeros((m, m))))
        more = residual[:, left > tolerance / 10]
        for _ in range(2):
            more = more - basis @ np.linalg.solve(metric, basis.T @ gram @ more)
        more = _orthonormal(more, gram)
        if not more.shape[1]:
            break
        rows, m = added(rows, m, axes if m + more.shape[1] > MOST_COLUMNS else None, more)
    count = min(components, len(values))
    found = rows.select("node", "degree", _combined(F.slice("v", 1, m), axes[:, :count]).alias("axes"))
    return found, values[:count], worst


def spectral_layout(points: DataFrame, k: int = 15, dimensions: int = 2, id_col: str = "sample_id", column: str = "emb", tolerance: float = 1e-3, **sizes: int) -> DataFrame:
    """(id_col, place): every row at ``dimensions`` coordinates, near its nearest neighbours.

    Coordinates are the graph's leading eigenvectors after the constant one, over the square root of the degree, scaled
    to unit variance by degree; signs make the sum of cubes positive. Parts of the graph without an edge between them lie at different places. Null vectors have null places.
    """
    axes, _, _ = graph_axes(neighbour_graph(points, k, id_col, column, **sizes), dimensions + 1, tolerance)
    axes = settled(axes)
    total, *cubes = axes.agg(F.sum("degree"), *[F.sum(F.pow(F.col("axes")[i + 1], 3)) for i in range(dimensions)]).first()
    scale = [(1.0 if (c or 0) >= 0 else -1.0) * float(total or 0) ** 0.5 for c in cubes]
    place = F.array(*[F.col("axes")[i + 1] / F.sqrt("degree") * s for i, s in enumerate(scale)])
    return points.select(F.col(id_col)).join(axes.select(F.col("node").alias(id_col), place.alias("place")), id_col, "left")


def neighbour_preservation(points: DataFrame, places: DataFrame, k: int = 15, id_col: str = "sample_id", column: str = "emb", place: str = "place", **sizes: int) -> DataFrame:
    """(rows, preserved): the share of the k exact nearest neighbours that are among the k nearest of the layout too."""

    def nearest(df: DataFrame, vector: str) -> DataFrame:
        rows = settled(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("x is not null"))
        found = nearest_join(rows, rows.withColumnRenamed("id", "nid"), k + 1, **sizes)
        return found.select("nid", F.slice(F.filter("found", lambda f: f["id"] != F.col("nid")), 1, k)["id"].alias(f"{vector}_near"))

    both = nearest(points, column).join(nearest(places, place), "nid")
    common = F.size(F.array_intersect(F.col(f"{column}_near"), F.col(f"{place}_near"))) / F.size(f"{column}_near")
    return both.agg(F.count("*").alias("rows"), F.avg(common).alias("preserved"))
