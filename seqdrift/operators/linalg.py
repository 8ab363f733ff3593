"""Moments of array columns: what reaches the driver is D by D, whatever the number of rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of a matrix that travel in one row.
_BLOCK_BYTES = 8 << 20
#: Partial matrices that one task adds up.
_FAN = 32


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / max(self.n - ddof, 1)


def _as_rows(total: np.ndarray) -> Iterator[pd.DataFrame]:
    step = max(1, _BLOCK_BYTES // max(1, 8 * total.shape[1]))
    for low in range(0, len(total), step):
        yield pd.DataFrame({"i": [low], "block": [total[low : low + step].tobytes()]})


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams partial blocks and keeps one sum of each."""
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for i, block in zip(frame["i"], frame["block"], strict=True):
            part = np.frombuffer(block)
            total[i] = total[i] + part if i in total else part
    for i, part in total.items():
        yield pd.DataFrame({"i": [i], "block": [part.tobytes()]})


def summed_matrix(df: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], np.ndarray | None], columns: int) -> np.ndarray:
    """The sum over partitions of the matrix that ``partial`` makes of one; each sends it once, in binary rows.

    Matrices are added up by tasks of at most about ``_FAN`` of them, then by one task, so the driver gets one matrix.
    """

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = partial(frames)
        if total is not None:
            yield from _as_rows(np.ascontiguousarray(total, float))

    rows = df.mapInPandas(sent, "i int, block binary")
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // _FAN)
    for parts in (width, 1) if width > 1 else (1,):
        rows = rows.repartition(parts).mapInPandas(_added, "i int, block binary")
    blocks = sorted((r["i"], r["block"]) for r in rows.collect())
    return np.concatenate([np.frombuffer(b) for _, b in blocks]).reshape(-1, columns) if blocks else np.zeros((0, columns))


def _stacked(frames: Iterator[pd.DataFrame], shift: np.ndarray) -> Iterator[np.ndarray]:
    for frame in frames:
        for low in range(0, len(frame), 1024):
            yield np.stack(frame["x"].iloc[low : low + 1024].to_numpy()).astype(float) - shift


def _shifted(df: DataFrame, column: str) -> tuple[DataFrame, np.ndarray]:
    """The vectors, and the first of them, which sums are shifted by for accuracy."""
    head = df.select(column).first()
    if head is None:
        raise ValueError("no rows")
    return df.select(F.col(column).cast("array<double>").alias("x")), np.array(head[0], float)


def moments(df: DataFrame, column: str = "emb") -> Moments:
    """Count, mean and centred second moments in one pass: one matrix product a batch, one matrix a partition."""
    vectors, shift = _shifted(df, column)
    d = len(shift)

    def partial(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros((d + 1, d + 1))
        for x in _stacked(frames, shift):
            total[0, 0] += len(x)
            total[0, 1:] += x.sum(axis=0)
            total[1:, 1:] += x.T @ x
        return total

    whole = summed_matrix(vectors, partial, d + 1)
    n = int(round(whole[0, 0]))
    first = whole[0, 1:] / n
    return Moments(n, first + shift, whole[1:, 1:] - n * np.outer(first, first))


def feature_moments(df: DataFrame, column: str = "emb") -> tuple[int, np.ndarray, np.ndarray]:
    """(count, mean, population variance) of each feature: two vectors a partition, whatever the width."""
    vectors, shift = _shifted(df, column)
    d = len(shift)

    def partial(frames: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros((2, d + 1))
        for x in _stacked(frames, shift):
            total[0, 0] += len(x)
            total[0, 1:] += x.sum(axis=0)
            total[1, 1:] += (x * x).sum(axis=0)
        return total

    whole = summed_matrix(vectors, partial, d + 1)
    n = int(round(whole[0, 0]))
    first = whole[0, 1:] / n
    return n, first + shift, np.maximum(whole[1, 1:] / n - first * first, 0)


def symmetric_inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive matrix from its eigenvalues; one that is singular up to rounding is refused.

    ``np.linalg.inv`` of a matrix of about 100 rows or more can wait forever on the driver: starting a session forks the
    process, and OpenBLAS's threaded inversion does not survive that. The eigenvalues do not take that path.
    """
    values, vectors = np.linalg.eigh(matrix)
    if len(values) and values.min() <= len(values) * np.finfo(float).eps * np.abs(values).max():
        raise np.linalg.LinAlgError("Singular matrix, or one with a negative eigenvalue")
    return (vectors / values) @ vectors.T


#: Widest vectors whose covariance is formed as a whole.
DENSE_WIDTH = 512
#: Columns beside the wanted ones that each pass carries.
OVERSAMPLE = 10


@dataclass
class Spectrum:
    """Leading eigenpairs of the sample covariance (of the standardised rows if ``scaled``): axes in columns."""

    n: int
    mean: np.ndarray
    total: float
    values: np.ndarray
    axes: np.ndarray


def _signed(axes: np.ndarray) -> np.ndarray:
    """Each axis with its largest loading positive."""
    return axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def _new_directions(columns: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to ``basis``; directions that are rounding errors are left out."""
    norms = np.linalg.norm(columns, axis=0)
    columns = columns[:, norms > 0] / norms[norms > 0]
    for _ in range(2):  # once more, against what rounding leaves
        columns = columns - basis @ (basis.T @ columns)
    left, size, _ = np.linalg.svd(columns, full_matrices=False)
    left = left[:, size > 1e-8]
    left = left - basis @ (basis.T @ left)
    return left / np.linalg.norm(left, axis=0) if left.size else left


def leading_axes(df: DataFrame, components: int, column: str = "emb", scaled: bool = False, dense_width: int = DENSE_WIDTH, tolerance: float = 1e-10, passes: int = 60) -> Spectrum:
    """The ``components`` greatest eigenvalues and axes.

    Up to ``dense_width`` the covariance is formed in one pass. Beyond, it never is: from random directions, each pass
    over the rows multiplies a block of a few more than ``components`` vectors by it, partition by partition, and the
    residuals of the best axes in the space so far are the next block (a block Krylov space, kept orthonormal). The
    driver holds the width times a few blocks. It stops when the residuals of all wanted axes are below ``tolerance``
    times the greatest eigenvalue, which bounds their error by that over the gap to the next, and fails after ``passes``.
    """
    vectors, shift = _shifted(df, column)
    d = len(shift)
    k = min(components, d)
    if d <= dense_width:
        m = moments(df, column)
        matrix = m.covariance(1)
        if scaled:
            sd = np.sqrt(np.maximum(np.diag(m.covariance(0)), 1e-300))
            matrix = matrix / np.outer(sd, sd)
        values, axes = np.linalg.eigh(matrix)
        order = np.argsort(values)[::-1][:k]
        return Spectrum(m.n, m.mean, float(np.maximum(values, 0).sum()), np.maximum(values[order], 0), _signed(axes[:, order]))

    n, mean, variance = feature_moments(df, column)
    sd = np.sqrt(np.maximum(variance, 1e-300)) if scaled else np.ones(d)
    total = float((variance / sd**2).sum()) * n / max(n - 1, 1)

    def times(block: np.ndarray) -> np.ndarray:
        def partial(frames: Iterator[pd.DataFrame]) -> np.ndarray:
            out = np.zeros((d, block.shape[1]))
            for x in _stacked(frames, mean):
                x = x / sd
                out += x.T @ (x @ block)
            return out

        return summed_matrix(vectors, partial, block.shape[1]) / max(n - 1, 1)

    width = min(d, k + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((d, width)))[0]
    image = times(basis)
    for _ in range(passes):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:width]
        values, turn = values[order], turn[:, order]
        axes, residual = basis @ turn, image @ turn - (basis @ turn) * values
        done = np.linalg.norm(residual, axis=0) <= tolerance * max(values[0], 1e-300)
        if done[:k].all():
            break
        if basis.shape[1] > 8 * width:  # start anew from the best axes; their products are known
            basis, image = axes, image @ turn
        more = _new_directions(residual[:, ~done], basis)
        if not more.shape[1]:
            break
        basis, image = np.hstack((basis, more)), np.hstack((image, times(more)))
    else:
        raise ArithmeticError(f"axes not found to {tolerance} in {passes} passes: their eigenvalues lie too close together")
    return Spectrum(n, mean, total, np.maximum(values[:k], 0), _signed(axes[:, :k]))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        for _ in range(100_000):
            k += 1
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Inverse normal distribution by bisection and Newton steps on erfc."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - normal_sf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
