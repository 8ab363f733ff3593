"""Gaussian mixtures by EM over DataFrames: one aggregation per iteration, parameters on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.operators.linalg import summed_matrix
from seqdrift.operators.transforms import ColumnModel, KMeansDistance, _array, _Saved, _Stage, batched

REGULARISER = 1e-6


class GaussianMixture(_Stage, Estimator):
    """K components with diagonal or full covariances.

    Starts from k-means; stops when the mean log-likelihood gains less than ``tolerance`` or after ``max_iter`` rounds.
    One of the two must be given. Each partition sends K * (1 + D + D or D*D) numbers a round.
    """

    def __init__(self, k: int, diagonal: bool = True, seed: int = 42, max_iter: int | None = None, tolerance: float | None = None, inputCol: str = "emb", outputCol: str | None = None) -> None:
        super().__init__()
        if max_iter is None and tolerance is None:
            raise ValueError("give max_iter or tolerance")
        self.k, self.diagonal, self.seed = k, diagonal, seed
        self.max_iter, self.tolerance = max_iter or 100, 1e-3 if tolerance is None else tolerance
        self._columns(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> MixtureModel:
        column = self.getInputCol()
        rows = df.select(F.col(column).cast("array<double>").alias("x")).persist()
        try:
            n = rows.count()
            if n < self.k:
                raise ValueError(f"{n} rows for {self.k} components")
            start = KMeansDistance(self.k, self.seed, restarts=3, inputCol="x").fit(rows).fitted["centers"]
            stats, _ = self._round(rows, None, start)
            params, last = self._maximise(stats, n), None
            for _ in range(self.max_iter):
                stats, likelihood = self._round(rows, params, None)
                params = self._maximise(stats, n)
                if last is not None and abs(likelihood / n - last) < self.tolerance:
                    break
                last = likelihood / n
        finally:
            rows.unpersist()
        return MixtureModel(*params, lower_bound=likelihood / n, inputCol=column, outputCol=self.getOutputCol())

    def _round(self, rows: DataFrame, params: tuple | None, centres: np.ndarray | None) -> tuple[np.ndarray, float]:
        k, diagonal = self.k, self.diagonal

        def partial(frames: Iterator[pd.DataFrame]) -> np.ndarray | None:
            total, likelihood = None, 0.0
            for x in (np.stack(f["x"].iloc[low : low + 1024].to_numpy()) for f in frames for low in range(0, len(f), 1024)):
                if centres is not None:
                    best = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
                    share = np.eye(k)[best]
                else:
                    logs = log_joint(x, *params)
                    top = logs.max(axis=1, keepdims=True)
                    norm = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
                    likelihood += float(norm.sum())
                    share = np.exp(logs - norm)
                second = share.T @ (x * x) if diagonal else np.stack([(x * s[:, None]).T @ x for s in share.T]).reshape(k, -1)
                part = np.hstack((share.sum(axis=0)[:, None], share.T @ x, second))
                total = part if total is None else total + part
            return None if total is None else np.hstack((np.full((k, 1), likelihood), total))

        d = len(rows.first()["x"])
        out = summed_matrix(rows, partial, 2 + d + (d if diagonal else d * d))
        return out[:, 1:], float(out[0, 0])

    def _maximise(self, stats: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        weight = np.maximum(stats[:, 0], 10 * np.finfo(float).eps)
        d = (stats.shape[1] - 1) // 2 if self.diagonal else int((math.isqrt(4 * stats.shape[1] - 3) - 1) // 2)
        means = stats[:, 1 : 1 + d] / weight[:, None]
        if self.diagonal:
            covariance = np.maximum(stats[:, 1 + d :] / weight[:, None] - means**2, 0) + REGULARISER
        else:
            covariance = (stats[:, 1 + d :] / weight[:, None]).reshape(-1, d, d) - means[:, :, None] * means[:, None, :] + REGULARISER * np.eye(d)
        return weight / weight.sum(), means, covariance


def log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """log(weight) + log density of each row under each component."""
    d = means.shape[1]
    out = np.empty((len(x), len(weights)))
    for k in range(len(weights)):
        if covariance.ndim == 2:
            maha, logdet = (((x - means[k]) ** 2) / covariance[k]).sum(axis=1), np.log(covariance[k]).sum()
        else:
            lower = np.linalg.cholesky(covariance[k])
            maha, logdet = (np.linalg.solve(lower, (x - means[k]).T) ** 2).sum(axis=0), 2 * np.log(np.diag(lower)).sum()
        out[:, k] = np.log(weights[k]) - 0.5 * (maha + logdet + d * math.log(2 * math.pi))
    return out


class MixtureModel(_Stage, Model, _Saved):
    """``transform`` adds responsibilities; ``scorer`` makes the density or nearest-component score a stage."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariance: np.ndarray, lower_bound: float, inputCol: str, outputCol: str) -> None:
        super().__init__()
        self.weights, self.means, self.covariance, self.lower_bound = weights, means, covariance, lower_bound
        self._columns(inputCol, outputCol)

    def _state(self) -> tuple[dict, dict[str, np.ndarray]]:
        names = {"lower_bound": float(self.lower_bound), "input": self.getInputCol(), "output": self.getOutputCol()}
        return names, {"weights": self.weights, "means": self.means, "covariance": self.covariance}

    @classmethod
    def _restored(cls, names: dict, arrays: dict[str, np.ndarray], path: str) -> MixtureModel:
        return cls(arrays["weights"], arrays["means"], arrays["covariance"], names["lower_bound"], names["input"], names["output"])

    def get_params(self) -> dict[str, np.ndarray]:
        return {"means": self.means, "covariance": self.covariance, "weights": self.weights}

    def _apply(self, df: DataFrame, out: str, kind: str, function) -> DataFrame:
        return df.withColumn(out, batched(F.col(self.getInputCol()), function, kind))

    def _transform(self, df: DataFrame) -> DataFrame:
        params = (self.weights, self.means, self.covariance)

        def shares(x: np.ndarray) -> np.ndarray:
            logs = log_joint(x, *params)
            top = logs.max(axis=1, keepdims=True)
            return np.exp(logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True)))

        return self._apply(df, self.getOutputCol(), "array<double>", shares)

    def score(self, df: DataFrame, score_type: str = "density", out: str = "score") -> DataFrame:
        """``density``: negative log density. ``min_md``: least Mahalanobis distance to a component."""
        weights, means, covariance = self.weights, self.means, self.covariance
        if score_type == "density":

            def scored(x: np.ndarray) -> np.ndarray:
                logs = log_joint(x, weights, means, covariance)
                top = logs.max(axis=1)
                return -(top + np.log(np.exp(logs - top[:, None]).sum(axis=1)))
        elif score_type == "min_md":

            def scored(x: np.ndarray) -> np.ndarray:
                each = []
                for k in range(len(weights)):
                    full = np.diag(covariance[k]) if covariance.ndim == 2 else covariance[k]
                    diff = x - means[k]
                    each.append(np.sqrt(np.maximum((diff * np.linalg.solve(full + REGULARISER * np.eye(len(full)), diff.T).T).sum(axis=1), 0)))
                return np.min(each, axis=0)
        else:
            raise ValueError(f"score_type must be density or min_md, not {score_type}")
        return self._apply(df, out, "double", scored)


class MixtureScore(_Stage, Estimator):
    """A mixture as the last stage of a pipeline: its output column is the score as a one-element array."""

    def __init__(self, k: int, diagonal: bool = True, seed: int = 42, score_type: str = "density", inputCol: str = "emb", outputCol: str | None = None) -> None:
        super().__init__()
        if score_type not in ("density", "min_md"):
            raise ValueError(f"score_type must be density or min_md, not {score_type}")
        self.mixture, self.score_type = GaussianMixture(k, diagonal, seed, tolerance=1e-4, inputCol=inputCol), score_type
        self._columns(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> MixtureScoreModel:
        return MixtureScoreModel(self.mixture.fit(df), self.score_type, self.getInputCol(), self.getOutputCol())


class MixtureScoreModel(_Stage, Model, _Saved):
    def __init__(self, mixture: MixtureModel, score_type: str, inputCol: str, outputCol: str) -> None:
        super().__init__()
        self.mixture, self.score_type = mixture, score_type
        self._columns(inputCol, outputCol)

    def _state(self) -> tuple[dict, dict[str, np.ndarray]]:
        return {"score_type": self.score_type, "input": self.getInputCol(), "output": self.getOutputCol()}, {}

    def _save_parts(self, path: str) -> None:
        self.mixture.write().save(f"{path}/mixture")

    @classmethod
    def _restored(cls, names: dict, arrays: dict[str, np.ndarray], path: str) -> MixtureScoreModel:
        return cls(MixtureModel.load(f"{path}/mixture"), names["score_type"], names["input"], names["output"])

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self.mixture.score(df, self.score_type, "score_")
        return scored.withColumn(self.getOutputCol(), F.array("score_")).drop("score_")


def density_expression(x: Column, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> Column:
    """Negative log density of a diagonal mixture as a plain expression, by a stable log-sum-exp."""
    d = means.shape[1]
    terms = []
    for w, mean, var in zip(weights, means, variances, strict=True):
        constant = math.log(w) - 0.5 * (float(np.log(var).sum()) + d * math.log(2 * math.pi))
        apart = F.zip_with(x, _array(mean), lambda a, b: (a - b) * (a - b))
        maha = F.aggregate(F.zip_with(apart, _array(var), lambda a, b: a / b), F.lit(0.0), lambda s, v: s + v)
        terms.append(F.lit(constant) - 0.5 * maha)
    logs = F.array(*terms)
    return F.transform(F.array(logs), lambda t: -(F.array_max(t) + F.log(F.aggregate(t, F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max(t))))))[0]


__all__ = ["ColumnModel", "GaussianMixture", "MixtureModel", "MixtureScore", "MixtureScoreModel", "density_expression", "log_joint"]
