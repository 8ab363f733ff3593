"""Scores of new rows against an in-distribution reference: higher means further out."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.operators.linalg import moments, symmetric_inverse
from seqdrift.operators.neighbours import nearest_join
from seqdrift.operators.settle import settled
from seqdrift.operators.transforms import EXPRESSION_NUMBERS, PCA, StandardScaler, _array, batched


def mahalanobis_expression(x: Column, mean: np.ndarray, inverse: np.ndarray, squared: bool = False) -> Column:
    """sqrt((x - mean)' inverse (x - mean)), a full quadratic form: inside generated code, or for wide vectors one matrix
    product a batch."""
    if inverse.size > EXPRESSION_NUMBERS:

        def product(v: np.ndarray) -> np.ndarray:
            d = v - mean
            total = ((d @ inverse) * d).sum(axis=1)
            return total if squared else np.sqrt(np.maximum(total, 0))

        return batched(x, product, "double")

    def form(d: Column) -> Column:
        total = F.lit(0.0)
        for row in range(len(mean)):
            total = total + F.get(d, F.lit(row)) * F.aggregate(F.zip_with(d, _array(inverse[row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return total if squared else F.sqrt(F.greatest(total, F.lit(0.0)))

    return F.transform(F.array(F.zip_with(x, _array(mean), lambda a, b: a - b)), form)[0]


def mahalanobis_from_stats(x: Column, mean: np.ndarray, covariance: np.ndarray | None = None, inverse: np.ndarray | None = None, squared: bool = False, eps: float = 0.0) -> Column:
    if inverse is None:
        if covariance is None:
            raise ValueError("give covariance or inverse")
        inverse = symmetric_inverse(np.atleast_2d(covariance) + eps * np.eye(len(mean)))
    return mahalanobis_expression(x, mean, inverse, squared)


def mahalanobis_distance(reference: DataFrame, new: DataFrame, eps: float = 1e-6, column: str = "emb") -> DataFrame:
    """Add ``score``: distance to the reference's mean under its sample covariance plus eps on the diagonal."""
    m = moments(as_vectors(reference, column), column)
    return as_vectors(new, column).withColumn("score", mahalanobis_from_stats(F.col(column), m.mean, m.covariance(1), eps=eps))


def gaussian_log_prob(df: DataFrame, mean: np.ndarray, covariance: np.ndarray, column: str = "emb", out: str = "log_prob") -> DataFrame:
    """Log density of a Gaussian through the Cholesky factor; no regulariser."""
    covariance = np.atleast_2d(covariance)
    lower = np.linalg.cholesky(covariance)
    constant = -0.5 * (2 * float(np.log(np.diag(lower)).sum()) + len(mean) * math.log(2 * math.pi))
    form = mahalanobis_expression(F.col(column), np.asarray(mean, float), symmetric_inverse(covariance), squared=True)
    return df.withColumn(out, F.lit(constant) - 0.5 * form)


def as_vectors(df: DataFrame, column: str = "emb") -> DataFrame:
    """A scalar column counts as one-dimensional vectors."""
    kind = dict(df.dtypes)[column]
    return df if kind.startswith("array") else df.withColumn(column, F.array(F.col(column).cast("double")))


def reference_rows(reference: DataFrame, cap: int | None = None, seed: int = 42, column: str = "emb") -> DataFrame:
    """The reference vectors as ``x``; with a cap, that many, chosen by a seeded hash."""
    rows = as_vectors(reference, column).select(F.col(column).cast("array<double>").alias("x"))
    return rows if cap is None else rows.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(cap)


def k_nearest_neighbors(reference: DataFrame, new: DataFrame, k: int, cap: int | None = None, column: str = "emb", distances: bool = False, **sizes: int) -> DataFrame:
    """Add ``score``, the mean distance to the k nearest reference rows, or ``distances``, the k ascending distances.

    All reference rows count, unless ``cap`` samples them; a null vector gets null. The join is
    ``neighbours.nearest_join``; new rows are settled once, so that each has a number, and get their distances by it.
    """
    rows = reference_rows(reference, cap, column=column).where("x is not null")
    n = rows.count()
    if not 0 < k <= n:
        raise ValueError(f"k must be from 1 to {n}")
    vectors = as_vectors(new, column)
    numbered = settled(vectors.select(F.struct("*").alias("row"), F.col(column).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("nid")))
    found = nearest_join(rows.withColumn("id", F.lit(0).cast("long")), numbered.select("nid", "x"), k, **sizes)
    joined = numbered.select("nid", "row").join(found, "nid", "left").select("row.*", F.col("found.distance").alias("distances"))
    if distances:
        return joined
    return joined.withColumn("score", F.aggregate("distances", F.lit(0.0), lambda s, v: s + v) / k).drop("distances")


def identity(reference: DataFrame, new: DataFrame, column: str = "emb") -> DataFrame:
    """The new embeddings are scores already."""
    kind = dict(new.dtypes)[column]
    return new.withColumn("score", F.col(column)[0] if kind.startswith("array") else F.col(column))


Scorer = Callable[[DataFrame, DataFrame], DataFrame]


class OODDetector:
    """Transformations fitted on the training rows, and a scorer against the embedded training rows."""

    def __init__(self, stages: list, scorer: Scorer, train: DataFrame) -> None:
        self.pipeline = Pipeline(stages=stages).fit(train)
        self.scorer, self.train = scorer, self.pipeline.transform(train).persist()

    def score(self, rows: DataFrame) -> DataFrame:
        return self.scorer(self.train, self.pipeline.transform(rows))

    def fitted(self, kind: str) -> dict:
        """Parameters of the first fitted stage of a kind."""
        return next(s.fitted for s in self.pipeline.stages if getattr(s, "fitted", {}).get("kind") == kind)


def standard_detector(train: DataFrame, components: int = 10, extract: Transformer | None = None) -> OODDetector:
    """The detector for live use: PCA, scaler, Mahalanobis distance; with ``extract`` as first stage, from tokens on."""
    first = [] if extract is None else [extract]
    return OODDetector([*first, PCA(components), StandardScaler()], mahalanobis_distance, train)


def detector_parameters(detector: OODDetector, eps: float = 1e-6) -> dict:
    """What another program needs to score: PCA, scaler, mean and inverse covariance of the embedded training rows."""
    pca, scaler = detector.fitted("pca"), detector.fitted("scaler")
    m = moments(detector.train)
    inverse = symmetric_inverse(m.covariance(1) + eps * np.eye(len(m.mean)))
    listed = {"pca_mean": pca["mean"], "pca_components": pca["components"], "scaler_mean": scaler["mean"], "scaler_std": scaler["std"], "mahalanobis_mean": m.mean, "mahalanobis_cov_inv": inverse}
    return {k: np.asarray(v).tolist() for k, v in listed.items()}


def export_parameters(detector: OODDetector, path: str) -> None:
    """Write the parameters as one JSON row."""
    spark = detector.train.sparkSession
    spark.createDataFrame([(json.dumps(detector_parameters(detector)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def score_with_parameters(df: DataFrame, parameters: dict, column: str = "emb") -> DataFrame:
    """The exported detector as one expression."""
    from seqdrift.operators.transforms import affine

    p = {k: np.array(v, float) for k, v in parameters.items()}
    std = np.where(p["scaler_std"] > 0, p["scaler_std"], 1.0)
    projected = affine(F.col(column), p["pca_components"].T, p["pca_mean"])
    scaled = F.zip_with(F.zip_with(projected, _array(p["scaler_mean"]), lambda a, b: a - b), _array(std), lambda a, b: a / b)
    return df.withColumn("scaled_", scaled).withColumn("score", mahalanobis_expression(F.col("scaled_"), p["mahalanobis_mean"], p["mahalanobis_cov_inv"])).drop("scaled_")
