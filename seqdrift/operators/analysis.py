"""Multivariate normality tests and spectra of embedding tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.operators.linalg import chi2_sf, leading_axes, moments, normal_ppf, normal_sf, summed_matrix

#: Third moments of more dimensions than this would take over a hundred passes.
MAX_TENSOR_WIDTH = 1024

# Polynomial coefficients of Royston's approximation to the Shapiro-Wilk test (algorithm AS R94).
_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.544, -0.39978, 0.025054, -0.0006714)
_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
_SMALL_SHIFT = (-2.273, 0.459)


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def subsample(df: DataFrame, rows: int = 5000, columns: int = 100, seed: int = 42, column: str = "emb") -> DataFrame:
    """If either dimension is over its limit, seeded random rows and features of both."""
    head = df.select(F.size(column)).first()
    if head is None or (df.count() <= rows and head[0] <= columns):
        return df
    keep = sorted(np.random.default_rng(seed).permutation(head[0])[: min(columns, head[0])].tolist())
    cut = df.orderBy(F.xxhash64(column, F.lit(seed)), column).limit(rows)
    return cut.withColumn(column, F.transform(F.array(*map(F.lit, keep)), lambda i: F.col(column)[i]))


def floored(p: float, least: float = 0.001) -> float:
    return max(p, least)


def mardia(df: DataFrame, column: str = "emb", tile: int = 1 << 22) -> dict[str, float]:
    """Mardia's skewness and kurtosis statistics and p-values.

    With whitened rows z, skewness is the sum of squared third moments, so the tensor E[z z z] replaces the n by n sum. It
    is symmetric: planes hold what follows their own index only, and a pass over the rows sums as many planes as fit into
    ``tile`` numbers a task, one pass up to 161 dimensions. Above ``MAX_TENSOR_WIDTH`` dimensions it refuses.
    """
    m = moments(df, column)
    n, p = m.n, len(m.mean)
    if p > MAX_TENSOR_WIDTH:
        raise ValueError(f"third moments of {p} dimensions: reduce them to {MAX_TENSOR_WIDTH} first")
    values, vectors = np.linalg.eigh(m.covariance(0))
    white = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12)))
    mean = m.mean
    rows = df.select(F.col(column).cast("array<double>").alias("x"))
    cubes, fourth, low = 0.0, 0.0, 0
    while low < p:
        wide = p - low
        planes = min(wide, max(1, tile // wide**2))

        def partial(frames: Iterator[pd.DataFrame], low: int = low, wide: int = wide, planes: int = planes) -> np.ndarray:
            total = np.zeros((planes * wide + 1, wide))
            for frame in frames:
                for at in range(0, len(frame), 256):
                    z = (np.stack(frame["x"].iloc[at : at + 256].to_numpy()).astype(float) - mean) @ white[:, low:]
                    total[:-1] += (z[:, :planes, None] * z[:, None, :]).reshape(len(z), -1).T @ z
                    total[-1, 0] += ((z**2).sum(axis=1) ** 2).sum()
            return total

        whole = summed_matrix(rows, partial, wide)
        if low == 0:
            fourth = float(whole[-1, 0])
        for i, plane in enumerate(whole[:-1].reshape(planes, wide, wide) / n):
            squares = plane[i:, i:] ** 2  # an index alone stands in three places, as a pair too
            cubes += float(squares[0, 0] + 3 * squares[0, 1:].sum() + 3 * squares[1:, 1:].sum())
        low += planes
    skewness = n * cubes / 6
    kurtosis = (fourth / n - p * (p + 2)) / math.sqrt(8 * p * (p + 2) / n)
    return {"skewness": skewness, "kurtosis": kurtosis, "skewness_p": chi2_sf(skewness, p * (p + 1) * (p + 2) / 6), "kurtosis_p": 2 * normal_sf(abs(kurtosis))}


def henze_zirkler(df: DataFrame, rows: int = 5000, columns: int = 100, column: str = "emb") -> dict[str, float]:
    """Henze-Zirkler statistic and p-value on a bounded subsample; tasks take blocks of its pairs."""
    cut = subsample(df, rows, columns, column=column).select(F.col(column).cast("array<double>").alias("x"))
    x = np.array([r[0] for r in cut.collect()])
    n, p = x.shape
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True).reshape(p, p))
    z = (x - x.mean(axis=0)) @ (vectors / np.sqrt(np.maximum(values, 1e-12)))
    b2 = 0.5 * (n * (2 * p + 1) / 4) ** (2 / (p + 4))

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            total = 0.0
            for low in frame["low"]:
                part = z[low : low + 256]
                d = (part**2).sum(axis=1)[:, None] + (z**2).sum(axis=1)[None] - 2 * part @ z.T
                total += float(np.exp(-b2 / 2 * np.maximum(d, 0)).sum())
            yield pd.DataFrame({"s": [total]})

    spark = df.sparkSession
    every = spark.createDataFrame([(i,) for i in range(0, n, 256)], "low int").repartition(8).mapInPandas(pairs, "s double").agg(F.sum("s")).first()[0]
    single = float(np.exp(-b2 / (2 * (1 + b2)) * (z**2).sum(axis=1)).sum())
    hz = every / n - 2 * (1 + b2) ** (-p / 2) * single + n * (1 + 2 * b2) ** (-p / 2)
    b4, b8, a, w = b2**2, b2**4, 1 + 2 * b2, (1 + b2) * (1 + 3 * b2)
    mu = 1 - a ** (-p / 2) * (1 + p * b2 / a + p * (p + 2) * b4 / (2 * a**2))
    var = 2 * (1 + 4 * b2) ** (-p / 2) + 2 * a ** (-p) * (1 + 2 * p * b4 / a**2 + 3 * p * (p + 2) * b8 / (4 * a**4)) - 4 * w ** (-p / 2) * (1 + 3 * p * b4 / (2 * w) + p * (p + 2) * b8 / (2 * w**2))
    spread = math.log1p(var / mu**2)  # in many dimensions var is far below the rounding of mu
    log_mean, log_sd = math.log(mu) - spread / 2, math.sqrt(spread)
    return {"hz": hz, "hz_p_value": normal_sf((math.log(max(hz, 1e-300)) - log_mean) / log_sd)}


def shapiro_w(values: np.ndarray) -> tuple[float, float]:
    """(W, p-value) of one sample of 4 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 4:
        raise ValueError("Shapiro-Wilk needs four values")
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    total, r = float((m**2).sum()), 1 / math.sqrt(n)
    a = m / math.sqrt(total)
    last = _poly(_LAST, r) + a[-1]
    if n > 5:
        before = _poly(_NEXT, r) + a[-2]
        a = m / math.sqrt((total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2))
        a[-2], a[1] = before, -before
    else:
        a = m / math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / max(((x - x.mean()) ** 2).sum(), 1e-300)))
    return w, normal_sf(_shapiro_z(w, n))


def _shapiro_z(w: float, n: int) -> float:
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        return (-math.log(max(_poly(_SMALL_SHIFT, n) - y, 1e-300)) - _poly(_SMALL_MEAN, n)) / math.exp(_poly(_SMALL_SD, n))
    k = math.log(n)
    return (y - _poly(_LARGE_MEAN, k)) / math.exp(_poly(_LARGE_SD, k))


def _column_statistics(df: DataFrame, column: str) -> DataFrame:
    """(dim, w, p): a Shapiro-Wilk test of every feature, one group each."""
    flat = df.select(F.posexplode(F.col(column).cast("array<double>")).alias("dim", "x"))

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_w(frame["x"].to_numpy())
        return pd.DataFrame({"dim": [int(frame["dim"].iloc[0])], "w": [w], "p": [p]})

    return flat.groupBy("dim").applyInPandas(test, "dim int, w double, p double")


def shapiro(df: DataFrame, rows: int = 5000, column: str = "emb") -> dict[str, float]:
    """Shapiro-Wilk test of one seeded random feature."""
    row = _column_statistics(subsample(df, rows, 1, column=column), column).orderBy("dim").first()
    return {"shapiro_w": row["w"], "shapiro_p": row["p"]}


def royston(df: DataFrame, rows: int = 1000, columns: int = 100, column: str = "emb") -> dict[str, float]:
    """Royston's H: Shapiro-Wilk z-scores of all features, with the degrees of freedom that their correlations leave."""
    cut = subsample(df, rows, columns, column=column).persist()
    try:
        n = cut.count()
        scores = [_shapiro_z(r["w"], n) for r in _column_statistics(cut, column).orderBy("dim").collect()]
        scatter = moments(cut, column).scatter
    finally:
        cut.unpersist()
    p = len(scores)
    sd = np.sqrt(np.diag(scatter))
    correlation = np.clip(scatter / np.maximum(np.outer(sd, sd), 1e-300), -1, 1)
    k = math.log(n)
    v = 0.21364 + 0.015124 * k**2 - 0.0018034 * k**3
    shrunk = np.abs(correlation) ** 5 * (1 - 0.715 * (1 - np.abs(correlation)) ** 0.715 / v)
    mean = (shrunk.sum() - p) / (p * p - p) if p > 1 else 0.0
    df_left = p / (1 + (p - 1) * mean)
    h = df_left / p * sum(normal_ppf(max(normal_sf(z), 1e-300) / 2) ** 2 for z in scores)
    return {"royston_h": float(h), "royston_p": float(chi2_sf(h, df_left))}


def spectrum(df: DataFrame, components: int = 100, column: str = "emb") -> DataFrame:
    """(component, ratio, cumulative) of the standardised table's principal components."""
    found = leading_axes(df, components, column, scaled=True)
    ratio = found.values / max(found.total, 1e-300)
    spark = df.sparkSession
    rows = spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratio)], "component int, ratio double")
    return rows.withColumn("cumulative", F.sum("ratio").over(Window.orderBy("component")))


def components_needed(df: DataFrame, share: float, components: int = 100, column: str = "emb") -> int:
    """Fewest components that explain ``share`` of the variance, at most ``components``."""
    found = spectrum(df, components, column).where(F.col("cumulative") >= share).agg(F.min("component")).first()[0]
    return found if found is not None else min(components, df.select(F.size(column)).first()[0])


def mean_magnitude(df: DataFrame, column: str = "emb") -> DataFrame:
    return df.agg(F.avg(F.sqrt(F.aggregate(F.col(column).cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))).alias("mean_magnitude"))


def eigenvalue_entropy(df: DataFrame, leading: int = 20, column: str = "emb") -> float:
    """Entropy of the leading components' shares of variance."""
    values = leading_axes(df, leading, column).values
    shares = values / max(values.sum(), 1e-300)
    return float(-(shares * np.log(np.maximum(shares, 1e-300))).sum())


def layer_metrics(layers: DataFrame, features: int = 10, column: str = "emb") -> DataFrame:
    """One row of all tests for each layer, on the first ``features`` features."""
    spark = layers.sparkSession
    rows = []
    for (layer,) in layers.select("layer").distinct().orderBy("layer").collect():
        part = layers.where(F.col("layer") == layer).withColumn(column, F.slice(F.col(column), 1, features)).persist()
        found = mardia(part, column) | royston(part, column=column) | henze_zirkler(part, column=column)
        part.unpersist()
        rows.append((int(layer), *(float(found[c]) for c in ("skewness", "kurtosis", "skewness_p", "kurtosis_p", "royston_p", "hz_p_value"))))
    return spark.createDataFrame(rows, "layer int, skewness double, kurtosis double, skewness_p double, kurtosis_p double, royston_p double, hz_p_value double")


def event_comparison(events: DataFrame, most: int = 50) -> DataFrame:
    """Side by side: row i has each dataset's i-th event (columns dataset__time, dataset__dur, dataset__note).

    ``events``: (dataset, ev_idx, time, dur, note) of one window a dataset.
    """
    order = Window.partitionBy("dataset").orderBy("ev_idx")
    numbered = events.withColumn("row", F.row_number().over(order) - 1).where(F.col("row") < most)
    wide = numbered.groupBy("row").pivot("dataset").agg(F.first("time").alias("_time"), F.first("dur").alias("_dur"), F.first("note").alias("_note"))
    return wide.orderBy("row")
