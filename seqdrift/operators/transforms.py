"""Fitted transformations as pyspark.ml estimators over array<double> columns."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from types import FunctionType

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.operators.linalg import DENSE_WIDTH, feature_moments, leading_axes


class _Stage(HasInputCol, HasOutputCol):
    """Stages read and write the same column unless told otherwise."""

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCol="emb", outputCol="emb")

    def _columns(self, inputCol: str | None, outputCol: str | None):
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol or inputCol)
        elif outputCol:
            self._set(outputCol=outputCol)
        return self


def _array(values) -> Column:
    """An array constant; a long one is a single literal, parsed once by constant folding."""
    listed = [float(v) for v in values]
    return F.array(*map(F.lit, listed)) if len(listed) <= 64 else F.from_json(F.lit(json.dumps(listed)), "array<double>")


#: Numbers of a matrix that are written into an expression; wider products run over Arrow batches.
EXPRESSION_NUMBERS = 1024


def batched(x: Column, function: Callable[[np.ndarray], np.ndarray], kind: str = "array<double>") -> Column:
    """``function`` of blocks of stacked vectors, with one matrix product a block; a null vector gives null."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), None, object)
            known = np.flatnonzero(batch.notna().to_numpy())
            for low in range(0, len(known), 1024):
                at = known[low : low + 1024]
                for i, value in zip(at, function(np.stack(batch.iloc[at].to_numpy()).astype(float)), strict=True):
                    out[i] = value
            yield pd.Series(out)

    return run(x.cast("array<double>"))


def affine(x: Column, matrix: np.ndarray, offset: np.ndarray) -> Column:
    """(x - offset) times the matrix: one expression per output dimension, or a matrix product for a large matrix."""
    if matrix.size > EXPRESSION_NUMBERS:
        return batched(x, lambda v: (v - offset) @ matrix)
    shifted = F.zip_with(x, _array(offset), lambda a, b: a - b)

    def dot(y: Column) -> Column:
        return F.array(*[F.aggregate(F.zip_with(y, _array(c), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for c in matrix.T])

    return F.transform(F.array(shifted), dot)[0]


def _scaled(x: Column, p: dict) -> Column:
    scale = np.where(p["std"] > 0, p["std"], 1.0)
    return F.zip_with(F.zip_with(x, _array(p["mean"]), lambda a, b: a - b), _array(scale), lambda a, b: a / b)


def _chosen(x: Column, p: dict) -> Column:
    return F.transform(_array(p["indices"]), lambda i: F.get(x, i.cast("int")))


def _centre_distances(x: Column, p: dict) -> Column:
    centres = p["centers"]
    if centres.size > EXPRESSION_NUMBERS:
        return batched(x, lambda v: np.stack([np.sqrt(((v - c) ** 2).sum(axis=1)) for c in centres], axis=1))
    return F.transform(F.array(x), lambda y: F.array(*[F.sqrt(F.aggregate(F.zip_with(y, _array(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) for c in centres]))[0]


#: What a fitted stage of each kind does to its column.
FUNCTIONS: dict[str, Callable[[Column, dict], Column]] = {
    "scaler": _scaled,
    "pca": lambda x, p: affine(x, p["components"].T, p["mean"]),
    "subsample": _chosen,
    "kmeans": _centre_distances,
}


class _Saved(MLWritable, MLReadable):
    """Stages that are written and read: names and numbers in the metadata, arrays as a Parquet table of their rows."""

    def _state(self) -> tuple[dict, dict[str, np.ndarray]]:
        raise NotImplementedError

    @classmethod
    def _restored(cls, names: dict, arrays: dict[str, np.ndarray], path: str):
        raise NotImplementedError

    def _save_parts(self, path: str) -> None:
        """Write what is neither names nor arrays."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: _Saved) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        names, arrays = self.stage._state()
        shapes = {k: list(np.shape(v)) for k, v in arrays.items()}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sc, extraMetadata={"names": names, "shapes": shapes})
        rows = [(k, i, row.tolist()) for k, v in arrays.items() for i, row in enumerate(np.asarray(v, float).reshape(-1, max(1, np.shape(v)[-1])))]
        self.sparkSession.createDataFrame(rows, "name string, i int, row array<double>").write.parquet(f"{path}/arrays")
        self.stage._save_parts(path)


class _Reader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        found: dict[str, list] = {}
        for r in self.sparkSession.read.parquet(f"{path}/arrays").collect():
            found.setdefault(r["name"], []).append((r["i"], r["row"]))
        arrays = {k: np.array([row for _, row in sorted(found[k])], float).reshape(shape) for k, shape in metadata["shapes"].items()}
        return self.kind._restored(metadata["names"], arrays, path)


class ColumnModel(_Stage, Model, _Saved):
    """A fitted stage: one of ``FUNCTIONS`` with its parameters, ``fitted``."""

    def __init__(self, kind: str, inputCol: str = "emb", outputCol: str = "emb", **fitted) -> None:
        super().__init__()
        self.kind, self.fitted = kind, {"kind": kind, **{k: np.asarray(v) for k, v in fitted.items()}}
        self._columns(inputCol, outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), FUNCTIONS[self.kind](F.col(self.getInputCol()), self.fitted))

    def _state(self) -> tuple[dict, dict[str, np.ndarray]]:
        return {"kind": self.kind, "input": self.getInputCol(), "output": self.getOutputCol()}, {k: v for k, v in self.fitted.items() if k != "kind"}

    @classmethod
    def _restored(cls, names: dict, arrays: dict[str, np.ndarray], path: str) -> ColumnModel:
        return cls(names["kind"], names["input"], names["output"], **arrays)


_OWN = __name__.partition(".")[0]
_REGISTERED: dict[str, Callable] = {}


def register_function(function: Callable) -> Callable:
    """Let stages with a function from outside this package be written, and read where it has been registered too."""
    if "<" in function.__qualname__:
        raise ValueError(f"{function.__qualname__} has no name to be found by")
    _REGISTERED[f"{function.__module__}:{function.__qualname__}"] = function
    return function


def _name_of(function: Callable) -> str:
    name = f"{function.__module__}:{function.__qualname__}"
    if "<" in name:
        raise ValueError(f"{name} has no name to be found by: a stage that is written needs a function of a module")
    if _REGISTERED.get(name) is not function and function.__module__.partition(".")[0] != _OWN:
        raise ValueError(f"{name} is not registered: call register_function, here and where the stage is read")
    return name


def _function_of(name: str) -> Callable:
    """A registered function, or one defined in this package; a file cannot name any other, nor import a module."""
    if name in _REGISTERED:
        return _REGISTERED[name]
    module, _, path = name.partition(":")
    found = importlib.import_module(module) if module.partition(".")[0] == _OWN else None
    for part in path.split("."):
        found = getattr(found, part, None)
    if not isinstance(found, FunctionType) or found.__module__ != module or found.__qualname__ != path:
        raise ValueError(f"{name} is neither registered nor a function of this package")
    return found


class Apply(_Stage, Transformer, _Saved):
    """Any Column function as a stage without a fit; a module's function can be written by its name."""

    def __init__(self, function: Callable[[Column], Column], inputCol: str = "emb", outputCol: str | None = None) -> None:
        super().__init__()
        self.function = function
        self._columns(inputCol, outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), self.function(F.col(self.getInputCol())))

    def _state(self) -> tuple[dict, dict[str, np.ndarray]]:
        return {"function": _name_of(self.function), "input": self.getInputCol(), "output": self.getOutputCol()}, {}

    @classmethod
    def _restored(cls, names: dict, arrays: dict[str, np.ndarray], path: str) -> Apply:
        return cls(_function_of(names["function"]), names["input"], names["output"])


class Extract(Transformer, _Saved):
    """Rows to embeddings as a first stage, so that a fitted pipeline takes what comes before embeddings, such as tokens.

    ``function`` takes a table to one with an ``emb`` column; settings are its keyword arguments.
    """

    def __init__(self, function: Callable[..., DataFrame], **settings) -> None:
        super().__init__()
        self.function, self.settings = function, settings

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.function(df, **self.settings)

    def _state(self) -> tuple[dict, dict[str, np.ndarray]]:
        return {"function": _name_of(self.function), "settings": self.settings}, {}

    @classmethod
    def _restored(cls, names: dict, arrays: dict[str, np.ndarray], path: str) -> Extract:
        return cls(_function_of(names["function"]), **names["settings"])


def row_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


class StandardScaler(_Stage, Estimator):
    """(x - mean) / population standard deviation; a constant feature is only centred."""

    def __init__(self, inputCol: str = "emb", outputCol: str | None = None) -> None:
        super().__init__()
        self._columns(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> ColumnModel:
        _, mean, variance = feature_moments(df, self.getInputCol())
        return ColumnModel("scaler", self.getInputCol(), self.getOutputCol(), mean=mean, std=np.sqrt(variance))


class PCA(_Stage, Estimator):
    """Centred projection on the leading principal axes; each axis has its largest loading positive.

    Vectors wider than ``dense_width`` get their axes from passes over the rows, without a matrix of their width squared.
    """

    def __init__(self, n_components: int, inputCol: str = "emb", outputCol: str | None = None, dense_width: int = DENSE_WIDTH) -> None:
        super().__init__()
        self.n_components, self.dense_width = n_components, dense_width
        self._columns(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> ColumnModel:
        found = leading_axes(df, self.n_components, self.getInputCol(), dense_width=self.dense_width)
        ratio = found.values / max(found.total, 1e-300)
        return ColumnModel("pca", self.getInputCol(), self.getOutputCol(), mean=found.mean, components=found.axes.T, explained_variance=found.values, explained_variance_ratio=ratio)


class Subsample(_Stage, Estimator):
    """A seeded random choice of at most ``n`` features."""

    def __init__(self, n: int, seed: int = 42, replace: bool = False, inputCol: str = "emb", outputCol: str | None = None) -> None:
        super().__init__()
        self.n, self.seed, self.replace = n, seed, replace
        self._columns(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> ColumnModel:
        d = len(df.select(self.getInputCol()).first()[0])
        rng = np.random.default_rng(self.seed)
        chosen = rng.integers(0, d, self.n) if self.replace else rng.permutation(d)[: min(self.n, d)]
        return ColumnModel("subsample", self.getInputCol(), self.getOutputCol(), indices=[int(i) for i in chosen])


#: Restarts of k-means that run at the same time.
_RUNS = 8


class KMeansDistance(_Stage, Estimator):
    """Distances to k centres, the best of ``restarts`` seeded runs over all rows; centres in ascending order.

    ``max_rows`` fits on a sample of that many rows instead, chosen by a seeded hash.
    """

    def __init__(self, k: int, seed: int = 42, max_rows: int | None = None, restarts: int = 10, inputCol: str = "emb", outputCol: str | None = None) -> None:
        super().__init__()
        self.k, self.seed, self.max_rows, self.restarts = k, seed, max_rows, restarts
        self._columns(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> ColumnModel:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        from pyspark.util import inheritable_thread_target

        column = self.getInputCol()
        rows = df.select(F.col(column).cast("array<double>").alias("x"))
        if self.max_rows is not None and rows.count() > self.max_rows:
            rows = rows.orderBy(F.xxhash64("x", F.lit(self.seed)), "x").limit(self.max_rows)
        rows = rows.select(array_to_vector("x").alias("features")).persist()
        try:
            rows.count()  # runs side by side would each read the rows

            @inheritable_thread_target(rows.sparkSession)
            def run(i: int):
                return KMeans(k=self.k, seed=self.seed + i, maxIter=100).fit(rows)

            with ThreadPoolExecutor(min(self.restarts, _RUNS)) as pool:  # a step is a short job: one run leaves executors idle
                runs = list(pool.map(run, range(self.restarts)))
        finally:
            rows.unpersist()
        best = min(runs, key=lambda m: m.summary.trainingCost)
        return ColumnModel("kmeans", column, self.getOutputCol(), centers=np.array(sorted(map(list, best.clusterCenters()))))


class Ensemble(_Stage, Estimator):
    """Members of one base pipeline, each fitted on its own random features; their outputs are pooled by position."""

    def __init__(self, stages: Callable[[], list], members: int, dims: int, pool: str = "mean", replace: bool = False, seed: int | None = None, inputCol: str = "emb", outputCol: str | None = None) -> None:
        super().__init__()
        self.stages, self.members, self.dims, self.pool, self.replace = stages, members, dims, pool, replace
        self.seed = 0 if seed is None else seed
        self._columns(inputCol, outputCol)

    def _fit(self, df: DataFrame) -> EnsembleModel:
        column = self.getInputCol()
        if self.dims > len(df.select(column).first()[0]):
            raise ValueError("more dimensions asked for than there are")
        fitted = []
        for i in range(self.members):
            source = df.select(F.col(column).alias("emb"))
            fitted.append(Pipeline(stages=[Subsample(self.dims, self.seed + i, self.replace), *self.stages()]).fit(source))
        return EnsembleModel(fitted, self.pool, column, self.getOutputCol())


class EnsembleModel(_Stage, Model, _Saved):
    def __init__(self, fitted: list, pool: str, inputCol: str, outputCol: str) -> None:
        super().__init__()
        self.fitted, self.pool = fitted, pool
        self._columns(inputCol, outputCol)

    def _state(self) -> tuple[dict, dict[str, np.ndarray]]:
        return {"members": len(self.fitted), "pool": self.pool, "input": self.getInputCol(), "output": self.getOutputCol()}, {}

    def _save_parts(self, path: str) -> None:
        for i, member in enumerate(self.fitted):
            member.write().save(f"{path}/members/{i}")

    @classmethod
    def _restored(cls, names: dict, arrays: dict[str, np.ndarray], path: str) -> EnsembleModel:
        return cls([PipelineModel.load(f"{path}/members/{i}") for i in range(names["members"])], names["pool"], names["input"], names["output"])

    def member_outputs(self, df: DataFrame) -> DataFrame:
        """Adds ``members_``: an array with one output a member. Stages are column functions, so nothing is joined."""
        keep, spare = df.columns, "emb_input_"
        out = df.withColumn(spare, F.col(self.getInputCol()))
        for i, model in enumerate(self.fitted):
            out = model.transform(out.withColumn("emb", F.col(spare))).withColumnRenamed("emb", f"member_{i}_")
        names = [f"member_{i}_" for i in range(len(self.fitted))]
        gone = [c for c in keep if c == "emb"]
        out = out.withColumn("members_", F.array(*names))
        if gone:
            out = out.withColumn("emb", F.col(spare))
        return out.select(*keep, "members_")

    def _transform(self, df: DataFrame) -> DataFrame:
        def pooled(m: Column) -> Column:
            if self.pool == "max":
                return F.aggregate(F.slice(m, 2, F.size(m) - 1) if len(self.fitted) > 1 else F.array().cast("array<array<double>>"), m[0], lambda s, x: F.zip_with(s, x, lambda a, b: F.greatest(a, b)))
            total = F.aggregate(m, F.transform(m[0], lambda x: F.lit(0.0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
            return F.transform(total, lambda x: x / len(self.fitted))

        return self.member_outputs(df).withColumn(self.getOutputCol(), pooled(F.col("members_"))).drop("members_")


__all__ = ["Apply", "ColumnModel", "Ensemble", "EnsembleModel", "Extract", "KMeansDistance", "PCA", "StandardScaler", "Subsample", "affine", "batched", "row_mean"]
