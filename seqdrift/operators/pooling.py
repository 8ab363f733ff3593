"""Pooling of hidden states: (L, D) arrays to (2D) embeddings, as Column functions on array<array<double>>."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zeros(h: Column) -> Column:
    return F.transform(h[0], lambda x: F.lit(0.0))


def _column_sums(h: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Sum over positions of value(position's vector, position) for every dimension."""
    return F.aggregate(F.transform(h, value), _zeros(h), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))


def _guarded(h: Column) -> Column:
    bad = F.exists(h, lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return F.when(bad, F.raise_error(F.lit("NaN in hidden states")).cast("array<array<double>>")).otherwise(h)


def pool_mean_std(h: Column) -> Column:
    """Means, then population standard deviations over positions; NaN fails the query."""
    safe = _guarded(h)

    def pooled(x: Column) -> Column:
        n = F.size(x).cast("double")
        mean = F.transform(_column_sums(x, lambda v: v), lambda s: s / n)
        var = _column_sums(x, lambda v: F.zip_with(v, mean, lambda a, m: (a - m) * (a - m)))
        return F.concat(mean, F.transform(var, lambda s: F.sqrt(s / n)))

    return F.transform(F.array(safe), pooled)[0]


def pool_last_k(h: Column, k: int | None) -> Column:
    """``pool_mean_std`` over the last k positions; all of them if k is None or too large."""
    if k is None:
        return pool_mean_std(h)
    n = F.least(F.lit(k), F.size(h))
    return pool_mean_std(F.slice(h, F.size(h) - n + 1, n))


def norm_weighted_mean_std(h: Column, eps: float = 1e-8) -> Column:
    """Means and deviations weighted by each position's norm."""

    def pooled(x: Column) -> Column:
        norms = F.transform(x, lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a)))
        total = F.aggregate(norms, F.lit(0.0), lambda s, a: s + a) + eps
        weighted = F.zip_with(x, norms, lambda v, w: F.transform(v, lambda a: a * w / total))
        mean = _column_sums(weighted, lambda v: v)
        spread = F.zip_with(x, norms, lambda v, w: F.zip_with(v, mean, lambda a, m: (a - m) * (a - m) * w / total))
        return F.concat(mean, F.transform(_column_sums(spread, lambda v: v), lambda s: F.sqrt(s + eps)))

    return F.transform(F.array(h), pooled)[0]


def pool_positions(states: DataFrame) -> DataFrame:
    """The same means and deviations from long rows (sample_id, layer, pos, h), with no array of positions."""
    flat = states.select("sample_id", "layer", F.posexplode("h").alias("dim", "x"))
    each = flat.groupBy("sample_id", "layer", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    rows = each.groupBy("sample_id", "layer").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("r"))
    return rows.select("sample_id", "layer", F.concat("r.mean", "r.std").alias("emb"))


POOLS = {"mean_std": pool_mean_std, "norm_weighted": norm_weighted_mean_std}


def concat_layers(layers: dict[int, DataFrame]) -> DataFrame:
    """All layers' embeddings one after another, with the layer kept as a column."""
    parts = [df.withColumn("layer", F.lit(layer)) for layer, df in sorted(layers.items())]
    return reduce(DataFrame.unionByName, parts)


#: A model boundary: a batch of token lists and the wanted layers to {layer: list of (L, D) arrays}.
HiddenStates = Callable[[list[list[int]], list[int]], dict[int, list[np.ndarray]]]


def toy_hidden_states(dimensions: int = 8) -> HiddenStates:
    """A deterministic stand-in for a model: hashed projections of each token, one phase per layer."""

    def run(batch: list[list[int]], layers: list[int]) -> dict[int, list[np.ndarray]]:
        axes = np.arange(1, dimensions + 1)
        return {layer: [np.sin(np.outer(np.array(ids, float) + 1, axes) * 0.618 + layer) for ids in batch] for layer in layers}

    return run


def _segments(states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all positions, each window's first, how many it has) of a batch's states; NaN and empty windows fail."""
    lengths = np.array([len(h) for h in states])
    if not lengths.all():
        raise ValueError("a window without ids has no states")
    flat = np.concatenate(states).astype(float, copy=False)
    if np.isnan(flat).any():
        raise ValueError("NaN in hidden states")
    return flat, np.cumsum(lengths) - lengths, lengths


def _mean_std_rows(states: list[np.ndarray]) -> np.ndarray:
    """``pool_mean_std`` of a batch's states, a row a window."""
    flat, starts, lengths = _segments(states)
    mean = np.add.reduceat(flat, starts) / lengths[:, None]
    var = np.add.reduceat(np.square(flat - np.repeat(mean, lengths, axis=0)), starts) / lengths[:, None]
    return np.concatenate((mean, np.sqrt(var)), axis=1)


def _model_input(windows: DataFrame, id_col: str) -> DataFrame:
    return windows.select(F.col(id_col).cast("long").alias("sample_id"), F.col("input_ids").cast("array<int>").alias("input_ids"))


_EMBEDDED = pa.schema([("sample_id", pa.int64()), ("layer", pa.int32()), ("emb", pa.list_(pa.float64()))])


def extract_representations(windows: DataFrame, model: HiddenStates, layers: list[int], pool: Callable[[Column], Column] = pool_mean_std, batch_size: int = 8, id_col: str = "sample_id") -> DataFrame:
    """(sample_id, layer, emb): one forward pass a batch gives all wanted layers. Means and deviations are taken where the
    states are, so that only they leave the task; another ``pool`` is a DataFrame expression over the states."""
    if pool is pool_mean_std:

        def embed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                made: dict[int, list[np.ndarray]] = {layer: [] for layer in layers}
                for low in range(0, frame.num_rows, batch_size):
                    states = model(frame.column("input_ids").slice(low, batch_size).to_pylist(), layers)
                    for layer in layers:
                        made[layer].append(_mean_std_rows(states[layer]))
                for layer, rows in made.items():
                    if rows:
                        emb = np.concatenate(rows)
                        ends = pa.array(np.arange(len(emb) + 1, dtype=np.int32) * emb.shape[1])
                        yield pa.RecordBatch.from_arrays([frame.column("sample_id"), pa.array(np.full(len(emb), layer, np.int32)), pa.ListArray.from_arrays(ends, pa.array(emb.ravel()))], schema=_EMBEDDED)

        return _model_input(windows, id_col).mapInArrow(embed, "sample_id long, layer int, emb array<double>")

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), batch_size):
                part = frame.iloc[low : low + batch_size]
                states = model([list(x) for x in part["input_ids"]], layers)
                ids = part["sample_id"].tolist()
                yield pd.DataFrame([(i, layer, h.tolist()) for layer in layers for i, h in zip(ids, states[layer], strict=True)], columns=["sample_id", "layer", "h"])

    return _model_input(windows, id_col).mapInPandas(forward, "sample_id long, layer int, h array<array<double>>").select("sample_id", "layer", pool(F.col("h")).alias("emb"))


def toy_embeddings(sequences: DataFrame, dimensions: int = 8, layer: int = 12) -> DataFrame:
    """(sample_id, emb) of whole token sequences (seq_id, tokens), by the toy model: a first stage for ``Extract``."""
    windows = sequences.select(F.col("seq_id").alias("sample_id"), F.col("tokens").alias("input_ids"))
    return extract_representations(windows, toy_hidden_states(dimensions), [layer]).drop("layer")
