"""All wanted layers of all windows, in one forward pass a window, over padded batches of windows of like length.

What leaves a task are pooled vectors; the states of a batch stay where they were made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.operators.settle import settled
from seqdrift.sources.io import EmbeddingCache

ROWS = "sample_id long, layer int, emb array<double>"
_SCHEMA = pa.schema([("sample_id", pa.int64()), ("layer", pa.int32()), ("emb", pa.list_(pa.float64()))])
#: Ids padded with 0 (windows, positions) and the wanted layers to {layer: states (windows, positions, dimensions)}.
PaddedStates = Callable[[np.ndarray, list[int]], dict[int, np.ndarray]]
#: States and which positions count, (windows, positions), to one vector a window.
Pool = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Model:
    """A model by name: ``load`` runs once in each Python worker, and ``depth`` layers follow the embedding, layer 0."""

    name: str
    load: Callable[[], Callable]
    depth: int = 0

    @property
    def layers(self) -> list[int]:
        return list(range(self.depth + 1))


_loaded: dict[str, Callable] = {}


def in_worker(model: Model) -> Callable:
    if model.name not in _loaded:
        _loaded.clear()  # a worker holds one model
        _loaded[model.name] = model.load()
    return _loaded[model.name]


def mean_std(states: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means, then population deviations, over the positions that count."""
    w = counts[:, :, None] / counts.sum(axis=1)[:, None, None]
    mean = (states * w).sum(axis=1)
    return np.concatenate((mean, np.sqrt((np.square(states - mean[:, None]) * w).sum(axis=1))), axis=1)


def last_k(k: int) -> Pool:
    """``mean_std`` of each window's last k positions, or of all if there are fewer."""

    def pool(states: np.ndarray, counts: np.ndarray) -> np.ndarray:
        from_end = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        return mean_std(states, counts * (from_end <= k))

    return pool


def norm_weighted(states: np.ndarray, counts: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """Means and deviations weighted by each position's norm."""
    norms = np.sqrt(np.square(states).sum(axis=2)) * counts
    w = (norms / (norms.sum(axis=1, keepdims=True) + eps))[:, :, None]
    mean = (states * w).sum(axis=1)
    return np.concatenate((mean, np.sqrt((np.square(states - mean[:, None]) * w).sum(axis=1) + eps)), axis=1)


def _pooled(sample_ids: pa.Array, ids: pa.ListArray, model: Model, layers: list[int], pool: Pool, pad_counts: bool) -> Iterator[pa.RecordBatch]:
    """One padded batch through the model; a record batch a layer."""
    lengths = np.diff(ids.offsets.to_numpy())
    real = np.arange(lengths.max())[None, :] < lengths[:, None]
    padded = np.zeros(real.shape, np.int64)
    padded[real] = ids.flatten().to_numpy(zero_copy_only=False)
    states = in_worker(model)(padded, layers)
    counts = np.ones_like(real, float) if pad_counts else real.astype(float)
    for layer in layers:
        h = np.where(counts[:, :, None] > 0, states[layer], 0.0)  # a model may leave anything in the padding
        if np.isnan(h).any():
            raise ValueError(f"NaN in the hidden states of layer {layer}")
        out = np.ascontiguousarray(pool(h, counts), dtype=float)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        yield pa.RecordBatch.from_arrays([sample_ids, pa.array(np.full(len(out), layer, np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], schema=_SCHEMA)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the number of each row in a total order, from 0: rows are dealt by ranges, and each range starts after the
    rows of those before it. The driver sees one count a range."""
    ranges = settled(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    counts = sorted((r["range_"], r["count"]) for r in ranges.groupBy("range_").count().collect())
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "range_ int, before_ long")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranges.withColumn("place_", place).join(F.broadcast(offsets), "range_").withColumn(name, F.col("before_") + F.col("place_")).drop("range_", "place_", "before_")


def extract_layers(windows: DataFrame, model: Model, layers: list[int] | None = None, pool: Pool = mean_std, batch_size: int = 100, pad_compat: bool = False, order: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """(sample_id, layer, emb) of windows (sample_id, input_ids): every window meets the model once, for all layers.

    Each task sorts its windows by length and cuts batches from them, so little is padded and nothing is shuffled; only
    true positions are pooled, so a row does not depend on its batch. With ``pad_compat``, batches are consecutive
    windows in ``order``, a total one, and padding is pooled like other positions. Windows without ids are left out.
    """
    wanted = model.layers if layers is None else sorted(set(layers))
    if not set(wanted) <= set(model.layers):
        raise ValueError(f"layers {wanted}: {model.name} has {model.layers}")
    there = windows.where(F.size("input_ids") > 0)
    if pad_compat:
        batches = numbered(there.select(*dict.fromkeys(["sample_id", "input_ids", *order])), list(order), "row_")
        batches = batches.select(F.floor(F.col("row_") / batch_size).alias("batch_"), F.col("sample_id").cast("long").alias("sample_id"), F.col("input_ids").cast("array<int>").alias("input_ids"))

        def batch(rows: pa.Table) -> pa.Table:
            ids = rows.column("input_ids").combine_chunks()
            return pa.Table.from_batches(_pooled(rows.column("sample_id").combine_chunks(), ids, model, wanted, pool, True), _SCHEMA)

        return batches.groupBy("batch_").applyInArrow(batch, ROWS)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for low in range(0, frame.num_rows, batch_size):
                part = frame.slice(low, batch_size)
                yield from _pooled(part.column("sample_id"), part.column("input_ids"), model, wanted, pool, False)

    rows = there.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("input_ids").cast("array<int>").alias("input_ids"))
    return rows.sortWithinPartitions(F.size("input_ids"), "sample_id").mapInArrow(run, ROWS)


def extract_all_layers(cache: EmbeddingCache, windows: DataFrame, model: Model, dataset: str, version: str, pool: Pool = mean_std, **how) -> DataFrame:
    """All layers from the cache; if one is missing, all are extracted and become visible in it at once.

    The pool's name is part of the key, ``version`` should name the data and the model.
    """
    name = getattr(pool, "__name__", "pool") + ("_padded" if how.get("pad_compat") else "")
    found = cache.read(dataset, name, model.layers, version)
    if found is None:
        cache.write(extract_layers(windows, model, pool=pool, **how), dataset, name, version)
        found = cache.read(dataset, name, model.layers, version)
    return found


def toy(dimensions: int = 8, depth: int = 12) -> Model:
    """The deterministic stand-in of ``pooling.toy_hidden_states`` on padded batches."""

    def load() -> PaddedStates:
        axes = np.arange(1, dimensions + 1)

        def run(ids: np.ndarray, layers: list[int]) -> dict[int, np.ndarray]:
            phase = (ids[:, :, None] + 1.0) * axes * 0.618
            return {layer: np.sin(phase + layer) for layer in layers}

        return run

    return Model(f"toy-{dimensions}-{depth}", load, depth)
