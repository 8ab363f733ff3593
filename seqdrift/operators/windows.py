"""Sliding windows over token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.functions.tokens import event_tuples


def window_index(sequences: DataFrame, events: int = V.WINDOW_EVENTS, step: int = V.WINDOW_STRIDE, velocity: bool = False, drop_last: bool = True) -> DataFrame:
    """Add ``start`` (tokens after the leading one): one row per window. Sequences of at most one token have none."""
    k, by = events * V.stride(velocity), step * V.stride(velocity)
    tail = F.size("tokens") - 1
    last = tail - k if drop_last else tail - 1
    starts = F.when((F.size("tokens") > 1) & (last >= 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(by)))
    return sequences.withColumn("start", F.explode(starts))


def materialise(index: DataFrame, events: int = V.WINDOW_EVENTS, velocity: bool = False) -> DataFrame:
    """Add ``input_ids``: the sequence's leading token and the window's tokens."""
    k = events * V.stride(velocity)
    return index.withColumn("input_ids", F.concat(F.slice("tokens", 1, 1), F.slice("tokens", F.col("start") + 2, F.lit(k))))


def _spans(window: Column) -> Column:
    """(onset, duration) of the sounding events of a window with a leading token, by onset.

    Ticks go through seconds and back with truncation, which loses a tick for some values; gaps are measured on those.
    """

    def one(e: Column) -> Column:
        shift = F.when((e[0] >= V.ANTICIPATED) & (e[0] < V.ANTICIPATED_DURATION), V.ANTICIPATED).otherwise(0)
        onset = ((e[0] - shift) / F.lit(100.0) * F.lit(100.0)).cast("int")
        duration = ((F.get(e, F.lit(1)) - shift - V.DURATION) / F.lit(100.0) * F.lit(100.0)).cast("int")
        return F.struct(onset.alias("onset"), duration.alias("duration"))

    sounding = F.filter(event_tuples(window), lambda e: ~F.array_contains(e, V.SEP) & (F.coalesce(F.get(e, F.lit(2)), F.lit(V.REST)) != V.REST))
    return F.array_sort(F.transform(sounding, one))


def acceptable_gaps(window: Column, limit: int = V.MAX_SILENCE) -> Column:
    """Whether no silence in a window is longer than ``limit`` ticks; a negative limit accepts all.

    One pass over the window's sorted events inside a higher-order function, without exploding windows to events.
    """
    if limit < 0:
        return F.lit(True)
    start = F.struct(F.lit(None).cast("int").alias("end"), F.lit(True).alias("ok"))

    def step(s: Column, e: Column) -> Column:
        end = e["onset"] + e["duration"]
        fine = s["ok"] & F.coalesce(e["onset"] - s["end"] <= limit, F.lit(True))
        return F.struct(F.greatest(s["end"], end).alias("end"), fine.alias("ok"))

    return F.aggregate(_spans(window), start, step, lambda s: s["ok"])


def acceptable_gaps_by_join(windows: DataFrame, limit: int = V.MAX_SILENCE) -> DataFrame:
    """The same filter as rows: (seq_id, start, ok), by exploding windows and a running maximum of ends."""
    rows = windows.select("seq_id", "start", F.posexplode_outer(_spans(F.col("input_ids"))).alias("i", "e"))
    earlier = Window.partitionBy("seq_id", "start").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("e.onset") - F.max(F.col("e.onset") + F.col("e.duration")).over(earlier)
    marked = rows.select("seq_id", "start", F.coalesce(gap <= limit, F.lit(True)).alias("fine") if limit >= 0 else F.lit(True).alias("fine"))
    return marked.groupBy("seq_id", "start").agg(F.bool_and("fine").alias("ok"))


def with_labels(windows: DataFrame, mode: str = "clone") -> DataFrame:
    """Add ``labels``: ``lm`` shifts by one token, ``base`` slices the sequence's own labels at the window's start (one
    token off its leading token, as it has none), ``clone`` copies the input."""
    if mode == "lm":
        n = F.size("input_ids") - 1
        return windows.withColumn("labels", F.slice("input_ids", F.lit(2), n)).withColumn("input_ids", F.slice("input_ids", F.lit(1), n))
    if mode == "base":
        return windows.withColumn("labels", F.slice("base_labels", F.col("start") + 1, F.size("input_ids")))
    if mode == "clone":
        return windows.withColumn("labels", F.col("input_ids"))
    raise ValueError(f"labels must be lm, base or clone, not {mode}")


def sample(index: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` windows without replacement (all, if there are fewer), the same ones for the same seed."""
    return index.orderBy(F.xxhash64("seq_id", "start", F.lit(seed)), "seq_id", "start").limit(n)


def sliding_windows(sequences: DataFrame, events: int = V.WINDOW_EVENTS, step: int = V.WINDOW_STRIDE, velocity: bool = False, limit: int = V.MAX_SILENCE, drop_last: bool = True) -> DataFrame:
    """Index, materialise and filter; the silence filter runs before anything costly sees a window."""
    made = materialise(window_index(sequences, events, step, velocity, drop_last), events, velocity)
    return made.where(acceptable_gaps(F.col("input_ids"), limit)).drop("tokens")
