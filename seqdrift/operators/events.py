"""Token-stream algebra on the event table (seq_id, ev_idx, time, dur, note[, vel]).

Columns hold raw tokens. Every window is partitioned by sequence; orders end in ev_idx, so results do not depend on row
order. Functions return event tables unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.functions.tokens import event_tuples

_FIELDS = ("time", "dur", "note", "vel")


def to_events(sequences: DataFrame, velocity: bool = False, skip: int = 1) -> DataFrame:
    """Explode token arrays into events; ``skip`` leading tokens are left out."""
    k = V.stride(velocity)
    exploded = sequences.select("seq_id", F.posexplode(event_tuples(F.col("tokens"), velocity, skip)).alias("ev_idx", "e"))
    return exploded.select("seq_id", "ev_idx", *[F.get("e", F.lit(i)).alias(c) for i, c in enumerate(_FIELDS[:k])])


def to_sequences(events: DataFrame, lead: int | None = None, order: tuple[str, ...] = ("ev_idx",)) -> DataFrame:
    """Collect each sequence's events back into one token array, in ``order``, after an optional leading token."""
    fields = [c for c in _FIELDS if c in events.columns]
    rows = F.array_sort(F.collect_list(F.struct(*order, F.array(*fields).alias("e_"))))
    tokens = F.flatten(F.transform(rows, lambda r: r["e_"]))
    tokens = F.concat(F.array(F.lit(lead)), tokens) if lead is not None else tokens
    return events.groupBy("seq_id").agg(tokens.alias("tokens"))


def _is_control() -> Column:
    return F.col("note") >= V.ANTICIPATED


def real_time() -> Column:
    return F.col("time") - F.when(_is_control(), V.ANTICIPATED).otherwise(V.TIME)


def real_duration() -> Column:
    return F.col("dur") - F.when(_is_control(), V.ANTICIPATED_DURATION).otherwise(V.DURATION)


def instrument() -> Column:
    return F.floor((F.col("note") - F.when(_is_control(), V.ANTICIPATED_NOTE).otherwise(V.NOTE)) / V.MAX_PITCH).cast("int")


def _ordered() -> Window:
    return Window.partitionBy("seq_id").orderBy("ev_idx")


def _ticks(x: float, seconds: bool) -> int:
    return int(V.TICKS * x) if seconds else int(x)


def clip(events: DataFrame, start: float, end: float, clip_duration: bool = True, seconds: bool = True) -> DataFrame:
    """Keep events that start inside [start, end]; shorten those that sound beyond the end."""
    low, high = _ticks(start, seconds), _ticks(end, seconds)
    kept = events.where(real_time().between(low, high))
    over = real_time() + real_duration() - high
    return kept.withColumn("dur", F.when(over > 0, F.col("dur") - over).otherwise(F.col("dur")).cast("int")) if clip_duration else kept


def mask(events: DataFrame, start: float, end: float) -> DataFrame:
    """Remove events that start strictly between two times in seconds."""
    seconds = real_time() / F.lit(float(V.TICKS))
    return events.where(~((seconds > start) & (seconds < end)))


def delete(events: DataFrame, criterion: Column) -> DataFrame:
    """Remove events that meet a condition on time, dur, note and vel."""
    return events.where(~F.coalesce(criterion, F.lit(False)))


def sort(events: DataFrame) -> DataFrame:
    """Renumber events by raw time; equal times keep their order."""
    order = Window.partitionBy("seq_id").orderBy("time", "ev_idx")
    return events.withColumn("new_", F.row_number().over(order) - 1).drop("ev_idx").withColumnRenamed("new_", "ev_idx")


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, controls); separators are controls."""
    return events.where(~_is_control()), events.where(_is_control())


def pad(events: DataFrame, end_time: int | None = None, density: int = V.TICKS) -> DataFrame:
    """Insert rests so that no two onsets are over ``density`` ticks apart, also before the first and up to the end.

    The end is ``end_time``, or the sequence's last onset if it is not given or 0. Controls are refused. New rows share
    the ev_idx of the event they precede and are renumbered.
    """
    order = _ordered()
    checked = events.withColumn("note", F.when(F.col("note") >= V.ANTICIPATED, F.raise_error(F.lit("pad before separating and anticipating")).cast("int")).otherwise(F.col("note")))
    before = F.lag("time", 1, 0).over(order)
    tail = F.when(F.lead("time").over(order).isNull(), 1).otherwise(0)
    ranked = checked.withColumns({"before_": before, "last_": tail})

    def rests(start: Column, stop: Column) -> Column:
        n = F.greatest(F.ceil((stop - start) / density) - 1, F.lit(0)).cast("int")
        return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: (start + i * density).cast("int")))

    velocity = [F.lit(V.VELOCITY).alias("vel")] if "vel" in events.columns else []

    def rest(t: Column, side: int) -> Column:
        return F.struct(F.lit(side).alias("side"), t.alias("time"), F.lit(V.DURATION).alias("dur"), F.lit(V.REST).alias("note"), *velocity)

    own = F.struct(F.lit(1).alias("side"), *[F.col(c) for c in _FIELDS if c in events.columns])
    lead_in = F.transform(rests(F.col("before_"), F.col("time")), lambda t: rest(t, 0))
    pieces = F.concat(lead_in, F.array(own))
    if end_time:
        pieces = F.concat(pieces, F.when(F.col("last_") == 1, F.transform(rests(F.col("time"), F.lit(end_time)), lambda t: rest(t, 2))).otherwise(F.transform(F.array().cast("array<int>"), lambda t: rest(t, 2))))
    else:
        latest = F.max("time").over(Window.partitionBy("seq_id"))
        ranked = ranked.withColumn("end_", latest)
        pieces = F.concat(pieces, F.when(F.col("last_") == 1, F.transform(rests(F.col("time"), F.col("end_")), lambda t: rest(t, 2))).otherwise(F.transform(F.array().cast("array<int>"), lambda t: rest(t, 2))))
    out = ranked.select("seq_id", F.col("ev_idx").alias("old_"), F.explode(pieces).alias("p"))
    new = Window.partitionBy("seq_id").orderBy("old_", "p.side", "p.time")
    return out.select("seq_id", (F.row_number().over(new) - 1).alias("ev_idx"), *[F.col(f"p.{c}") for c in _FIELDS if c in events.columns])


def unpad(events: DataFrame) -> DataFrame:
    """Drop rests. (A leading special token never enters the event table.)"""
    return events.where(F.col("note") != V.REST)


def anticipate(events: DataFrame, controls: DataFrame, delta: int = V.DELTA) -> tuple[DataFrame, DataFrame]:
    """(interleaved events and controls, controls left over).

    Before each event come all queued controls whose time is at most ``delta`` after the previous event (time 0 before
    the first). A control waits for those queued before it, so its place is the running maximum over the queue; one that
    only the last event would release is left over. Sequences without controls pass through.
    """
    order = _ordered()
    fields = [c for c in _FIELDS if c in events.columns]
    steps = events.select("seq_id", F.col("ev_idx").alias("place"), F.lag("time", 1, 0).over(order).alias("clock"))
    # Events may be out of time order: what counts is the first event whose running clock has come far enough.
    steps = steps.withColumn("reach", F.max("clock").over(Window.partitionBy("seq_id").orderBy("place")))
    due = controls.select("seq_id", "ev_idx", *fields, (F.col("time") - V.ANTICIPATED - delta).alias("due"))
    marks = steps.select("seq_id", F.col("reach").alias("at"), F.lit(1).alias("kind"), "place", F.lit(None).cast("int").alias("ev_idx"))
    marks = marks.unionByName(due.select("seq_id", F.col("due").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("place"), "ev_idx"))
    # As-of join by one sort: the least event place at or after a control's due time.
    later = Window.partitionBy("seq_id").orderBy(F.col("at").desc(), F.col("kind").desc(), F.col("place").desc(), "ev_idx").rowsBetween(Window.unboundedPreceding, 0)
    first = marks.withColumn("hit", F.min("place").over(later)).where("kind = 0").select("seq_id", "ev_idx", F.coalesce("hit", F.lit((1 << 31) - 1)).alias("hit"))
    queue = Window.partitionBy("seq_id").orderBy("ev_idx").rowsBetween(Window.unboundedPreceding, 0)
    placed = due.join(first, ["seq_id", "ev_idx"]).withColumn("place", F.max("hit").over(queue))
    used = placed.where(F.col("place") < (1 << 31) - 1).select("seq_id", "place", F.lit(0).alias("kind"), "ev_idx", *fields)
    merged = used.unionByName(events.select("seq_id", F.col("ev_idx").alias("place"), F.lit(1).alias("kind"), "ev_idx", *fields))
    final = Window.partitionBy("seq_id").orderBy("place", "kind", "ev_idx")
    out = merged.select("seq_id", (F.row_number().over(final) - 1).alias("ev_idx"), *fields)
    return out, placed.where(F.col("place") == (1 << 31) - 1).select("seq_id", "ev_idx", *fields)


def sparsity(events: DataFrame) -> DataFrame:
    """(seq_id, sparsity): longest gap between onsets, from time 0, separators left out."""
    gaps = events.where(F.col("note") != V.SEP).select("seq_id", (F.col("time") - F.lag("time", 1, 0).over(_ordered())).alias("gap"))
    found = gaps.groupBy("seq_id").agg(F.max("gap").alias("gap"))
    return events.select("seq_id").distinct().join(found, "seq_id", "left").select("seq_id", F.greatest(F.coalesce("gap", F.lit(0)), F.lit(0)).alias("sparsity"))


def _separators_so_far() -> Column:
    return F.sum(F.when(F.col("note") == V.SEP, 1).otherwise(0)).over(_ordered().rowsBetween(Window.unboundedPreceding, 0))


def min_time(events: DataFrame, seconds: bool = True, instr: int | None = None) -> DataFrame:
    """(seq_id, min_time): first onset before the first separator, of one instrument if given; 0 if there is none."""
    mine = (_separators_so_far() == 0) & (F.lit(True) if instr is None else instrument() == instr)
    value = F.coalesce(F.min(F.when(F.col("ok"), F.col("t"))), F.lit(0))
    rows = events.select("seq_id", mine.alias("ok"), real_time().alias("t"))
    return rows.groupBy("seq_id").agg((value / F.lit(float(V.TICKS)) if seconds else value).alias("min_time"))


def max_time(events: DataFrame, seconds: bool = True, instr: int | None = None) -> DataFrame:
    """(seq_id, max_time): last onset, also beyond separators, of one instrument if given; at least 0."""
    mine = (F.col("note") != V.SEP) & (F.lit(True) if instr is None else instrument() == instr)
    value = F.greatest(F.coalesce(F.max(F.when(mine, real_time())), F.lit(0)), F.lit(0))
    return events.groupBy("seq_id").agg((value / F.lit(float(V.TICKS)) if seconds else value).alias("max_time"))


def instruments(events: DataFrame) -> DataFrame:
    """(seq_id, instr, n): events of each instrument; a rest counts as instrument 129, separators as none."""
    return events.where(F.col("note") < V.SEP).groupBy("seq_id", instrument().alias("instr")).agg(F.count("*").alias("n"))


def instrument_map(events: DataFrame) -> DataFrame:
    """(seq_id, instruments): the counts as a map."""
    return instruments(events).groupBy("seq_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("instr", "n")))).alias("instruments"))


def translate(events: DataFrame, dt: float, seconds: bool = False) -> DataFrame:
    """Shift times until the first separator; a time that would be negative fails the query, also after it."""
    by = _ticks(dt, seconds)
    shift = F.when(_separators_so_far() == 0, by).otherwise(0)
    moved = F.when((F.col("note") != V.SEP) & (F.col("real_") + F.col("shift_") < 0), F.raise_error(F.lit("translated before time 0")).cast("int")).otherwise(F.col("time") + F.when(F.col("note") == V.SEP, 0).otherwise(F.col("shift_")))
    return events.withColumns({"shift_": shift, "real_": real_time()}).withColumn("time", moved.cast("int")).drop("shift_", "real_")


def combine(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Turn controls into events, append them, and sort by time."""
    fields = [c for c in _FIELDS if c in events.columns]
    plain = [F.when(F.col(c) >= V.ANTICIPATED_VELOCITY, F.col(c) - V.MAX_VELOCITY).otherwise(F.col(c) - V.ANTICIPATED).cast("int").alias(c) for c in fields]
    both = events.select("seq_id", F.lit(0).alias("src"), "ev_idx", *fields).unionByName(controls.select("seq_id", F.lit(1).alias("src"), "ev_idx", *plain))
    order = Window.partitionBy("seq_id").orderBy("time", "src", "ev_idx")
    return both.select("seq_id", (F.row_number().over(order) - 1).alias("ev_idx"), *fields)
