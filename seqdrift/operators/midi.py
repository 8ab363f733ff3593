"""MIDI messages to tokens and back.

Messages: (seq_id, msg_idx, delta double seconds, type, channel, note, velocity, program). Compound notes: (seq_id,
note_idx, onset, dur, pitch, instr, velocity) with times in ticks and dur -1 for a note that never ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.operators.events import unpad


def to_compound(messages: DataFrame) -> DataFrame:
    """Pair note-ons with note-offs, first in, first out, for each (instrument, note, channel).

    Pairing needs no state machine: with a running balance of opened minus closed notes, an off is a bad one exactly when
    it takes the balance to a new minimum below 0. The n-th on then meets the n-th good off.
    """
    order = Window.partitionBy("seq_id").orderBy("msg_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("delta") < 0, F.raise_error(F.lit("negative delta")).cast("double")).otherwise(F.col("delta"))
    timed = messages.withColumn("delta", delta).withColumn("at", F.sum("delta").over(so_far))
    program = F.last(F.when(F.col("type") == "program_change", F.col("program")), ignorenulls=True)
    timed = timed.withColumn("program_", F.coalesce(program.over(Window.partitionBy("seq_id", "channel").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    notes = timed.where(F.col("type").isin("note_on", "note_off"))
    notes = notes.withColumns({"instr": F.when(F.col("channel") == V.DRUM_CHANNEL, V.DRUMS).otherwise(F.col("program_")), "on": (F.col("type") == "note_on") & (F.col("velocity") > 0)})

    key = ["seq_id", "instr", "note", "channel"]
    pair = Window.partitionBy(*key).orderBy("msg_idx")
    balance = F.sum(F.when(F.col("on"), 1).otherwise(-1)).over(pair.rowsBetween(Window.unboundedPreceding, 0))
    notes = notes.withColumn("balance", balance)
    lowest = F.least(F.lit(0), F.coalesce(F.min("balance").over(pair.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    notes = notes.withColumn("good", F.col("on") | (F.col("balance") >= lowest)).where("good")
    numbered = notes.withColumn("n", F.row_number().over(Window.partitionBy(*key, "on").orderBy("msg_idx")))
    # Both lie in one partition of a window, so nothing is paired twice and joined. Nulls are equal there and meet nothing.
    off_at = F.max(F.when(~F.col("on"), F.col("at"))).over(Window.partitionBy(*key, "n"))
    known = F.col("seq_id").isNotNull() & F.col("note").isNotNull() & F.col("channel").isNotNull()
    ons = numbered.withColumn("off_at", F.when(known, off_at)).where("on")
    return ons.select(
        "seq_id",
        (F.row_number().over(order) - 1).alias("note_idx"),
        F.rint(F.col("at") * V.TICKS).cast("int").alias("onset"),
        F.coalesce(F.rint((F.col("off_at") - F.col("at")) * V.TICKS), F.lit(-1)).cast("int").alias("dur"),
        F.col("note").alias("pitch"),
        F.col("instr").cast("int").alias("instr"),
        "velocity",
    )


def to_messages(compound: DataFrame) -> DataFrame:
    """(seq_id, instr, channel, msg_idx, delta ticks, type, pitch, velocity): one track per instrument.

    At one tick onsets come before offsets. Channels are dealt in order of an instrument's first note, leaving out the
    drum channel, which drums get.
    """
    notes = compound.where("seq_id is not null and instr is not null").repartition("seq_id")  # for all windows here
    notes = notes.withColumn("first_", F.min("note_idx").over(Window.partitionBy("seq_id", "instr")))
    rank = F.dense_rank().over(Window.partitionBy("seq_id", F.col("instr") == V.DRUMS).orderBy("first_", "instr")) - 1
    # Never null here, but nullable, as the channel of any message is.
    channel = F.when(F.col("instr") == V.DRUMS, V.DRUM_CHANNEL).when(rank >= V.DRUM_CHANNEL, rank + 1).when(rank < V.DRUM_CHANNEL, rank)
    length = F.when(F.col("dur") < 0, V.UNKNOWN_DURATION).otherwise(F.col("dur"))
    ends = F.array(F.struct(F.col("onset").alias("tick"), F.lit(0).alias("side")), F.struct((F.col("onset") + length).alias("tick"), F.lit(1).alias("side")))
    rows = notes.withColumn("channel", channel).select("seq_id", "instr", "channel", "note_idx", "pitch", "velocity", F.explode(ends).alias("m"))
    track = Window.partitionBy("seq_id", "instr").orderBy("m.tick", "m.side", "note_idx")
    return rows.select(
        "seq_id",
        "instr",
        "channel",
        (F.row_number().over(track) - 1).alias("msg_idx"),
        (F.col("m.tick") - F.lag("m.tick", 1, 0).over(track)).alias("delta"),
        F.when(F.col("m.side") == 0, "note_on").otherwise("note_off").alias("type"),
        "pitch",
        F.when(F.col("m.side") == 0, F.col("velocity")).otherwise(0).alias("velocity"),
    )


def compound_to_events(compound: DataFrame, velocity: bool = False) -> DataFrame:
    """Event table, with ``truncated`` on each row: whether its duration was cut. Unknown durations become 250 ms."""

    def within(name: str, low: int, high: int):
        return F.when(~F.col(name).between(low, high), F.raise_error(F.lit(f"{name} out of range")).cast("int")).otherwise(F.col(name))

    length = F.when(F.col("dur") == -1, V.UNKNOWN_DURATION).otherwise(F.least(F.col("dur"), F.lit(V.MAX_DURATION - 1)))
    columns = [
        F.col("seq_id"),
        F.col("note_idx").alias("ev_idx"),
        (within("onset", 0, (1 << 31) - 1) + V.TIME).cast("int").alias("time"),
        (length + V.DURATION).cast("int").alias("dur"),
        (within("instr", 0, V.MAX_INSTRUMENT - 1) * V.MAX_PITCH + within("pitch", 0, V.MAX_PITCH - 1) + V.NOTE).cast("int").alias("note"),
    ]
    if velocity:
        columns.append((F.col("velocity") + V.VELOCITY).cast("int").alias("vel"))
    return compound.select(*columns, (F.col("dur") >= V.MAX_DURATION).alias("truncated"))


def truncations(compound: DataFrame) -> DataFrame:
    return compound.groupBy("seq_id").agg(F.count_if(F.col("dur") >= V.MAX_DURATION).alias("truncations"))


def events_to_compound(events: DataFrame) -> DataFrame:
    """Notes of all segments on one clock: after a separator, times go on from the latest end of the segment before."""
    has_velocity = "vel" in events.columns
    order = Window.partitionBy("seq_id").orderBy("ev_idx")
    base = unpad(events)
    segment = F.sum(F.when(F.col("note") == V.SEP, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    shift = F.when(F.col("note") >= V.ANTICIPATED, V.ANTICIPATED).otherwise(0)
    rows = base.withColumns({"segment": segment, "is_sep": F.col("note") == V.SEP, "t": F.col("time") - shift, "d": F.col("dur") - shift - V.DURATION, "v": F.col("note") - shift - V.NOTE}).where("not is_sep")
    ends = rows.groupBy("seq_id", "segment").agg(F.max(F.col("t") + F.col("d")).alias("end"))
    past = Window.partitionBy("seq_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select("seq_id", "segment", F.coalesce(F.sum(F.greatest("end", F.lit(0))).over(past), F.lit(0)).alias("offset"))
    if has_velocity:
        zeroed = F.when(F.col("vel") >= V.VELOCITY, F.col("vel") - V.VELOCITY).otherwise(F.col("vel"))
        velocity = F.least(F.greatest(F.when(zeroed >= V.ANTICIPATED, zeroed - V.ANTICIPATED).otherwise(zeroed), F.lit(0)), F.lit(V.MAX_VELOCITY - 1))
    else:
        velocity = F.lit(V.DEFAULT_VELOCITY)
    return rows.join(offsets, ["seq_id", "segment"]).select(
        "seq_id",
        (F.row_number().over(order) - 1).alias("note_idx"),
        (F.col("t") + F.col("offset")).cast("int").alias("onset"),
        F.when(F.col("d") >= V.MAX_DURATION, F.raise_error(F.lit("duration out of range")).cast("int")).otherwise(F.col("d")).cast("int").alias("dur"),
        F.pmod("v", F.lit(V.MAX_PITCH)).cast("int").alias("pitch"),
        F.floor(F.col("v") / V.MAX_PITCH).cast("int").alias("instr"),
        velocity.cast("int").alias("velocity"),
    )


def midi_to_events(messages: DataFrame, velocity: bool = False) -> DataFrame:
    return compound_to_events(to_compound(messages), velocity)


def events_to_midi(events: DataFrame) -> DataFrame:
    return to_messages(events_to_compound(events))


def rebase(events: DataFrame) -> DataFrame:
    """Move each sequence so that its first event starts at 0."""
    first = F.first("time").over(Window.partitionBy("seq_id").orderBy("ev_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return events.withColumn("time", F.col("time") - first)


def buffer_to_messages(buffer: DataFrame, tick_compat: bool = False) -> DataFrame:
    """Buffered live messages (seq_id, ts, type, note, velocity, channel) as timed messages; the first delta is 0.

    ``tick_compat`` divides deltas by 960, as when seconds are stored as ticks of a 480-per-beat file.
    """
    order = Window.partitionBy("seq_id").orderBy("ts", "type", "note")
    delta = F.coalesce(F.col("ts") - F.lag("ts").over(order), F.lit(0.0))
    return buffer.select("seq_id", (F.row_number().over(order) - 1).alias("msg_idx"), (delta / 960 if tick_compat else delta).alias("delta"), "type", "channel", "note", "velocity", F.lit(None).cast("int").alias("program"))
