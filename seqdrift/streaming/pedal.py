"""Pedal-gated message sessions: a batch form in windows, and the same rows from a stateful stream.

Messages: (device, ts double, type, note, velocity, channel). Every message on the pedal's note toggles it; while it is
down, each other message yields a row with the session's last messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqdrift import vocab as V

BUFFER = 40
ROWS = "device long, ts double, session int, n_buffer int, buffer array<struct<ts: double, type: string, note: int, velocity: int, channel: int>>"
_STATE = "pedals int, last_ts double, late int, ts array<double>, type array<string>, note array<int>, velocity array<int>, channel array<int>"
_FIELDS = ("ts", "type", "note", "velocity", "channel")


def normalised_type() -> Column:
    """A note_on with velocity 0 is a note_off."""
    return F.when((F.col("type") == "note_on") & (F.col("velocity") == 0), "note_off").otherwise(F.col("type"))


def sessions(messages: DataFrame, pedal: int = V.PEDAL, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Add ``session`` (pedal messages so far) and ``active`` (odd session and not a pedal message)."""
    so_far = Window.partitionBy("device").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = messages.withColumn("session", F.sum(F.when(F.col("note") == pedal, 1).otherwise(0)).over(so_far).cast("int"))
    return counted.withColumn("active", (F.col("session") % 2 == 1) & (F.col("note") != pedal))


def buffers(messages: DataFrame, pedal: int = V.PEDAL, size: int = BUFFER, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One row per message while the pedal is down, with the last ``size`` messages of its session."""
    live = sessions(messages, pedal, order).where("active").withColumn("type", normalised_type())
    last = Window.partitionBy("device", "session").orderBy(*order).rowsBetween(-(size - 1), 0)
    found = live.withColumn("buffer", F.collect_list(F.struct(*_FIELDS)).over(last))
    return found.select("device", "ts", "session", F.size("buffer").alias("n_buffer"), "buffer")


def stream_buffers(messages: DataFrame, pedal: int = V.PEDAL, size: int = BUFFER) -> DataFrame:
    """The same rows from a stream. State is a pedal count and at most ``size`` messages a device.

    Messages are put in order inside a micro-batch; one older than a message already handled is dropped and counted.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pedals, last, late, *columns = state.get if state.exists else (0, float("-inf"), 0, [], [], [], [], [])
        held = [list(c) for c in columns]
        rows = pd.concat(list(frames), ignore_index=True).sort_values("ts", kind="stable")
        out = []
        for m in rows.itertuples(index=False):
            if m.ts < last:
                late += 1
                continue
            last = m.ts
            if m.note == pedal:
                pedals += 1
                held = [[] for _ in _FIELDS]
                continue
            if pedals % 2 == 0:
                continue
            kind = "note_off" if m.type == "note_on" and m.velocity == 0 else m.type
            for column, value in zip(held, (float(m.ts), kind, int(m.note), int(m.velocity), int(m.channel)), strict=True):
                column.append(value)
                del column[:-size]
            buffer = [dict(zip(_FIELDS, values, strict=True)) for values in zip(*held, strict=True)]
            out.append((key[0], m.ts, pedals, len(buffer), buffer))
        state.update((pedals, last, late, *held))
        yield pd.DataFrame(out, columns=["device", "ts", "session", "n_buffer", "buffer"])

    chosen = messages.select("device", *_FIELDS)
    return chosen.groupBy("device").applyInPandasWithState(step, ROWS, _STATE, "append", GroupStateTimeout.NoTimeout)


def buffer_messages(rows: DataFrame) -> DataFrame:
    """Explode buffers to messages with a seq_id for each output row; deltas are real seconds."""
    numbered = rows.withColumn("seq_id", F.xxhash64("device", "ts", "session", "n_buffer"))
    flat = numbered.select("seq_id", F.posexplode("buffer").alias("msg_idx", "m"))
    before = F.lag("m.ts").over(Window.partitionBy("seq_id").orderBy("msg_idx"))
    return flat.select("seq_id", "msg_idx", F.coalesce(F.col("m.ts") - before, F.lit(0.0)).alias("delta"), "m.type", "m.channel", "m.note", "m.velocity", F.lit(None).cast("int").alias("program"))


def score_rows(rows: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Tokens of every buffer, a leading AR, and whatever ``score`` adds to (seq_id, tokens)."""
    from seqdrift.operators.events import to_sequences
    from seqdrift.operators.midi import midi_to_events

    return score(to_sequences(midi_to_events(buffer_messages(rows)), lead=V.AR))


def record(messages: DataFrame, path: str, checkpoint: str):
    """Append a message stream to JSON files; returns the running query."""
    return messages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def playback(spark, path: str, schema) -> DataFrame:
    """Recorded messages as a stream, in the files' order, without pacing."""
    return spark.readStream.schema(schema).json(path)
