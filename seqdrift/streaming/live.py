"""Scores inside the stream: each message's buffer is tokenised and scored where its state lies.

Output rows (``LIVE``): kind ``score`` for a message while the pedal is down whose buffer has a note, with the buffer's
tokens and their score; kind ``late`` for a message older than one its device has already handled, which changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seqdrift import vocab as V
from seqdrift.operators.pooling import HiddenStates
from seqdrift.streaming.pedal import BUFFER

MESSAGE = "ts double, type string, note int, velocity int, channel int"
LIVE = "device long, ts double, kind string, session int, n_buffer int, tokens array<int>, score double"
_FIELDS = ("ts", "type", "note", "velocity", "channel")
_Scored = Row("device", "ts", "kind", "session", "n_buffer", "tokens", "score")
#: A score of each token list.
TokenScore = Callable[[list[list[int]]], list[float]]


def buffer_tokens(messages: list[tuple]) -> list[int]:
    """A leading AR and three tokens a note, in the order of note-ons, for (ts, type, note, velocity, channel) messages.

    Times are sums of the gaps, as in the batch form, so both round to the same ticks. An off ends the oldest open note
    of its pitch and channel; one without such a note is ignored; a note without an end lasts 250 ms.
    """
    notes, waiting, at, last = [], {}, 0.0, None
    for ts, kind, note, velocity, channel in messages:
        at += 0.0 if last is None else ts - last
        last = ts
        instrument = V.DRUMS if channel == V.DRUM_CHANNEL else 0
        key = (instrument, note, channel)
        if kind == "note_on" and velocity > 0:
            waiting.setdefault(key, []).append(len(notes))
            notes.append([at, None, V.MAX_PITCH * instrument + note])
        elif kind in ("note_on", "note_off") and waiting.get(key):
            notes[waiting[key].pop(0)][1] = at
    tokens = [V.AR]
    for start, end, note in notes:
        length = V.UNKNOWN_DURATION if end is None else round((end - start) * V.TICKS)
        tokens += [V.TIME + round(start * V.TICKS), V.DURATION + min(length, V.MAX_DURATION - 1), V.NOTE + note]
    return tokens


class _Session(StatefulProcessor):
    """A device's pedal count and last message, in a value state, and its session's last messages, in a list state.

    It works on rows, as a device's few messages cost less than the pandas frames they would come and go in, and asks for
    the list only if there is a count, as each call goes to the state store's process.
    """

    def __init__(self, score: TokenScore, pedal: int, size: int, idle_ms: int | None) -> None:
        self.score, self.pedal, self.size, self.idle_ms = score, pedal, size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "pedals int, last_ts double")
        self.held = handle.getListState("held", MESSAGE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place = self.place.get()
        pedals, last = place or (0, float("-inf"))
        held = stored = [tuple(m) for m in self.held.get()] if place else []
        messages = [(float("nan") if ts is None else ts, *rest) for ts, *rest in (tuple(r[c] for c in _FIELDS) for r in rows)]
        out: list[tuple] = []
        for message in sorted(messages, key=lambda m: (m[0] != m[0], m[0])):
            ts, kind, note, velocity, channel = message
            if ts < last:
                out.append((ts, "late", None, None, None))
            elif note == self.pedal:
                last, pedals, held = ts, pedals + 1, []
            else:
                last = ts
                if pedals % 2 == 0:
                    continue
                held = [*held, (float(ts), "note_off" if kind == "note_on" and velocity == 0 else kind, int(note), int(velocity), int(channel))][-self.size :]
                tokens = buffer_tokens(held)
                if len(tokens) > 1:
                    out.append((ts, "score", pedals, len(held), tokens))
        self.place.update((pedals, last))
        if held:
            self.held.put(held)
        elif stored:
            self.held.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        known = [i for i, row in enumerate(out) if row[4] is not None]
        scores: list[float | None] = [None] * len(out)
        for i, value in zip(known, self.score([out[i][4] for i in known]) if known else [], strict=True):
            scores[i] = float(value)
        return (_Scored(key[0], *row, score) for row, score in zip(out, scores, strict=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A device that sent nothing for ``idle_ms`` is forgotten: its pedal counts as up."""
        self.place.clear()
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_scores(messages: DataFrame, score: TokenScore, pedal: int = V.PEDAL, size: int = BUFFER, idle_ms: int | None = None) -> DataFrame:
    """Scores of a message stream (device, ts, type, note, velocity, channel), a row a message (``LIVE``).

    Nothing but the state is kept: a count, a time and at most ``size`` messages a device, which ``idle_ms`` of silence
    (processing time) clears. ``score`` is called once for all rows that a device has in a micro-batch. Messages are put
    in order of time inside a micro-batch; later ones that are older come out as ``late``. The session needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    chosen = messages.select("device", *_FIELDS)
    return chosen.groupBy("device").transformWithState(_Session(score, pedal, size, idle_ms), LIVE, "Append", "None" if idle_ms is None else "ProcessingTime")


def late_counts(rows: DataFrame) -> DataFrame:
    """(device, late) of scored rows, as a running count in a stream or a plain one in a batch."""
    from pyspark.sql import functions as F

    return rows.where("kind = 'late'").groupBy("device").agg(F.count("*").alias("late"))


def detector_score(model: HiddenStates, layer: int, parameters: dict) -> TokenScore:
    """The exported detector on tokens: mean and deviation of the layer's states, PCA, scaler, Mahalanobis distance."""
    p = {k: np.array(v, float) for k, v in parameters.items()}
    std = np.where(p["scaler_std"] > 0, p["scaler_std"], 1.0)

    def score(tokens: list[list[int]]) -> list[float]:
        states = model(tokens, [layer])[layer]
        pooled = np.stack([np.concatenate((h.mean(axis=0), h.std(axis=0))) for h in states])
        d = ((pooled - p["pca_mean"]) @ p["pca_components"].T - p["scaler_mean"]) / std - p["mahalanobis_mean"]
        return np.sqrt(np.maximum(((d @ p["mahalanobis_cov_inv"]) * d).sum(axis=1), 0)).tolist()

    return score
