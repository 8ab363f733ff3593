"""Token vocabulary and table schemas."""

from __future__ import annotations
# They define the token vocabulary.
TIME, DURATION, NOTE = 0, 10_000, 11_000
REST = 27_512
ANTICIPATED = 27_513
ANTICIPATED_TIME, ANTICIPATED_DURATION, ANTICIPATED_NOTE = 27_513, 37_513, 38_513
SEP, AR, AAR = 55_025, 55_026, 55_027
VELOCITY, ANTICIPATED_VELOCITY = 55_028, 55_156
TICKS = 100
MAX_TICK, MAX_DURATION, MAX_PITCH, MAX_INSTRUMENT, MAX_VELOCITY = 10_000, 1_000, 128, 129, 128
DEFAULT_VELOCITY, DRUM_CHANNEL, DRUMS, PEDAL = 72, 9, 128, 48
UNKNOWN_DURATION = 25
PITCH_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
WINDOW_EVENTS, WINDOW_STRIDE, MAX_SILENCE, DELTA = 40, 2, 500, 500


def stride(velocity: bool) -> int:
    return 4 if velocity else 3


def vocabulary_size(velocity: bool) -> int:
    return VELOCITY + 2 * MAX_VELOCITY if velocity else VELOCITY


# Table schemas, as DDL.
SEQUENCES = "seq_id bigint, tokens array<int>"
EVENTS = "seq_id bigint, ev_idx int, time int, dur int, note int, vel int"
COMPOUND = "seq_id bigint, note_idx int, onset int, dur int, pitch int, instr int, velocity int"
MESSAGES = "timestamp double, type string, note int, velocity int, channel int"
RECORDING = "messages array<struct<timestamp: double, type: string, note: int, velocity: int, channel: int>>"
EMBEDDINGS = "sample_id bigint, emb array<double>"
SCORES = "sample_id bigint, score double"
