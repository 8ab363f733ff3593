"""Token-array functions: Column in, Column out, no UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqdrift import vocab as V


def _between(x: Column, low: int, high: int) -> Column:
    return (x >= low) & (x < high)


def event_tuples(tokens: Column, velocity: bool = False, skip: int = 1) -> Column:
    """Array of event tuples after ``skip`` leading tokens; a last partial tuple is kept."""
    k = V.stride(velocity)
    n = F.ceil((F.size(tokens) - skip) / k)
    # sequence() would count down from 0 for n < 1
    indices = F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n.cast("int") - 1))
    return F.transform(indices, lambda i: F.slice(tokens, i * k + 1 + skip, F.lit(k)))


def parse_tokens(text: Column) -> Column:
    """Space-separated integers to an int array."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("int"))


def set_instrument(tokens: Column, instrument: int) -> Column:
    """Give every note token the instrument; rests, separators and other tokens stay."""

    def one(t: Column) -> Column:
        moved = F.when(_between(t, V.NOTE, V.REST), F.pmod(t - V.NOTE, F.lit(V.MAX_PITCH)) + instrument * V.MAX_PITCH + V.NOTE)
        return moved.when(_between(t, V.ANTICIPATED_NOTE, V.SEP), F.pmod(t - V.ANTICIPATED_NOTE, F.lit(V.MAX_PITCH)) + instrument * V.MAX_PITCH + V.ANTICIPATED_NOTE).otherwise(t).cast("int")

    return F.transform(tokens, one)


def _is_anticipated(first: Column) -> Column:
    return _between(first, V.ANTICIPATED, V.SEP) | _between(first, V.ANTICIPATED_VELOCITY, V.ANTICIPATED_VELOCITY + V.MAX_VELOCITY)


def filter_instrument(tokens: Column, instrument: int, velocity: bool = False) -> Column:
    """Keep the leading token, separator events, and the events of one instrument."""

    def mine(e: Column) -> Column:
        offset = F.when(_is_anticipated(e[0]), V.ANTICIPATED_NOTE).otherwise(V.NOTE)
        return F.array_contains(e, V.SEP) | (F.floor((e[2] - offset) / V.MAX_PITCH) == instrument)

    return F.concat(F.slice(tokens, 1, 1), F.flatten(F.filter(event_tuples(tokens, velocity), mine)))


def set_anticipated(tokens: Column, anticipated: bool, velocity: bool = False) -> Column:
    """Move every event token into or out of the anticipated ranges.

    Out of the anticipated velocity range only when the vocabulary has one.
    """

    def add(t: Column) -> Column:
        return F.when(_between(t, 0, V.REST), t + V.ANTICIPATED).when(_between(t, V.VELOCITY, V.ANTICIPATED_VELOCITY), t + V.MAX_VELOCITY).otherwise(t)

    def remove(t: Column) -> Column:
        return F.when(_between(t, V.ANTICIPATED, 2 * V.ANTICIPATED - 1), t - V.ANTICIPATED).when(_between(t, V.ANTICIPATED_VELOCITY, V.vocabulary_size(velocity)), t - V.MAX_VELOCITY).otherwise(t)

    return F.transform(tokens, add if anticipated else remove)


def pitch_name(pitch: Column) -> Column:
    names = F.array(*[F.lit(n) for n in V.PITCH_NAMES])
    return F.concat(F.element_at(names, (F.pmod(pitch, F.lit(12)) + 1).cast("int")), (F.floor(pitch / 12) - 1).cast("string"))


def readable_event(e: Column, velocity: bool = False) -> Column:
    """One event tuple as a struct; tokens that a partial tuple lacks are null."""
    first = e[0]
    anticipated = _between(first, V.ANTICIPATED, V.ANTICIPATED_DURATION) | _between(first, V.ANTICIPATED_VELOCITY, V.ANTICIPATED_VELOCITY + 2 * V.MAX_VELOCITY)
    shift = F.when(anticipated, V.ANTICIPATED).otherwise(0)
    note = F.get(e, F.lit(2))
    value = note - shift - V.NOTE
    is_sep, is_rest = F.array_contains(e, V.SEP), F.coalesce(note == V.REST, F.lit(False))
    known = ~is_sep
    sounding = known & ~is_rest
    vel = F.get(e, F.lit(3)) - F.when(anticipated, V.ANTICIPATED_VELOCITY).otherwise(V.VELOCITY) if velocity else F.lit(None)
    checked = F.when(sounding & (F.floor(value / V.MAX_PITCH) < 0), F.raise_error(F.lit("negative instrument"))).otherwise(F.floor(value / V.MAX_PITCH))
    return F.struct(
        F.when(is_sep, "SEP").when(is_rest, "REST").alias("special_token"),
        F.when(known, (first - shift) / F.lit(100.0)).alias("onset"),
        F.when(known, (F.get(e, F.lit(1)) - shift - V.DURATION) / F.lit(100.0)).alias("duration"),
        F.when(sounding, checked).cast("int").alias("instrument"),
        F.when(sounding, pitch_name(F.pmod(value, F.lit(V.MAX_PITCH)))).alias("pitch"),
        F.when(known, vel).cast("int").alias("velocity"),
        F.when(known, anticipated).alias("anticipated"),
    )


def readable_events(tokens: Column, velocity: bool = False) -> Column:
    """Array of event structs. A leading AR or AAR makes a first row; any other leading token makes none."""
    events = F.transform(event_tuples(tokens, velocity), lambda e: readable_event(e, velocity))
    name = F.when(tokens[0] == V.AR, "AR").when(tokens[0] == V.AAR, "AAR")
    nothing = F.lit(None)
    head = F.struct(name.alias("special_token"), nothing.cast("double").alias("onset"), nothing.cast("double").alias("duration"), nothing.cast("int").alias("instrument"), nothing.cast("string").alias("pitch"), nothing.cast("int").alias("velocity"), nothing.cast("boolean").alias("anticipated"))
    return F.when(name.isNotNull(), F.concat(F.array(head), events)).otherwise(events)


def invalid_reason(tokens: Column, velocity: bool = False) -> Column:
    """Why a sequence is invalid, or null. Filter on it (lenient) or wrap it in ``require_valid`` (strict)."""
    size = V.vocabulary_size(velocity)
    k = V.stride(velocity)

    def bad(e: Column, at: int, low: int, high: int) -> Column:
        first = e[0]
        shift = F.when(_between(first, V.ANTICIPATED, V.ANTICIPATED_DURATION), V.ANTICIPATED).otherwise(0)
        offset = {0: V.TIME, 1: V.DURATION, 3: V.VELOCITY}[at]
        value = F.get(e, F.lit(at)) - shift - offset
        special = F.array_contains(e, V.SEP) | F.coalesce(F.get(e, F.lit(2)) == V.REST, F.lit(False))
        return ~special & ((value < low) | (value > high))

    events = event_tuples(tokens, velocity)
    reason = (
        F.when(tokens.isNull() | F.exists(tokens, lambda t: t.isNull()), "not integers")
        .when(F.exists(tokens, lambda t: t < 0), "negative token")
        .when(F.exists(tokens, lambda t: t >= size), "token beyond the vocabulary")
        .when(F.exists(events, lambda e: F.coalesce(bad(e, 0, 0, 10_000), F.lit(False))), "onset out of range")
        .when(F.exists(events, lambda e: F.coalesce(bad(e, 1, 0, 1_000), F.lit(False))), "duration out of range")
    )
    if k == 4:
        reason = reason.when(F.exists(events, lambda e: F.coalesce(bad(e, 3, 0, 127), F.lit(False))), "velocity out of range")
    return reason


def require_valid(tokens: Column, velocity: bool = False) -> Column:
    """The tokens, or a failed query that names the reason."""
    reason = invalid_reason(tokens, velocity)
    return F.when(reason.isNull(), tokens).otherwise(F.raise_error(F.concat(F.lit("invalid tokens: "), reason)).cast("array<int>"))


def strip_velocity(tokens: Column) -> Column:
    """Drop every fourth token after the leading one if the sequence has velocity tokens."""
    has = F.exists(tokens, lambda t: _between(t, V.VELOCITY, V.ANTICIPATED_VELOCITY))
    return F.when(has, F.filter(tokens, lambda t, i: (i % 4 != 0) | (i == 0))).otherwise(tokens)


def force_ar(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(V.AR)), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))))


def pad_right(tokens: Column, length: Column) -> Column:
    """Zeros up to a length (token 0 is also a legal time: carry the true length along)."""
    return F.concat(tokens, F.array_repeat(F.lit(0), F.greatest(length - F.size(tokens), F.lit(0)).cast("int")))


def rendered(tokens: Column, velocity: bool = False) -> Column:
    """Debug rows of a sequence without a leading token: (time, duration, instrument, pitch, velocity, anticipated)."""

    def row(e: Column, j: Column) -> Column:
        anticipated = e[2] >= V.ANTICIPATED
        shift = F.when(anticipated, V.ANTICIPATED).otherwise(0)
        value = e[2] - shift - V.NOTE
        vel = e[3] - F.when(anticipated, V.ANTICIPATED_VELOCITY).otherwise(V.VELOCITY) if velocity else F.lit(None).cast("int")
        return F.struct(j.alias("j"), (e[0] - shift).alias("time"), (e[1] - shift - V.DURATION).alias("dur"), F.floor(value / V.MAX_PITCH).cast("int").alias("instr"), F.pmod(value, F.lit(V.MAX_PITCH)).alias("pitch"), vel.alias("velocity"), anticipated.alias("anticipated"))

    return F.transform(event_tuples(tokens, velocity, skip=0), row)


# Logit masks and truncation for sampling: arrays of doubles indexed by token.

_MINUS_INF = float("-inf")


def _mask(logits: Column, keep: Callable[[Column], Column]) -> Column:
    return F.transform(logits, lambda x, i: F.when(keep(i), x).otherwise(F.lit(_MINUS_INF)))


def safe_logits(logits: Column, slot: int, now: int, velocity: bool = False, max_gap: int = 200) -> Column:
    """Leave only the tokens that may stand at a tuple's ``slot``: a time from just before ``now`` to ``max_gap`` later, a
    duration, a note (no rest), or a velocity."""
    ranges = {0: (max(now - 1, 0), min(now + max_gap, V.DURATION)), 1: (V.DURATION, V.NOTE), 2: (V.NOTE, V.REST), 3: (V.VELOCITY, V.ANTICIPATED_VELOCITY)}
    low, high = ranges[slot % V.stride(velocity)]
    return _mask(logits, lambda i: _between(i, low, high))


def future_logits(logits: Column, now: int) -> Column:
    """Forbid times before ``now``."""
    return _mask(logits, lambda i: (i < V.TIME) | (i >= V.TIME + now))


def instrument_logits(logits: Column, instrument: int = 0) -> Column:
    """Forbid notes of other instruments."""
    low = V.NOTE + instrument * V.MAX_PITCH
    return _mask(logits, lambda i: ~_between(i, V.NOTE, V.REST) | _between(i, low, low + V.MAX_PITCH))


def nucleus(logits: Column, top_p: float) -> Column:
    """Keep the shortest list of most likely tokens whose probabilities sum over ``top_p``; 1 or more keeps all."""
    if top_p >= 1:
        return logits
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    ranked = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("key"), i.alias("i"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, r: Column) -> Column:
        return F.struct((s["sum"] + F.exp(-r["key"] - top) / total).alias("sum"), F.when(s["sum"] <= top_p, F.concat(s["kept"], F.array(r["i"]))).otherwise(s["kept"]).alias("kept"))

    return F.transform(F.array(F.aggregate(ranked, start, step, lambda s: s["kept"])), lambda kept: F.transform(logits, lambda x, i: F.when(F.array_contains(kept, i), x).otherwise(F.lit(_MINUS_INF))))[0]
