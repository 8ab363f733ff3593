"""Autoregressive event sampling with an injected next-token model: one sequence a row, or many at once."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.operators.extraction import Model, in_worker

#: Token ids so far to logits over the vocabulary.
NextToken = Callable[[list[int]], np.ndarray]
#: Padded ids (sequences, positions) and each row's length to logits over the vocabulary (sequences, tokens). One with an
#: attribute ``of`` is asked for a slot's legal tokens only: ``of(ids, lengths, tokens)``, tokens (sequences, choices), gives
#: the logits of these.
BatchNextToken = Callable[[np.ndarray, np.ndarray], np.ndarray]
HISTORY = 1017


def toy_model(velocity: bool = False) -> NextToken:
    """Deterministic logits from the last tokens; for tests."""
    size = V.vocabulary_size(velocity)

    def logits(tokens: list[int]) -> np.ndarray:
        seed = 1 + sum((i + 1) * t for i, t in enumerate(tokens[-6:]))
        return np.sin(np.arange(size) * 0.37 + seed % 1009)

    return logits


def masked(logits: np.ndarray, slot: int, now: int, velocity: bool = False, instrument: int = 0, max_gap: int = 200) -> np.ndarray:
    """The slot's legal tokens only: times from ``now`` to ``max_gap`` later, durations, one instrument's notes, velocities."""
    low_note = V.NOTE + instrument * V.MAX_PITCH
    ranges = {0: (max(now, 0), min(now + max_gap, V.DURATION)), 1: (V.DURATION, V.NOTE), 2: (low_note, low_note + V.MAX_PITCH), 3: (V.VELOCITY, V.ANTICIPATED_VELOCITY)}
    low, high = ranges[slot % V.stride(velocity)]
    out = np.full(len(logits), -np.inf)
    out[low:high] = logits[low:high]
    return out


def nucleus_choice(logits: np.ndarray, top_p: float, rng: np.random.Generator) -> int:
    order = np.argsort(-logits, kind="stable")
    p = np.exp(logits[order] - logits[order[0]])
    p /= p.sum()
    if top_p < 1:
        keep = np.concatenate(([0.0], np.cumsum(p)[:-1])) <= top_p
        p = np.where(keep, p, 0.0)
        p /= p.sum()
    return int(order[rng.choice(len(p), p=p)])


def _history(tokens: np.ndarray, k: int, fit: bool = False) -> tuple[np.ndarray, int, int]:
    """What a model sees of the tokens so far, moved to start at 0, and the least and greatest time in it.

    ``fit`` leaves out what lies so far back that no token could say the greatest time.
    """
    history = tokens[max(len(tokens) - HISTORY // k * k, 0) :].reshape(-1, k).copy()
    known = history[:, 2] != V.SEP
    times = np.where(history[:, 2] >= V.ANTICIPATED, history[:, 0] - V.ANTICIPATED, history[:, 0])
    now = int(times[known].max(initial=0))
    if fit:
        far = np.flatnonzero(known & (times <= now - V.DURATION))
        history, known, times = (x[far[-1] + 1 if len(far) else 0 :] for x in (history, known, times))
    base = int(times[known].min()) if known.any() else now
    history[:, 0] -= base
    return history.ravel(), base, now


def _queue(controls: list[int], k: int, ahead: int | None) -> list[tuple[int, list[int]]]:
    """Each control with the time from which it may come in: ``ahead`` of its own, or (None) as a plain event at its own."""
    events = [list(controls[i : i + k]) for i in range(0, len(controls), k)]
    if ahead is not None:
        return [(e[0] - V.ANTICIPATED - ahead, e) for e in events]
    shifts = [V.ANTICIPATED if e[2] >= V.ANTICIPATED else 0 for e in events]
    plain = [[t - shift for t in e[:3]] + [t - V.MAX_VELOCITY if t >= V.ANTICIPATED_VELOCITY else t for t in e[3:]] for e, shift in zip(events, shifts, strict=True)]
    return [(e[0], e) for e in plain]


def add_event(model: NextToken, lead: list[int], tokens: list[int], top_p: float, rng: np.random.Generator, velocity: bool = False, fit: bool = False) -> list[int]:
    """The next event tuple after ``tokens``, whose history is cut and moved to start at 0."""
    k = V.stride(velocity)
    history, base, now = _history(np.array(tokens, np.int64), k, fit)
    event: list[int] = []
    for slot in range(k):
        event.append(nucleus_choice(masked(model(lead + history.tolist() + event), slot, now - base, velocity), top_p, rng))
    event[0] += base
    return event


def generate(model: NextToken, prompt: list[int], n_events: int | None, controls: list[int] | None = None, top_p: float = 1.0, delta: int = V.DELTA, seed: int = 0, velocity: bool = False, autoregressive: bool = False) -> list[int]:
    """``n_events`` new events after the prompt, or (None) as many as there are until the last control. Controls are put in up
    to ``delta`` ticks ahead of the music, or, when ``autoregressive``, as plain events in time order, each before the new
    event that reaches it and those that none reaches at the end."""
    k = V.stride(velocity)
    rng = np.random.default_rng([seed, len(prompt)])
    queue = _queue(controls or [], k, None if autoregressive else delta)
    end = max((due for due, _ in queue), default=0)
    tokens = list(prompt)

    def release(now: float) -> None:
        while queue and now >= queue[0][0]:
            tokens.extend(queue.pop(0)[1])

    if autoregressive:
        release(_history(np.array(tokens, np.int64), k)[2])
    for _ in count() if n_events is None else range(n_events):
        if not autoregressive:
            release(tokens[-k] % V.ANTICIPATED if tokens else 0)
        if n_events is None and not queue:
            break
        event = add_event(model, [V.AAR if controls and not autoregressive else V.AR], tokens, top_p, rng, velocity, autoregressive or n_events is None)
        if autoregressive and n_events is None and event[0] >= end:
            break
        if autoregressive:
            release(event[0])
        tokens += event
    if autoregressive:
        release(np.inf)
    return tokens


def generate_column(prompts: DataFrame, model: NextToken, n_events: int, top_p: float = 0.95, velocity: bool | None = None) -> DataFrame:
    """(seq_id, tokens): every prompt continued; ``velocity`` None tells strides apart by length (4 first, then 3)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for seq_id, prompt in zip(frame["seq_id"], frame["tokens"], strict=True):
                tokens = [int(t) for t in prompt]
                with_velocity = (len(tokens) % 4 == 0 and len(tokens) % 3 != 0) if velocity is None else velocity
                out.append((seq_id, generate(model, tokens, n_events, top_p=top_p, seed=int(seq_id), velocity=with_velocity)))
            yield pd.DataFrame(out, columns=["seq_id", "tokens"])

    return prompts.select("seq_id", "tokens").mapInPandas(run, "seq_id long, tokens array<int>")


# Many sequences a model call.


def nucleus_rows(logits: np.ndarray, top_p: float, draws: np.ndarray) -> np.ndarray:
    """``nucleus_choice`` of each row, by a uniform draw a row; -inf is never chosen."""
    at = np.arange(len(logits))
    order = np.argsort(-logits, axis=1, kind="stable")
    p = logits[at[:, None], order]
    p -= p[:, :1].copy()
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    cdf = np.cumsum(p, axis=1)
    kept = 1 + (cdf[:, :-1] <= top_p).sum(axis=1) if top_p < 1 else np.full(len(cdf), cdf.shape[1])
    cdf /= cdf[at, kept - 1][:, None]  # past the kept ones over 1, thus over any draw
    return order[at, (cdf <= draws[:, None]).sum(axis=1)]


def _histories(tokens: list[array], k: int, fit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_history`` of many sequences: padded with 0, their lengths, and the least and greatest times."""
    last = [np.asarray(t)[-(HISTORY // k * k) :] for t in tokens]
    sizes = np.array([len(x) for x in last])
    if (sizes % k).any():
        raise ValueError(f"a sequence is not made of events of {k} tokens")
    seen = np.full((len(last), sizes.max()), V.SEP)
    seen[np.arange(seen.shape[1])[None, :] < sizes[:, None]] = np.concatenate(last)
    events = seen.reshape(len(last), -1, k)
    known = events[:, :, 2] != V.SEP
    times = events[:, :, 0] - V.ANTICIPATED * (events[:, :, 2] >= V.ANTICIPATED)
    now = np.where(known, times, 0).max(axis=1, initial=0)
    base = np.where(known, times, now[:, None]).min(axis=1, initial=np.iinfo(np.int64).max)
    base = np.minimum(base, now)
    if fit and (now - base >= V.DURATION).any():
        far = known & (times <= (now - V.DURATION)[:, None])
        first = np.where(far.any(axis=1), far.shape[1] - far[:, ::-1].argmax(axis=1), 0)
        base = np.where(known & (np.arange(far.shape[1])[None, :] >= first[:, None]), times, now[:, None]).min(axis=1)
        sizes = sizes - first * k
        seen = np.take_along_axis(seen, np.minimum(first[:, None] * k + np.arange(seen.shape[1])[None, :], seen.shape[1] - 1), axis=1)
    seen[:, ::k] -= base[:, None]
    return np.where(np.arange(seen.shape[1])[None, :] < sizes[:, None], seen, 0), sizes, base, now


def decode_batch(model: BatchNextToken, prompts: list[list[int]], controls: list[list[int]], seeds: list[int], n_events: int | None, top_p: float = 1.0, delta: int = V.DELTA, velocity: bool = False, autoregressive: bool = False, max_gap: int = 200) -> list[list[int]]:
    """``generate`` of every prompt with its own queue of controls and its own draws, ``V.stride`` model calls an event.

    Only the legal tokens of a slot are ranked. With ``autoregressive``, or without ``n_events``, history starts late enough
    for the next time to have a token; otherwise a sequence whose next time no token can say ends early.
    """
    k = V.stride(velocity)
    rngs = [np.random.default_rng([s, len(p)]) for s, p in zip(seeds, prompts, strict=True)]
    tokens = [array("q", p) for p in prompts]
    queues = [_queue(c, k, None if autoregressive else delta) for c in controls]
    ends = [max((due for due, _ in q), default=0) for q in queues]
    leads = np.array([V.AAR if c and not autoregressive else V.AR for c in controls])
    fit, released, live = autoregressive or n_events is None, [0] * len(prompts), list(range(len(prompts)))
    bounds = {1: (V.DURATION, V.NOTE), 2: (V.NOTE, V.NOTE + V.MAX_PITCH), 3: (V.VELOCITY, V.ANTICIPATED_VELOCITY)}

    def release(i: int, now: float) -> None:
        while released[i] < len(queues[i]) and now >= queues[i][released[i]][0]:
            tokens[i].extend(queues[i][released[i]][1])
            released[i] += 1

    if autoregressive:
        for i in live:
            release(i, _history(np.asarray(tokens[i]), k)[2])
    for _ in count() if n_events is None else range(n_events):
        if not autoregressive:
            for i in live:
                release(i, tokens[i][-k] % V.ANTICIPATED if tokens[i] else 0)
        if n_events is None:
            live = [i for i in live if released[i] < len(queues[i])]
        if not live:
            break
        history, lengths, bases, now = _histories([tokens[i] for i in live], k, fit)
        room = now - bases < V.DURATION
        if not room.all():
            live = [i for i, has in zip(live, room, strict=True) if has]
            if not live:
                break
            history, lengths, bases, now = history[room], lengths[room], bases[room], now[room]
        at = np.arange(len(live))
        ids = np.zeros((len(live), 1 + history.shape[1] + k), np.int64)
        ids[:, 0] = leads[live]
        ids[:, 1:-k] = history
        lengths = lengths + 1
        for slot in range(k):
            low = now - bases if slot == 0 else np.full(len(live), bounds[slot][0])
            high = np.minimum(low + max_gap, V.DURATION) if slot == 0 else np.full(len(live), bounds[slot][1])
            legal = low[:, None] + np.arange((high - low).max())[None, :]
            within = legal < high[:, None]
            asked, seen = legal if within.all() else np.where(within, legal, 0), ids[:, : lengths.max()]
            logits = model.of(seen, lengths, asked) if hasattr(model, "of") else np.take_along_axis(model(seen, lengths), asked, axis=1)
            legal_logits = logits if within.all() else np.where(within, logits, -np.inf)
            draws = np.array([rngs[i].random() for i in live])
            ids[at, lengths] = low + nucleus_rows(legal_logits, top_p, draws)
            lengths += 1
        drawn = ids[at[:, None], lengths[:, None] - k + np.arange(k)[None, :]]
        drawn[:, 0] += bases
        for i, event in zip(live, drawn.tolist(), strict=True):
            if autoregressive and n_events is None and event[0] >= ends[i]:
                release(i, np.inf)
                continue
            if autoregressive:
                release(i, event[0])
            tokens[i].extend(event)
    if autoregressive:
        for i in range(len(prompts)):
            release(i, np.inf)
    return [t.tolist() for t in tokens]


def decode(prompts: DataFrame, model: Model, n_events: int | None, top_p: float = 0.95, delta: int = V.DELTA, velocity: bool = False, autoregressive: bool = False, batch_size: int = 32) -> DataFrame:
    """(seq_id, tokens) of prompts (seq_id, tokens, and controls if there are any), continued in batches of like length.

    ``controls`` are anticipated events in order of time, or plain ones too when ``autoregressive``. Each is put in as soon as
    the music comes within ``delta`` ticks of it, or, when ``autoregressive``, as a plain event before the new event that
    reaches it; those that none reaches come at the end. ``n_events`` None goes on until the last control. Draws depend on
    seq_id, which may not be negative, and the prompt's length alone, so neither partitions nor batches matter.
    """
    with_controls = "controls" in prompts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                seq_ids = part["seq_id"].tolist()
                lists = [[[int(t) for t in x] for x in part[c]] for c in ("tokens", "controls")]
                out = decode_batch(in_worker(model), *lists, seq_ids, n_events, top_p, delta, velocity, autoregressive)
                yield pd.DataFrame({"seq_id": seq_ids, "tokens": out})

    none = F.array().cast("array<int>")
    given = F.coalesce(F.col("controls").cast("array<int>"), none) if with_controls else none
    rows = prompts.select(F.col("seq_id").cast("long").alias("seq_id"), F.coalesce(F.col("tokens").cast("array<int>"), none).alias("tokens"), given.alias("controls"))
    # Few bytes make much work: rows are dealt by number, as small partitions would be joined.
    dealt = rows.repartition(int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("seq_id"))
    return dealt.sortWithinPartitions(F.size("tokens"), "seq_id").mapInPandas(run, "seq_id long, tokens array<int>")


def toy_decoder(velocity: bool = False) -> Model:
    """``toy_model`` for many sequences a call."""

    def load() -> BatchNextToken:
        phase = np.arange(V.vocabulary_size(velocity)) * 0.37

        def seeds(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            at = lengths[:, None] - np.minimum(lengths, 6)[:, None] + np.arange(6)[None, :]
            last = np.where(at < lengths[:, None], np.take_along_axis(ids, np.minimum(at, ids.shape[1] - 1), axis=1), 0)
            return (1 + (last * np.arange(1, 7)).sum(axis=1)) % 1009

        def logits(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            return np.sin(phase[None, :] + seeds(ids, lengths)[:, None])

        logits.of = lambda ids, lengths, tokens: np.sin(phase[tokens] + seeds(ids, lengths)[:, None])
        return logits

    return Model(f"toy decoder {velocity}", load)
