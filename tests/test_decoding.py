"""Decoding many sequences a call against the plain decoder."""

from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.operators import sampling as G


def _event(t, k, control=False):
    shift = V.ANTICIPATED if control else 0
    event = [t + shift, V.DURATION + 5 + t % 40 + shift, V.NOTE + t % 128 + shift]
    return event + ([V.VELOCITY + t % 128] if k == 4 else [])


def _prompts(k):
    rows = []
    for s in range(20):
        tokens = [x for i in range(s % 7) for x in _event(100 + 30 * i + s, k)]
        controls = [x for i in range(s % 5) for x in _event(120 + 90 * i, k, True)]
        rows.append((s, tokens, controls or None))
    return [*rows, (20, [x for i in range(400) for x in _event(i, k)], None)]


@pytest.mark.parametrize("autoregressive", [False, True])
@pytest.mark.parametrize("velocity", [False, True])
def test_equals_the_plain_decoder(spark, autoregressive, velocity):
    rows = _prompts(V.stride(velocity))
    frame = spark.createDataFrame(rows, "seq_id long, tokens array<int>, controls array<int>").repartition(3)
    got = {r["seq_id"]: r["tokens"] for r in G.decode(frame, G.toy_decoder(velocity), 4, 0.9, velocity=velocity, autoregressive=autoregressive, batch_size=6).collect()}
    for s, tokens, controls in rows:
        assert got[s] == G.generate(G.toy_model(velocity), tokens, 4, controls, 0.9, seed=s, velocity=velocity, autoregressive=autoregressive), s


def test_all_controls_come_in_and_in_order(spark):
    controls = [x for t in (5, 60, 61, 300) for x in _event(t, 3, True)]
    tokens = G.decode_batch(G.toy_decoder().load(), [_event(0, 3)], [controls], [1], 20)[0]
    events = [tokens[i : i + 3] for i in range(0, len(tokens), 3)]
    put_in = [e for e in events if e[2] >= V.ANTICIPATED]
    assert [x for e in put_in for x in e] == controls[: 3 * len(put_in)] and len(put_in) >= 3
    music = [e for e in events if e[2] < V.ANTICIPATED]
    assert len(music) == 21 and all(V.NOTE <= e[2] < V.NOTE + V.MAX_PITCH for e in music)
    assert [e[0] for e in music] == sorted(e[0] for e in music)


@pytest.mark.parametrize("top_p", [0.0, 0.5, 0.95, 1.0])
def test_nucleus_rows_equal_single_choices(top_p):
    rng = np.random.default_rng(0)
    logits = np.where(rng.random((50, 40)) < 0.3, -np.inf, rng.normal(size=(50, 40)).round(1))
    draws = [np.random.default_rng(i).random() for i in range(50)]
    got = G.nucleus_rows(logits, top_p, np.array(draws))
    assert got.tolist() == [G.nucleus_choice(row, top_p, np.random.default_rng(i)) for i, row in enumerate(logits)]


def test_no_room_left_ends_a_sequence_and_empty_tables_are_empty(spark):
    late = [*_event(0, 3), V.DURATION + 50, V.DURATION + 1, V.NOTE]
    assert G.decode_batch(G.toy_decoder().load(), [late, []], [[], []], [1, 2], 2)[0] == late
    assert G.decode(spark.createDataFrame([], "seq_id long, tokens array<int>"), G.toy_decoder(), 2).count() == 0
    got = G.decode(spark.createDataFrame([(1, None, "x")], "seq_id long, tokens array<int>, row string"), G.toy_decoder(), 2).collect()
    assert len(got[0]["tokens"]) == 6


def test_a_model_is_asked_for_legal_tokens_only():
    """No row of a whole vocabulary is made where the model can do with less, and the tokens are the same."""
    model, asked = G.toy_decoder().load(), []

    def whole(ids, lengths):
        raise AssertionError("all logits were asked for")

    def of(ids, lengths, tokens):
        asked.append(tokens.shape[1])
        return model.of(ids, lengths, tokens)

    whole.of = of
    prompts = [[10 * i, 10_010, 11_060 + i] for i in range(5)]
    got = G.decode_batch(whole, prompts, [[]] * 5, list(range(5)), 4, 0.95)
    assert got == G.decode_batch(lambda ids, lengths: model(ids, lengths), prompts, [[]] * 5, list(range(5)), 4, 0.95)
    assert len(asked) == 12 and max(asked) == 1000


def _without(events, taken):
    """What is left of a list of events when others are taken out in order; all must be there."""
    taken, left = list(taken), []
    for e in events:
        if taken and e == taken[0]:
            taken.pop(0)
        else:
            left.append(e)
    assert not taken
    return left


@pytest.mark.parametrize("n_events", [2, None])
def test_autoregressive_decoding_loses_no_control(n_events):
    """Controls that no new event reaches come in too, reached ones stand in time order, and music goes on to the last one."""
    times = [[5, 60, 61, 900], [40], [], [300, 300, 30_000]]  # between the last two lie more ticks than there are time tokens
    controls = [[x for t in ts for x in _event(t, 3, t < V.DURATION)] for ts in times]
    prompts = [_event(0, 3), [], _event(7, 3), _event(0, 3) + _event(250, 3)]
    got = G.decode_batch(G.toy_decoder().load(), prompts, controls, [1, 2, 3, 4], n_events, 0.95, autoregressive=True)
    for s, (tokens, prompt, control, ts) in enumerate(zip(got, prompts, controls, times, strict=True)):
        assert tokens == G.generate(G.toy_model(), prompt, n_events, control, 0.95, seed=s + 1, autoregressive=True), s
        events = [tokens[i : i + 3] for i in range(0, len(tokens), 3)]
        assert [e[0] for e in events] == sorted(e[0] for e in events)
        new = _without(events, [prompt[i : i + 3] for i in range(0, len(prompt), 3)] + [_event(t, 3) for t in ts])
        if n_events is None:
            after = [e[0] for e in events[max(len(prompt) // 3 - 1, 0) :]]
            assert all(e[0] < max(ts) for e in new) and all(b - a < 200 for a, b in pairwise(after))
        else:
            assert len(new) == n_events


def test_velocities_of_plain_controls_stay_velocities():
    control = [*_event(50, 3, True), V.ANTICIPATED_VELOCITY + 9]
    got = G.decode_batch(G.toy_decoder(True).load(), [_event(0, 4)], [control], [1], 1, velocity=True, autoregressive=True)[0]
    assert [*_event(50, 3), V.VELOCITY + 9] in [got[i : i + 4] for i in range(0, len(got), 4)]
    assert got == G.generate(G.toy_model(True), _event(0, 4), 1, control, seed=1, velocity=True, autoregressive=True)


def test_G07_keeps_every_event_and_goes_on_to_the_last(spark, tmp_path):
    from seqdrift.plans.base import events
    from seqdrift.plans.token_queries import G07_generate_ar

    rows = [(1000 * u + i, u, 260 * 170 * i + 7 * u, "click" if i % 2 else "view", float(i)) for u in (1, 2, 3) for i in range(55)]
    rows += [(11 * i + 1, 9, 260 * i, "error", 1.0) for i in range(20)]  # no control
    table = spark.createDataFrame(rows, "event_id long, user_id long, at long, event_type string, value double")
    table.withColumn("ts", F.timestamp_seconds("at")).write.parquet(f"{tmp_path}/events.parquet")
    own = {}
    for r in events(spark, str(tmp_path)).where(F.col("note") != V.SEP).orderBy("ev_idx").collect():
        shift = V.ANTICIPATED if r["note"] >= V.ANTICIPATED else 0
        own.setdefault(r["seq_id"], []).append([r["time"] - shift, r["dur"] - shift, r["note"] - shift])
    got = {r["seq_id"]: [int(x) for x in r["tokens"].split(" ")] for r in G07_generate_ar(spark, str(tmp_path)).collect()}
    assert set(got) == set(own) == {1, 2, 3, 9}
    for s, tokens in got.items():
        sequence = [tokens[i : i + 3] for i in range(0, len(tokens), 3)]
        new = _without(sequence, own[s])
        assert [e[0] for e in sequence] == sorted(e[0] for e in sequence)
        assert (s == 9) == (not new) and all(e[0] < own[s][-1][0] for e in new)
        assert s == 9 or len(new) > 30
