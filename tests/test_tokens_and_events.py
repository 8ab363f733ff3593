"""Token functions against fixed examples; event algebra and MIDI against plain restatements on random sequences."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.functions import tokens as T
from seqdrift.operators import events as E
from seqdrift.operators import midi as M
from seqdrift.operators import windows as W
from seqdrift.sources import io as S

A, AR, SEP, P = V.ANTICIPATED, V.AR, V.SEP, V.MAX_PITCH


def one(spark, tokens, function):
    return spark.createDataFrame([(1, tokens)], V.SEQUENCES).select(function(F.col("tokens"))).first()[0]


def test_pitch_name(spark):
    assert spark.range(1).select(T.pitch_name(F.lit(60))).first()[0] == "C4"


def test_readable_events(spark):
    tokens = [AR, SEP, SEP, SEP, 0, 10048, 11060, 650 + A, 10048 + A, 11062 + A, 700, 10095, 11060, 800, 10005, V.REST]
    got = one(spark, tokens, T.readable_events)
    assert got[0].special_token == "AR" and got[1].special_token == "SEP"
    assert (got[2].onset, got[2].duration, got[2].instrument, got[2].pitch, got[2].anticipated) == (0.0, 0.48, 0, "C4", False)
    assert (got[3].onset, got[3].duration, got[3].pitch, got[3].anticipated) == (6.5, 0.48, "D4", True)
    assert got[-1].special_token == "REST"
    with_velocity = one(spark, [AR, SEP, SEP, SEP, SEP, 0, 10048, 11060, 55029, 50 + A, 10048 + A, 11062 + A, 55030 + 128], lambda t: T.readable_events(t, True))
    assert with_velocity[2].velocity == 1 and with_velocity[3].velocity == 2 and with_velocity[3].anticipated


def test_leading_token_and_partial_tuple(spark):
    assert len(one(spark, [5, 0, 10048, 11060, 7], T.readable_events)) == 2
    assert one(spark, [V.AAR], T.readable_events)[0].special_token == "AAR"


def test_set_instrument(spark):
    got = one(spark, [AR, SEP, SEP, SEP, 0, 10048, 11060 + 3 * P, 50, 10048, 11060 + 4 * P, 100 + A, 10048 + A, 11062 + A], lambda t: T.set_instrument(t, 5))
    assert got == [AR, SEP, SEP, SEP, 0, 10048, 11060 + 5 * P, 50, 10048, 11060 + 5 * P, 100 + A, 10048 + A, 11062 + A + 5 * P]


def test_set_anticipated(spark):
    tokens = [AR, SEP, SEP, SEP, 0, 10048, 11060, 50, 10048, 11060, 100 + A, 10048 + A, 11062 + A]
    assert one(spark, tokens, lambda t: T.set_anticipated(t, True)) == [AR, SEP, SEP, SEP, A, 10048 + A, 11060 + A, 50 + A, 10048 + A, 11060 + A, 100 + A, 10048 + A, 11062 + A]
    assert one(spark, tokens, lambda t: T.set_anticipated(t, False)) == [AR, SEP, SEP, SEP, 0, 10048, 11060, 50, 10048, 11060, 100, 10048, 11062]


def test_filter_instrument(spark):
    tokens = [AR, SEP, SEP, SEP, 0, 10048, 11060, 50, 10050, 11188, 100 + A, 10048 + A, 11062 + A, 200 + A, 10050 + A, 11188 + A]
    assert one(spark, tokens, lambda t: T.filter_instrument(t, 0)) == tokens[:7] + tokens[10:13]
    assert one(spark, tokens, lambda t: T.filter_instrument(t, 1)) == tokens[:4] + tokens[7:10] + tokens[13:]


def test_strict_validation_fails(spark):
    with pytest.raises(Exception, match="negative token"):
        one(spark, [AR, -1, 10000, 11000], T.require_valid)


def test_windows(spark):
    ids = [AR, *range(1, 40)]
    df = spark.createDataFrame([(0, ids), (1, [AR])], V.SEQUENCES)
    got = W.materialise(W.window_index(df, 4, 1), 4).orderBy("start").collect()
    assert got[0].input_ids == ids[:13] and got[1].input_ids == ids[:1] + ids[4:16]
    assert len(got) == (len(ids) - 1 - 12) // 3 + 1 and got[-1].input_ids == ids[:1] + ids[-12:]


@pytest.mark.parametrize(("gap", "ok"), [(500, True), (501, False)])
def test_gap_edges(spark, gap, ok):
    window = [AR, 100, 10010, 11060, 110 + gap, 10010, 11060]
    assert one(spark, window, W.acceptable_gaps) is ok
    assert one(spark, window, lambda t: W.acceptable_gaps(t, -1)) is True


def test_gap_loses_a_tick_like_seconds_do(spark):
    """Tick 29 becomes 28 on the way through seconds."""
    assert int(29 / 100 * 100) == 28
    window = [AR, 0, 10029, 11060, 529, 10010, 11060]
    onset = int(529 / 100 * 100)
    assert one(spark, window, W.acceptable_gaps) is (onset - 28 <= 500)


def random_events(seed, n=30, controls=False, separators=False):
    rng = random.Random(seed)
    time, out = 0, []
    for _ in range(n):
        time += rng.choice([0, 5, 90, 130, 420])
        if separators and rng.random() < 0.1:
            out.append((SEP, SEP, SEP))
            time = 0
            continue
        shift = A if controls and rng.random() < 0.4 else 0
        note = V.REST if not shift and rng.random() < 0.1 else V.NOTE + P * rng.randrange(3) + rng.randrange(128) + shift
        out.append((time + shift, V.DURATION + rng.randrange(400) + shift, note))
    return out


def frame(spark, by_seq):
    return spark.createDataFrame([(s, i, *e) for s, events in by_seq.items() for i, e in enumerate(events)], "seq_id long, ev_idx int, time int, dur int, note int")


def listed(df):
    out = defaultdict(list)
    for r in df.orderBy("seq_id", "ev_idx").collect():
        out[r.seq_id].append((r.time, r.dur, r.note))
    return out


def plain_pad(events, density=100):
    out, before = [], 0
    end = max([t for t, _, _ in events], default=0)
    for t, d, n in events:
        while t > before + density:
            before += density
            out.append((before, V.DURATION, V.REST))
        out.append((t, d, n))
        before = t
    while end > before + density:
        before += density
        out.append((before, V.DURATION, V.REST))
    return out


def plain_anticipate(events, controls, delta):
    out, queue, clock = [], list(controls), 0
    for e in events:
        while queue and clock >= queue[0][0] - A - delta:
            out.append(queue.pop(0))
        out.append(e)
        clock = e[0]
    return out, queue


def test_pad_anticipate_combine(spark):
    events = {s: random_events(s) for s in range(20)}
    for s in (3, 4):
        random.Random(s).shuffle(events[s])
    controls = {s: [e for e in random_events(100 + s, 12, controls=True) if e[2] >= A] for s in range(20)}
    random.Random(1).shuffle(controls[5])
    ev, co = frame(spark, events), frame(spark, controls)
    assert listed(E.pad(ev)) == {s: plain_pad(e) for s, e in events.items()}
    for delta in (0, 300):
        merged, left = E.anticipate(ev, co, delta)
        want = {s: plain_anticipate(events[s], controls[s], delta) for s in events}
        assert listed(merged) == {s: w[0] for s, w in want.items()}
        assert listed(left) == {s: w[1] for s, w in want.items() if w[1]}
    both = {s: sorted(events[s] + [tuple(x - A for x in c) for c in controls[s]], key=lambda e: e[0]) for s in events}
    assert listed(E.combine(ev, co)) == both


def test_split_sort_mask_clip_translate(spark):
    data = {s: random_events(s, 40, controls=True, separators=True) for s in range(12)}
    df = frame(spark, data)
    plain, controls = E.split(df)
    assert listed(plain) == {s: k for s, e in data.items() if (k := [x for x in e if x[2] < A])}
    assert listed(controls) == {s: k for s, e in data.items() if (k := [x for x in e if x[2] >= A])}
    assert listed(E.sort(df)) == {s: sorted(e, key=lambda x: x[0]) for s, e in data.items()}
    real = lambda x: x[0] - (A if x[2] >= A else 0)
    assert listed(E.mask(df, 1, 3)) == {s: k for s, e in data.items() if (k := [x for x in e if not 1 < real(x) / 100 < 3])}

    def clipped(e):
        out = []
        for x in e:
            t, d = real(x), x[1] - (V.ANTICIPATED_DURATION if x[2] >= A else V.DURATION)
            if 100 <= t <= 300:
                out.append((x[0], x[1] - max(t + d - 300, 0), x[2]))
        return out

    assert listed(E.clip(df, 1, 3)) == {s: k for s, e in data.items() if (k := clipped(e))}

    def moved(e, dt):
        out = []
        for x in e:
            dt = 0 if x[2] == SEP else dt
            out.append((x[0] + dt, x[1], x[2]))
        return out

    assert listed(E.translate(df, 7)) == {s: moved(e, 7) for s, e in data.items()}
    with pytest.raises(Exception, match="before time 0"):
        E.translate(df, -100_000).collect()


def test_times_and_instruments(spark):
    data = {s: random_events(s, 25, controls=True, separators=True) for s in range(12)}
    df = frame(spark, data)
    instr = lambda x: (x[2] - (V.ANTICIPATED_NOTE if x[2] >= A else V.NOTE)) // P
    real = lambda x: x[0] - (A if x[2] >= A else 0)
    for wanted in (None, 1):
        least, most = {}, {}
        for s, e in data.items():
            head = e[: [x[2] for x in e].index(SEP)] if SEP in [x[2] for x in e] else e
            least[s] = min([real(x) for x in head if wanted is None or instr(x) == wanted], default=0)
            most[s] = max([real(x) for x in e if x[2] != SEP and (wanted is None or instr(x) == wanted)], default=0)
        assert {r.seq_id: r.min_time for r in E.min_time(df, False, wanted).collect()} == least
        assert {r.seq_id: r.max_time for r in E.max_time(df, False, wanted).collect()} == most
    counts = defaultdict(int)
    for s, e in data.items():
        for x in e:
            if x[2] < SEP:
                counts[s, instr(x)] += 1
    assert {(r.seq_id, r.instr): r.n for r in E.instruments(df).collect()} == counts
    assert {r.seq_id: dict(r.instruments) for r in E.instrument_map(df).collect()} == {s: {i: n for (q, i), n in counts.items() if q == s} for s in data}


def plain_compound(messages):
    time, out, open_notes, program = 0.0, [], defaultdict(list), defaultdict(int)
    for m in messages:
        time += m[0]
        kind, channel, note, velocity, prog = m[1:]
        if kind == "program_change":
            program[channel] = prog
            continue
        instr = 128 if channel == 9 else program[channel]
        if kind == "note_on" and velocity > 0:
            out.append([round(100 * time), -1, note, instr, velocity])
            open_notes[instr, note, channel].append((len(out) - 1, time))
        elif open_notes[instr, note, channel]:
            at, began = open_notes[instr, note, channel].pop(0)
            out[at][1] = round(100 * (time - began))
    return [tuple(x) for x in out]


def test_note_pairing(spark):
    rng = random.Random(17)
    traces = {s: [(rng.randrange(9) / 4, rng.choice(["note_on", "note_on", "note_off", "program_change"]), rng.choice([0, 1, 9]), rng.choice([60, 61]), rng.choice([0, 70]), rng.randrange(3)) for _ in range(40)] for s in range(60)}
    rows = [(s, i, *m) for s, t in traces.items() for i, m in enumerate(t)]
    df = spark.createDataFrame(rows, "seq_id long, msg_idx int, delta double, type string, channel int, note int, velocity int, program int")
    got = defaultdict(list)
    for r in M.to_compound(df).orderBy("seq_id", "note_idx").collect():
        got[r.seq_id].append((r.onset, r.dur, r.pitch, r.instr, r.velocity))
    assert got == {s: k for s, t in traces.items() if (k := plain_compound(t))}


def test_midi_file_round_trip(spark, tmp_path):
    rows = [(1, 0, 0, 100, 60, 0, 80), (1, 1, 50, 25, 62, 5, 70), (1, 2, 100, 30, 40, 128, 90)]
    compound = spark.createDataFrame(rows, V.COMPOUND)
    content = S.encode_midi(M.to_messages(compound)).first().content
    (tmp_path / "a.mid").write_bytes(bytes(content))
    back = M.to_compound(S.read_midi(spark, f"{tmp_path}/a.mid").select("seq_id", "msg_idx", "delta", "type", "channel", "note", "velocity", "program"))
    assert sorted((r.onset, r.dur, r.pitch, r.instr, r.velocity) for r in back.collect()) == sorted(r[2:] for r in rows)


def test_midi_files_of_all_users(spark, tmp_path):
    from seqdrift.plans.detector_queries import S11_S12_midi_files

    users = [1, 19, 20, 21, 4_000_000_000]
    rows = [(100 * n + i + 1, u, i * 260, "view", 5.0) for n, u in enumerate(users) for i in range(3)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at long, event_type string, value double")
    df.select("event_id", "user_id", F.timestamp_seconds("at").alias("ts"), "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.seq_id: r.bytes for r in S11_S12_midi_files(spark, str(tmp_path)).collect()}
    assert sorted(got) == users and min(got.values()) > 14


def test_segments_continue_after_separators(spark):
    events = [(0, 10050, 11060), (SEP, SEP, SEP), (10, 10020, 11061 + P), (5, 10000, V.REST)]
    got = M.events_to_compound(frame(spark, {1: events})).orderBy("note_idx").collect()
    assert [(r.onset, r.dur, r.pitch, r.instr) for r in got] == [(0, 50, 60, 0), (60, 20, 61, 1)]


def test_velocity_streams(spark):
    df = spark.createDataFrame([(1, 0, 0, 10048, 11060, 55040), (1, 1, 350, 10048, 11060, 55041)], V.EVENTS)
    assert [r.vel for r in E.pad(df).orderBy("ev_idx").collect()] == [55040, V.VELOCITY, V.VELOCITY, V.VELOCITY, 55041]
    assert E.to_sequences(df, lead=AR).first().tokens == [AR, 0, 10048, 11060, 55040, 350, 10048, 11060, 55041]


def test_text_scan_and_collate(spark, tmp_path):
    (tmp_path / "x.txt").write_text("55026 0 10048 11060\n\n  55026 1 10001 11061 5 10001 11061 \n")
    df = S.text_scan(spark, f"{tmp_path}/x.txt")
    assert [r.input_ids for r in df.orderBy("seq_id").collect()] == [[55026, 0, 10048, 11060], [55026, 1, 10001, 11061, 5, 10001, 11061]]
    padded = S.collate(df.withColumn("batch_id", F.lit(0))).orderBy("length").collect()
    assert padded[0].input_ids == [55026, 0, 10048, 11060, 0, 0, 0] and padded[0].length == 4


def test_unknown_split(spark, tmp_path):
    spark.range(3).withColumn("split", F.lit("train")).write.partitionBy("split").parquet(f"{tmp_path}/t")
    with pytest.raises(ValueError, match="train"):
        S.split_scan(spark, f"{tmp_path}/t", "nope")
