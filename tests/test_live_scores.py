"""Scoring inside the stream against the batch form."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seqdrift.operators import pooling as P
from seqdrift.operators import scoring as H
from seqdrift.streaming import live as S
from seqdrift.streaming import pedal as R

SCHEMA = "device long, ts double, type string, note int, velocity int, channel int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def messages(seed=11, n=120):
    rng = random.Random(seed)
    rows = []
    for device in (1, 2, 3):
        for i in range(n):
            note = 48 if rng.random() < 0.08 else rng.randrange(49, 60)
            rows.append((device, i * 0.37 + device / 10, rng.choice(("note_on", "note_on", "note_off")), note, rng.randrange(3) * 40, rng.choice((0, 0, 9))))
    return rows


def run(spark, folder, batches, score, name="out", seconds=None, **settings):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/in{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/in*")
    made = S.stream_scores(stream, score, **settings)
    writer = made.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state")
    if seconds is None:
        writer.trigger(availableNow=True).start().awaitTermination(120)
    else:  # with timers there is always another batch
        query = writer.start()
        query.awaitTermination(seconds)
        query.stop()
    return spark.read.schema(S.LIVE).parquet(f"{folder}/{name}").collect()


def test_stream_scores_equal_batch_scores(rocks, tmp_path):
    rows = messages()
    model = P.toy_hidden_states(4)
    buffers = R.buffers(rocks.createDataFrame(rows, SCHEMA), size=10)

    def embedded(sequences):
        windows = sequences.select(F.col("seq_id").alias("sample_id"), F.col("tokens").alias("input_ids"))
        return P.extract_representations(windows, model, [12]).join(sequences, F.col("sample_id") == F.col("seq_id")).select("sample_id", "tokens", "emb")

    batch = R.score_rows(buffers, embedded).cache()
    detector = H.standard_detector(batch, 3)
    parameters = H.detector_parameters(detector)
    want = sorted((tuple(r.tokens), round(r.score, 9)) for r in H.score_with_parameters(batch, parameters).collect())
    cut = sorted(rows, key=lambda m: m[1])
    got = run(rocks, tmp_path, [cut[i : i + 90] for i in range(0, len(cut), 90)], S.detector_score(model, 12, parameters), size=10)
    assert all(r.kind == "score" for r in got) and len(got) == len(want) > 100
    again = sorted((tuple(r.tokens), round(r.score, 9)) for r in got)
    assert [t for t, _ in again] == [t for t, _ in want]
    assert np.allclose([v for _, v in again], [v for _, v in want], rtol=1e-6)
    numbers = {(r.device, r.ts): (r.session, r.n_buffer) for r in buffers.collect()}
    assert all(numbers[r.device, r.ts] == (r.session, r.n_buffer) for r in got)


def test_late_messages_come_out_and_change_nothing(rocks, tmp_path):
    on = lambda ts, note=60: (7, ts, "note_on", note, 50, 0)
    batches = [[on(1.0, 48), on(2.0)], [on(1.5), on(3.0)], [on(2.5, 48), on(4.0)]]
    got = run(rocks, tmp_path, batches, lambda tokens: [float(len(t)) for t in tokens])
    assert sorted((r.ts, r.kind, r.score) for r in got) == [(1.5, "late", None), (2.0, "score", 4.0), (2.5, "late", None), (3.0, "score", 7.0), (4.0, "score", 10.0)]
    assert [tuple(r) for r in S.late_counts(rocks.read.schema(S.LIVE).parquet(f"{tmp_path}/out")).collect()] == [(7, 2)]


def test_state_survives_a_restart(rocks, tmp_path):
    """Two runs over the same checkpoint give each message's row once, with the buffer of both."""
    on = lambda ts, note=60: (7, ts, "note_on", note, 50, 0)
    score = lambda tokens: [float(len(t)) for t in tokens]
    run(rocks, tmp_path, [[on(1.0, 48), on(2.0)]], score)
    for i, rows in enumerate([[on(3.0), on(4.0)]], 5):
        rocks.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{tmp_path}/in{i}")
    got = run(rocks, tmp_path, [], score)
    assert sorted((r.ts, r.score) for r in got) == [(2.0, 4.0), (3.0, 7.0), (4.0, 10.0)]


def test_idle_devices_are_forgotten(rocks, tmp_path):
    on = lambda ts, note=60: (7, ts, "note_on", note, 50, 0)
    other = (8, 1.0, "note_on", 60, 50, 0)
    got = run(rocks, tmp_path, [[on(1.0, 48), on(2.0)], [other], [other], [other], [on(3.0)]], lambda tokens: [1.0] * len(tokens), idle_ms=1, seconds=25)
    assert [r.ts for r in got if r.kind == "score"] == [2.0]


def test_buffer_tokens():
    assert S.buffer_tokens([]) == [55_026]
    assert S.buffer_tokens([(5.0, "note_off", 60, 0, 0), (5.5, "note_on", 60, 9, 0), (5.625, "note_on", 60, 9, 0), (6.0, "note_off", 60, 0, 0)]) == [55_026, 50, 10_050, 11_060, 62, 10_025, 11_060]
    assert S.buffer_tokens([(0.0, "note_on", 36, 1, 9), (20.0, "note_on", 36, 0, 9)])[1:] == [0, 10_999, 11_000 + 128 * 128 + 36]


def test_detector_from_tokens_to_scores(spark):
    """Extraction, axes, scaling and distance in one fitted detector, against the same in NumPy."""
    from seqdrift.operators.transforms import Extract

    rng = np.random.default_rng(4)
    tokens = [[55_026, *rng.integers(0, 27_000, int(rng.integers(3, 60))).tolist()] for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(tokens)), "seq_id long, tokens array<int>")
    train, new = rows.where("seq_id < 40"), rows.where("seq_id >= 40")
    detector = H.standard_detector(train, 3, Extract(P.toy_embeddings, dimensions=4, layer=12))
    got = [r.score for r in detector.score(new).orderBy("sample_id").collect()]

    states = [np.sin(np.outer(np.array(t, float) + 1, np.arange(1, 5)) * 0.618 + 12) for t in tokens]
    x = np.stack([np.concatenate((h.mean(0), h.std(0))) for h in states])
    mean = x[:40].mean(0)
    axes = np.linalg.svd(x[:40] - mean, full_matrices=False)[2][:3]
    z = (x - mean) @ axes.T
    z = (z - z[:40].mean(0)) / z[:40].std(0)
    inverse = np.linalg.inv(np.cov(z[:40].T) + 1e-6 * np.eye(3))
    d = z[40:] - z[:40].mean(0)
    assert np.allclose(got, np.sqrt(((d @ inverse) * d).sum(1)), rtol=1e-6)


class Counted:
    """A state that counts the calls that would go to the store."""

    def __init__(self, empty):
        self.value, self.empty, self.calls = None, empty, 0

    def get(self):
        self.calls += 1
        return self.empty if self.value is None else self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    put = update

    def clear(self):
        self.update(None)

    def exists(self):
        self.calls += 1
        return self.value is not None


def test_rows_go_through_with_few_calls_to_the_store():
    session = S._Session(lambda tokens: [float(len(t)) for t in tokens], 48, 2, None)
    session.place, session.held = Counted(None), Counted([])
    rows = lambda *messages: iter([Row(device=7, ts=ts, type="note_on", note=note, velocity=50, channel=0) for ts, note in messages])
    first = list(session.handleInputRows((7,), rows((2.0, 60), (1.0, 48)), None))
    assert [tuple(r) for r in first] == [(7, 2.0, "score", 1, 1, S.buffer_tokens([(2.0, "note_on", 60, 50, 0)]), 4.0)]
    assert (session.place.calls, session.held.calls) == (2, 1)  # nothing is asked of a list that cannot be there
    second = list(session.handleInputRows((7,), rows((1.5, 60), (3.0, 61), (4.0, 62)), None))
    assert [(r.ts, r.kind, r.n_buffer, r.score) for r in second] == [(1.5, "late", None, None), (3.0, "score", 2, 7.0), (4.0, "score", 2, 7.0)]
    assert list(session.handleInputRows((7,), rows((5.0, 48)), None)) == [] and session.held.value is None
    assert list(session.handleInputRows((7,), rows((None, 50), (6.0, 50)), None)) == []
