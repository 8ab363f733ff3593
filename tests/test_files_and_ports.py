"""MIDI files as a data source, and live ports as a streaming one."""

import os
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from seqdrift.operators import midi as M
from seqdrift.sources import io as S
from seqdrift.sources import midi_files as D
from seqdrift.streaming import port as L

NOTES = "seq_id long, note_idx int, onset int, dur int, pitch int, instr int, velocity int"


@pytest.fixture(scope="module")
def compound(spark):
    rows = [(s, i, 30 * i, 10 + i % 19, 40 + (i * 7 + s) % 50, (0, 128, 5)[i % 3], 1 + i % 100) for s in range(-2, 9) for i in range(40)]
    return spark.createDataFrame(rows, NOTES)


def _files(compound):
    return S.encode_midi(M.to_messages(compound))


def _notes(df):
    return Counter(tuple(r) for r in df.select("seq_id", "onset", "dur", "pitch", "instr", "velocity").collect())


def _save(df, path, mode="append"):
    D.register(df.sparkSession)
    df.write.format("midi_files").mode(mode).save(path)


def _load(spark, path):
    return spark.read.format("midi_files").load(path)


def test_notes_of_several_tracks_come_back(spark, compound, tmp_path):
    _save(_files(compound).withColumn("path", F.lit("x")), str(tmp_path / "m"))
    back = _load(spark, str(tmp_path / "m"))
    assert back.select("path").distinct().count() == 11
    assert _notes(M.to_compound(back)) == _notes(compound)


def test_small_files_are_encoded_by_many_tasks_and_paired_once(spark, compound):
    files = _files(compound)
    assert files.select(F.spark_partition_id()).distinct().count() > 1
    messages = M.to_messages(compound)
    timed = messages.select("seq_id", "msg_idx", F.lit(0.1).alias("delta"), "type", "channel", F.col("pitch").alias("note"), "velocity", F.lit(None).cast("int").alias("program"))
    for df in (messages, M.to_compound(timed)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, i, 0.5, kind, channel, note, 60, None) for i, (kind, channel, note) in enumerate([("note_on", None, 60), ("note_on", 0, 60), ("note_off", None, 60), ("note_off", 0, 60)])]
    got = M.to_compound(spark.createDataFrame(rows, timed.schema)).orderBy("note_idx").collect()
    assert [r.dur for r in got] == [-1, 100]  # a note on no channel meets no end


def test_appending_adds_overwriting_hides_and_vacuum_deletes(spark, compound, tmp_path):
    path = str(tmp_path / "m")
    low, high = compound.where("seq_id < 3"), compound.where("seq_id >= 3")
    _save(_files(low), path)
    _save(_files(high), path)
    assert _notes(M.to_compound(_load(spark, path))) == _notes(compound)
    _save(_files(low), path, "overwrite")
    assert _notes(M.to_compound(_load(spark, path))) == _notes(low)
    assert D.vacuum(path) > 0 and D.vacuum(path) == 0
    assert _notes(M.to_compound(_load(spark, path))) == _notes(low)


def test_a_write_that_fails_shows_nothing(spark, compound, tmp_path):
    path = str(tmp_path / "m")
    _save(_files(compound.where("seq_id = 1")), path)
    broken = _files(compound).withColumn("seq_id", F.when(F.col("seq_id") != 5, F.col("seq_id"))).repartition(4)
    with pytest.raises(Exception, match="needs a seq_id"):
        _save(broken, path)
    assert _notes(M.to_compound(_load(spark, path))) == _notes(compound.where("seq_id = 1"))


def test_equal_ids_empty_writes_and_large_folders(spark, compound, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    with pytest.raises(Exception, match="no MIDI files were committed"):
        D._Reader(path).partitions()
    _save(_files(compound.where("seq_id > 99")), path)
    assert _load(spark, path).count() == 0
    one = _files(compound.where("seq_id = 1"))
    _save(one.union(one).coalesce(1), path)
    assert _load(spark, path).groupBy("path").count().count() == 2
    monkeypatch.setattr(D, "PARTITION_FILES", 1)
    shares = D._Reader(path).partitions()
    assert len(shares) == 2
    assert sum(b.num_rows for s in shares for b in D._Reader(path).read(s)) == _load(spark, path).count()


MESSAGES = [(d, i * 0.01 * d, ("note_on", "note_off")[i % 2], i % 128, 100 * (1 - i % 2), d % 16) for d in (1, 2, 300) for i in range(70 * d if d < 9 else 5)]


def _run(spark, path):
    L.register(spark)
    stream = spark.readStream.format("live_port").load(f"{path}/log")
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return Counter(tuple(r) for r in spark.read.schema(L.MESSAGES).parquet(f"{path}/out").collect())


def test_a_restart_gives_each_message_once(spark, tmp_path):
    for part in (MESSAGES[::2], MESSAGES[1::2]):
        logs = {d: L.PortLog(str(tmp_path / "log"), d) for d in (1, 2, 300)}
        for low in range(0, len(part), 7):
            for d, log in logs.items():
                log.append([m[1:] for m in part[low : low + 7] if m[0] == d])
        _run(spark, tmp_path)
    assert _run(spark, tmp_path) == Counter(MESSAGES)


def test_logs_written_by_tasks_hold_the_order_and_repeat(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FILE_RECORDS", 16)
    frame = spark.createDataFrame(MESSAGES, L.MESSAGES)
    for _ in range(2):
        written = L.write_log(frame, str(tmp_path / "log"), ("ts", "note")).collect()
    assert sum(r["n"] for r in written) == len(MESSAGES) and max(r["n"] for r in written) == 16
    assert len(os.listdir(tmp_path / "log" / "device=2")) == 9
    assert _run(spark, tmp_path) == Counter(MESSAGES)
    batches = L._Reader(str(tmp_path / "log")).read(L._Records("2", 10, 50))
    assert [t for b in batches for t in b.column("ts").to_pylist()] == [m[1] for m in MESSAGES if m[0] == 2][10:50]


def test_capture_takes_notes_from_a_port_and_gone_records_are_an_error(tmp_path):
    port = [SimpleNamespace(type=t, note=60, velocity=1, channel=0) for t in ["note_on", "clock", "note_off"] * 30]
    ticks = iter(range(1000))
    log = L.PortLog(str(tmp_path / "log"), 4)
    assert log.capture(port, lambda: next(ticks) / 1000, most=8) == 60
    reader = L._Reader(str(tmp_path / "log"))
    assert reader.latestOffset() == {"4": 60} and L.PortLog(str(tmp_path / "log"), 4).end == 60
    with pytest.raises(ValueError, match="are gone"):
        list(reader.read(L._Records("4", 0, 61)))
    with pytest.raises(ValueError, match="messages are"):
        log.append([(0.0, "pitchwheel", 1, 1, 1)])
    assert L._Reader(str(tmp_path / "none")).latestOffset() == {}


def test_devices_share_reading_tasks_and_long_logs_are_split(tmp_path, monkeypatch):
    for d in range(300):
        L.PortLog(str(tmp_path / "log"), d).append([(float(i), "note_on", d % 128, 1, 0) for i in range(1 + (d == 7) * 99)])
    monkeypatch.setattr(L, "TASK_RECORDS", 40)
    reader = L._Reader(str(tmp_path / "log"))
    end = reader.latestOffset()
    shares = reader.partitions({"7": 5, "8": 1}, end)
    assert len(shares) < 15 and reader.partitions(end, end) == []
    rows = [(r["device"], r["ts"]) for s in shares for b in reader.read(s) for r in b.to_pylist()]
    assert sorted(rows) == sorted([(d, 0.0) for d in range(300) if d not in (7, 8)] + [(7, float(i)) for i in range(5, 100)])
