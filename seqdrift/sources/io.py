"""Sources and sinks."""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.functions import tokens as T


def split_scan(spark: SparkSession, path: str, split: str, num_samples: int | None = None, order: str = "seq_id") -> DataFrame:
    """Rows of one split of a table partitioned by ``split``; an unknown split raises and names those there are."""
    df = spark.read.parquet(path)
    splits = sorted(r[0] for r in df.select("split").distinct().collect())
    if split not in splits:
        raise ValueError(f"split {split!r} is not one of {splits}")
    rows = df.where(F.col("split") == split)
    return rows.orderBy(order).limit(num_samples) if num_samples is not None else rows


def prepare(sequences: DataFrame, split_io: bool = False, velocity: bool = False, strict: bool = True) -> DataFrame:
    """(seq_id, input_ids, output_ids): velocities stripped, a leading AR, one instrument or an input/output pair.

    ``strict`` fails on the first invalid sequence; otherwise those are left out (count them with ``count_invalid``).
    """
    ids = sequences.withColumn("tokens", T.force_ar(F.col("tokens") if velocity else T.strip_velocity(F.col("tokens"))))
    ids = ids.withColumn("tokens", T.require_valid(F.col("tokens"), velocity)) if strict else ids.where(T.invalid_reason(F.col("tokens"), velocity).isNull())
    if split_io:
        return ids.select("seq_id", T.filter_instrument(F.col("tokens"), 0, velocity).alias("input_ids"), T.filter_instrument(F.col("tokens"), 1, velocity).alias("output_ids"))
    return ids.select("seq_id", T.set_instrument(F.col("tokens"), 0).alias("input_ids"), F.lit(None).cast("array<int>").alias("output_ids"))


def count_invalid(sequences: DataFrame, velocity: bool = False) -> DataFrame:
    reason = T.invalid_reason(F.col("tokens"), velocity)
    return sequences.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def text_scan(spark: SparkSession, path: str, num_samples: int | None = None) -> DataFrame:
    """(seq_id, input_ids, labels) from lines of space-separated tokens; blank lines are dropped, all lines validated."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("seq_id", F.monotonically_increasing_id())
    ids = lines.select("seq_id", T.require_valid(T.parse_tokens(F.col("value"))).alias("input_ids")).withColumn("labels", F.col("input_ids"))
    return ids.orderBy("seq_id").limit(num_samples) if num_samples is not None else ids


def collate(sequences: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Right-pad each batch's input_ids to its longest; ``length`` keeps the true size."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    sized = sequences.withColumns({"length": F.size("input_ids"), "longest_": longest})
    return sized.withColumn("input_ids", T.pad_right(F.col("input_ids"), F.col("longest_"))).drop("longest_")


def split_probe(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.min("seq_id").alias("first_id"))


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """(msg_idx, ts, type, note, velocity, channel) of a JSON recording."""
    from seqdrift.vocab import RECORDING

    raw = spark.read.schema(RECORDING).option("multiLine", True).json(path)
    return raw.select(F.posexplode("messages").alias("msg_idx", "m")).select("msg_idx", F.col("m.timestamp").alias("ts"), "m.type", "m.note", "m.velocity", "m.channel")


def write_recordings(messages: DataFrame, path: str, key: str = "seq_id") -> None:
    """One JSON document a ``key``, with its messages in order of (ts, msg_idx); documents are dealt over the files."""
    message = F.struct(F.col("ts").alias("timestamp"), "msg_idx", "type", "note", "velocity", "channel")
    one = messages.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("r"))
    cleaned = F.transform("r", lambda r: F.struct(r["timestamp"].alias("timestamp"), r["type"].alias("type"), r["note"].alias("note"), r["velocity"].alias("velocity"), r["channel"].alias("channel")))
    one.select(key, cleaned.alias("messages")).write.mode("overwrite").json(path)


def read_recordings(spark: SparkSession, path: str, key: str = "seq_id") -> DataFrame:
    """(key, msg_idx, ts, type, note, velocity, channel) of what ``write_recordings`` wrote."""
    from pyspark.sql import types as T

    from seqdrift.vocab import RECORDING

    shape = T.StructType([T.StructField(key, T.LongType()), *(T.StructType.fromDDL(RECORDING) if isinstance(RECORDING, str) else RECORDING).fields])
    raw = spark.read.schema(shape).json(path)
    return raw.select(key, F.posexplode("messages").alias("msg_idx", "m")).select(key, "msg_idx", F.col("m.timestamp").alias("ts"), "m.type", "m.note", "m.velocity", "m.channel")


def write_recording(messages: DataFrame, path: str) -> None:
    """One JSON document with the messages in order: a single session, which one reader takes whole."""
    write_recordings(messages.withColumn("session_", F.lit(0)), path, "session_")


class EmbeddingCache:
    """Embeddings (sample_id, layer, emb) by dataset, pool and version; ``version`` is a hash the caller takes of the data
    and model, so that a changed input is never served an old table.

    A write goes to a folder of its own, with a partition a layer, and becomes visible by one row of the manifest, all
    its layers at once. A write that fails before that row leaves nothing that a reader sees. The newest row that has a
    layer of a key gives it, so writing a key again replaces it. Reading is a hit only if all layers are there.
    """

    MANIFEST = "dataset string, pool string, version string, layers array<int>, run string, at long"
    ROWS = "sample_id long, emb array<double>, layer int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.memo = spark, path, {}

    def write(self, embeddings: DataFrame, dataset: str, pool: str, version: str = "0") -> None:
        run = uuid.uuid4().hex
        rows = embeddings.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("emb").cast("array<double>").alias("emb"), F.col("layer").cast("int").alias("layer"))
        rows.write.partitionBy("layer").parquet(self._data(run))
        layers = [r["layer"] for r in self._rows(run).select("layer").distinct().orderBy("layer").collect()]
        self._commit(dataset, pool, version, layers, run)
        for key in [k for k in self.memo if k[:3] == (dataset, pool, version)]:
            self.memo.pop(key).unpersist()

    def _data(self, run: str) -> str:
        return f"{self.path}/data/{run}"

    def _rows(self, run: str) -> DataFrame:
        return self.spark.read.schema(self.ROWS).parquet(self._data(run))

    def _commit(self, dataset: str, pool: str, version: str, layers: list[int], run: str) -> None:
        entry = self.spark.createDataFrame([(dataset, pool, version, layers, run, time.time_ns())], self.MANIFEST)
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def entries(self) -> DataFrame:
        """The manifest: a row a committed write, the newest of each key and layer being the one in force."""
        try:
            return self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.MANIFEST)

    def read(self, dataset: str, pool: str, layers: list[int], version: str = "0") -> DataFrame | None:
        key = (dataset, pool, version, tuple(sorted(set(layers))))
        if key in self.memo:
            return self.memo[key]
        mine = self.entries().where((F.col("dataset") == dataset) & (F.col("pool") == pool) & (F.col("version") == version))
        newest = mine.select(F.explode("layers").alias("layer"), "run", "at").groupBy("layer").agg(F.max_by("run", F.struct("at", "run")).alias("run"))
        runs: dict[str, list[int]] = {}
        for r in newest.where(F.col("layer").isin(list(key[3]))).collect():
            runs.setdefault(r["run"], []).append(r["layer"])
        if sum(map(len, runs.values())) < len(key[3]):
            return None
        parts = [self._rows(run).where(F.col("layer").isin(there)) for run, there in sorted(runs.items())]
        self.memo[key] = reduce(DataFrame.unionByName, parts).select("sample_id", "layer", "emb").persist()
        return self.memo[key]

    def forget(self) -> None:
        """Let go of what is held in memory; files stay."""
        for df in self.memo.values():
            df.unpersist()
        self.memo.clear()

    def clear(self) -> None:
        """Empty the cache: the manifest first, so that no reader meets half of it, then every write that it named.

        Tables are overwritten with none of their rows; nothing else below the path is touched.
        """
        self.forget()
        runs = [r["run"] for r in self.entries().select("run").distinct().collect()]
        self.spark.createDataFrame([], self.MANIFEST).write.mode("overwrite").parquet(f"{self.path}/manifest")
        for run in runs:
            self.spark.createDataFrame([], self.ROWS).write.mode("overwrite").parquet(self._data(run))


def append_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("append").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Experiment records, from a JSON list or from appended lines; broken records are dropped."""
    ddl = "transformations string, scoring_function string, confusion_matrix array<array<bigint>>, true_positive_rate double, false_positive_rate double, auroc double"
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.regexp_replace(F.regexp_replace("value", r"\s+$", ""), r"\n+", ","), F.lit("]"))), f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in ddl.split(', '))}>>")).alias("r"))
    return lines.select("r.*").where("auroc is not null")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def grid_selection(df: DataFrame, step: int, most: int, order: str = "seq_id") -> DataFrame:
    """Every ``step``-th row in order, at most ``most`` of them."""
    # The rows asked for are among the first step * most, so only those are ever numbered.
    first = df.orderBy(order).limit(step * most)
    numbered = first.withColumn("at_", F.row_number().over(Window.orderBy(order)) - 1)
    return numbered.where(F.col("at_") % step == 0).orderBy("at_").limit(most).drop("at_")


# Standard MIDI files.


def _variable(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value = (value << 7) | (data[at] & 0x7F)
        at += 1
        if not data[at - 1] & 0x80:
            return value, at


def parse_midi(data: bytes) -> list[tuple[float, str, int | None, int | None, int | None, int | None]]:
    """(delta seconds, type, channel, note, velocity, program) of all tracks, merged by time."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    header, _, tracks, division = struct.unpack(">IHHH", data[4:14])
    at, events = 8 + header, []
    for track in range(tracks):
        size = struct.unpack(">I", data[at + 4 : at + 8])[0]
        at, end = at + 8, at + 8 + size
        tick, running = 0, 0
        while at < end:
            delta, at = _variable(data, at)
            tick += delta
            status = data[at]
            if status & 0x80:
                at += 1
            else:
                status = running
            if status == 0xFF:
                kind = data[at]
                length, at = _variable(data, at + 1)
                if kind == 0x51:
                    events.append((tick, track, len(events), "set_tempo", None, int.from_bytes(data[at : at + length], "big"), None, None))
                at += length
            elif status in (0xF0, 0xF7):
                length, at = _variable(data, at)
                at += length
            else:
                running, high, channel = status, status & 0xF0, status & 0x0F
                if high in (0xC0, 0xD0):
                    if high == 0xC0:
                        events.append((tick, track, len(events), "program_change", channel, None, None, data[at]))
                    at += 1
                else:
                    if high in (0x80, 0x90):
                        events.append((tick, track, len(events), "note_on" if high == 0x90 else "note_off", channel, data[at], data[at + 1], None))
                    at += 2
        at = end
    out, last, tempo = [], 0, 500_000
    pending = 0.0
    for tick, _, _, kind, channel, note, velocity, program in sorted(events, key=lambda e: e[:3]):
        pending += (tick - last) * tempo / 1e6 / division
        last = tick
        if kind == "set_tempo":
            tempo = note
            continue
        out.append((pending, kind, channel, note, velocity, program))
        pending = 0.0
    return out


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, path, msg_idx, delta, type, channel, note, velocity, program) of MIDI files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, i, *m) for i, m in enumerate(parse_midi(bytes(content)))]
                yield pd.DataFrame(rows, columns=["path", "msg_idx", "delta", "type", "channel", "note", "velocity", "program"]).astype({c: "Int32" for c in ("channel", "note", "velocity", "program")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parsed = files.mapInPandas(run, "path string, msg_idx int, delta double, type string, channel int, note int, velocity int, program int")
    return parsed.withColumn("seq_id", F.xxhash64("path"))


def _varlen(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append((value & 0x7F) | 0x80)
    return bytes(reversed(out))


def midi_bytes(rows: Iterable[tuple[int, int, int, str, int, int]]) -> bytes:
    """A MIDI file from (instrument, channel, delta ticks, type, pitch, velocity) rows, one track an instrument, with a
    hundred ticks a second."""
    tracks: dict[int, bytearray] = {}
    for instrument, channel, delta, kind, pitch, velocity in rows:
        if instrument not in tracks:
            tracks[instrument] = bytearray() if instrument == V.DRUMS else bytearray(b"\x00" + bytes([0xC0 | channel, instrument]))
        tracks[instrument] += _varlen(delta) + bytes([(0x90 if kind == "note_on" else 0x80) | channel, pitch, velocity])
    out = bytearray(b"MThd" + struct.pack(">IHHH", 6, 1, max(len(tracks), 1), 50))
    for body in tracks.values() or [bytearray()]:
        body += b"\x00\xff\x2f\x00"
        out += b"MTrk" + struct.pack(">I", len(body)) + body
    return bytes(out)


#: Files that a task hands on at once, unless a single one is larger.
_CONTENT_BYTES = 4 << 20


def encode_midi(messages: DataFrame) -> DataFrame:
    """(seq_id, content): MIDI files of ``to_messages`` rows.

    Sequences are dealt over as many tasks as the session shuffles to: by size alone, Spark would join the few bytes of
    many files to one task. Each task encodes sorted rows as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        ids, contents, size = [], [], 0
        for seq_id, group in groupby(rows, itemgetter(0)):
            ids.append(seq_id)
            contents.append(midi_bytes(row[1:] for row in group))
            size += len(contents[-1])
            if size >= _CONTENT_BYTES:
                yield _files(ids, contents)
                ids, contents, size = [], [], 0
        yield _files(ids, contents)

    chosen = messages.select("seq_id", "instr", "channel", "delta", "type", "pitch", "velocity", "msg_idx")
    # By a hash of its own: where rows lie by seq_id already, Spark leaves out a repartition by it, and its number.
    dealt = chosen.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("seq_id")).sortWithinPartitions("seq_id", "instr", "msg_idx")
    return dealt.drop("msg_idx").mapInArrow(run, "seq_id long, content binary")


def _files(ids: list[int | None], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary())], names=["seq_id", "content"])


def write_parameters(spark: SparkSession, parameters: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(parameters),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
