"""Live ports as a streaming source: ``spark.readStream.format("live_port").load(path)``.

A port cannot be asked again for what it sent, so each device's messages are first appended to a log of its own: files of
fixed-size records below ``device=<id>``, each named by the number of its first record and there whole or not at all. An
offset is a number of records a device, so a query that restarts from its checkpoint reads each message once, and a
micro-batch that failed reads the same ones again.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from seqdrift.sources.midi_files import open_folder, write_whole

MESSAGES = "device long, ts double, type string, note int, velocity int, channel int"
RECORD = np.dtype([("ts", "<f8"), ("type", "u1"), ("note", "u1"), ("velocity", "u1"), ("channel", "u1")])
TYPES = ("note_on", "note_off")
#: Records of a file written by ``write_log``, and records and devices of one reading task.
FILE_RECORDS, TASK_RECORDS, TASK_DEVICES = 1 << 16, 1 << 20, 2000
#: Rows of a record batch that a reading task hands on.
_BATCH = 1 << 16
_ROWS = pa.schema([("device", pa.int64()), ("ts", pa.float64()), ("type", pa.string()), ("note", pa.int32()), ("velocity", pa.int32()), ("channel", pa.int32())])


def _place(f: pafs.FileInfo) -> tuple[int, int]:
    """(first record, end) of a file."""
    first = int(f.base_name[:-4])
    return first, first + f.size // RECORD.itemsize


def _files(files: pafs.FileSystem, folder: str) -> list[tuple[int, int, str]]:
    """(first record, end, path) of a device's files in order."""
    found = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((*_place(f), f.path) for f in found if f.base_name.endswith(".log"))


def _packed(ts, kinds, notes, velocities, channels) -> np.ndarray:
    unknown = set(kinds) - set(TYPES)
    if unknown:
        raise ValueError(f"a port's messages are {TYPES}, not {sorted(map(str, unknown))}")
    out = np.empty(len(ts), RECORD)
    out["ts"], out["type"] = ts, [TYPES.index(k) for k in kinds]
    out["note"], out["velocity"], out["channel"] = notes, velocities, channels
    return out


class PortLog:
    """The log of one device, which one process writes."""

    def __init__(self, path: str, device: int) -> None:
        self.files, root = open_folder(path)
        self.folder = f"{root}/device={device}"
        self.files.create_dir(self.folder)
        self.end = max((end for _, end, _ in _files(self.files, self.folder)), default=0)

    def append(self, messages: list[tuple[float, str, int, int, int]]) -> None:
        """(ts, type, note, velocity, channel) messages, visible at once."""
        if messages:
            write_whole(self.files, f"{self.folder}/{self.end:020d}.log", _packed(*zip(*messages, strict=True)).tobytes())
            self.end += len(messages)

    def capture(self, port: Iterable, clock: Callable[[], float], most: int = 64, seconds: float = 0.05) -> int:
        """Append what a port yields (objects with type, note, velocity, channel) until it ends; other messages are
        passed over. A file takes up to ``most`` messages or ``seconds``. Returns the number of messages."""
        held, began = [], self.end
        for m in port:
            if m.type not in TYPES:
                continue
            held.append((clock(), m.type, m.note, m.velocity, m.channel))
            if len(held) >= most or held[-1][0] - held[0][0] >= seconds:
                self.append(held)
                held = []
        self.append(held)
        return self.end - began


def write_log(messages: DataFrame, path: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Logs of messages (device, ts, type, note, velocity, channel), in files of at most ``FILE_RECORDS``; returns
    (device, first, n) of the files, and writes them as the rows are asked for. ``order`` is total within a device.

    A task writes the files of many devices, one after another. A repeated task writes the same files again.
    """

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(path)
        held, made = [], None
        done: list[tuple[int, int, int]] = []

        def save() -> None:
            nonlocal made
            rows = pa.Table.from_batches(held)
            device, first = rows.column("device")[0].as_py(), rows.column("place_")[0].as_py()
            if device != made:
                files.create_dir(f"{root}/device={device}")
                made = device
            columns = (rows.column(c).to_pylist() for c in ("ts", "type", "note", "velocity", "channel"))
            write_whole(files, f"{root}/device={device}/{first:020d}.log", _packed(*columns).tobytes())
            done.append((device, first, rows.num_rows))
            held.clear()

        at = None
        for frame in frames:
            device, file = frame.column("device").to_numpy(), frame.column("place_").to_numpy() // FILE_RECORDS
            cuts = np.flatnonzero((np.diff(device) != 0) | (np.diff(file) != 0)) + 1
            for low, high in itertools.pairwise([0, *cuts.tolist(), frame.num_rows]):
                if held and (device[low], file[low]) != at:
                    save()
                if high > low:
                    at = (device[low], file[low])
                    held.append(frame.slice(low, high - low))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)] or [pa.array([], pa.int64())] * 3, names=["device", "first", "n"])
            done.clear()
        if held:
            save()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], names=["device", "first", "n"])

    place = (F.row_number().over(Window.partitionBy("device").orderBy(*order)) - 1).cast("long")
    placed = messages.withColumn("place_", place).select(*[f.split()[0] for f in MESSAGES.split(", ")], "place_")
    dealt = placed.repartition("device", F.floor(F.col("place_") / FILE_RECORDS)).sortWithinPartitions("device", "place_")
    return dealt.mapInArrow(write, "device long, first long, n long")


@dataclass
class _Records(InputPartition):
    device: str
    start: int
    end: int


@dataclass
class _Share(InputPartition):
    """Records of several devices, for one task."""

    records: list[_Records]


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = open_folder(self.path)
        ends: dict[str, int] = {}
        for f in files.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):  # one listing, however many devices
            folder = f.path.rpartition("/")[0].rpartition("/")[2]
            if f.base_name.endswith(".log") and folder.startswith("device="):
                ends[folder[7:]] = max(ends.get(folder[7:], 0), _place(f)[1])
        return {d: n for d, n in sorted(ends.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        cuts = [(d, low, stop) for d, stop in end.items() for low in range(start.get(d, 0), stop, TASK_RECORDS)]
        shares: list[_Share] = []
        room = 0
        for d, low, stop in cuts:
            piece = _Records(d, low, min(low + TASK_RECORDS, stop))
            if not shares or room < piece.end - piece.start or len(shares[-1].records) == TASK_DEVICES:
                shares.append(_Share([]))
                room = TASK_RECORDS
            shares[-1].records.append(piece)
            room -= piece.end - piece.start
        return list(shares)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(self.path)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for piece in partition.records if isinstance(partition, _Share) else [partition]:
            for records in _stored(files, root, piece):
                held.append((int(piece.device), records))
                size += len(records)
                if size >= _BATCH:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _stored(files: pafs.FileSystem, root: str, piece: _Records) -> Iterator[np.ndarray]:
    """The records of a piece, file by file."""
    there = _files(files, f"{root}/device={piece.device}")
    at = piece.start
    for first, end, path in there[max(bisect.bisect_right(there, (at, float("inf"), "")) - 1, 0) :]:
        if first > at or at >= piece.end:
            break
        with files.open_input_file(path) as f:
            f.seek((at - first) * RECORD.itemsize)
            yield np.frombuffer(f.read((min(end, piece.end) - at) * RECORD.itemsize), RECORD)
        at = min(end, piece.end)
    if at < piece.end:
        raise ValueError(f"records {at} to {piece.end} of device {piece.device} are gone")


def _batch(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    records = np.concatenate([r for _, r in held])
    devices = np.repeat([d for d, _ in held], [len(r) for _, r in held])
    columns = [devices, records["ts"], np.array(TYPES, object)[records["type"]], *(records[c].astype(np.int32) for c in ("note", "velocity", "channel"))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


class LivePort(DataSource):
    """Options: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "live_port"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LivePort)
