"""MIDI files as a data source: ``spark.read.format("midi_files")`` and ``df.write.format("midi_files")``.

Rows to write are (seq_id, content), as ``io.encode_midi`` gives them; each becomes a file with a track an instrument. Every
attempt of a task writes to a folder of its own, and an entry in ``_log`` names the folders of the attempts that won. So
readers see a whole write or nothing of it, lost executors and repeated tasks leave nothing that is read, and no file is
moved. An overwriting entry hides what came before; hidden files stay until ``vacuum``. The folder may be any that pyarrow
can open.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from seqdrift.sources.io import parse_midi

MESSAGES = "path string, seq_id long, msg_idx int, delta double, type string, channel int, note int, velocity int, program int"
_ROWS = pa.schema(
    [("path", pa.string()), ("seq_id", pa.int64()), ("msg_idx", pa.int32()), ("delta", pa.float64()), ("type", pa.string())]
    + [(c, pa.int32()) for c in ("channel", "note", "velocity", "program")]
)
#: What one reading task takes at most, unless a single file is larger.
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 5000
_BATCH = 20_000


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_whole(files: pafs.FileSystem, path: str, content: bytes) -> None:
    """A file that is there whole or not at all."""
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        out.write(content)
    files.move(draft, path)


def _entries(files: pafs.FileSystem, root: str) -> list[dict]:
    found = files.get_file_info(pafs.FileSelector(f"{root}/_log", allow_not_found=True))
    return [json.loads(files.open_input_stream(f.path).read()) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json")]


def _visible(entries: list[dict]) -> list[dict]:
    start = max((i for i, e in enumerate(entries) if e["overwrite"]), default=0)
    return [folder for e in entries[start:] for folder in e["folders"]]


@dataclass
class _Share(InputPartition):
    """Every ``of``-th file of a folder."""

    folder: str
    nth: int
    of: int


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = open_folder(self.path)
        entries = _entries(files, root)
        if not entries:
            raise ValueError(f"no MIDI files were committed to {self.path}")
        shares: list[InputPartition] = []
        for f in _visible(entries):
            of = max(1, -(-f["bytes"] // PARTITION_BYTES), -(-f["files"] // PARTITION_FILES))
            shares += [_Share(f["folder"], i, of) for i in range(of)]
        return shares or [_Share("", 0, 1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.folder:
            return
        files, root = open_folder(self.path)
        names = sorted(f.path for f in files.get_file_info(pafs.FileSelector(f"{root}/{partition.folder}")))
        rows: list[tuple] = []
        for name in names[partition.nth :: partition.of]:
            with files.open_input_stream(name) as stream:
                messages = parse_midi(stream.read())
            short = name[len(root) + 1 :]
            seq_id = int(short.rpartition("/")[2].rpartition("-")[0])
            for i, message in enumerate(messages):
                rows.append((short, seq_id, i, *message))
                if len(rows) == _BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = open_folder(self.path)
        done = _Written(f"part-{uuid.uuid4().hex}", 0, 0)
        for batch in iterator:
            for seq_id, content in zip(batch.column("seq_id").to_pylist(), batch.column("content"), strict=True):
                if seq_id is None or not content.is_valid:
                    raise ValueError("a MIDI file needs a seq_id and content")
                if done.files == 0:
                    files.create_dir(f"{root}/{done.folder}")
                data = content.as_buffer()
                with files.open_output_stream(f"{root}/{done.folder}/{seq_id}-{done.files}.mid") as out:
                    out.write(data)
                done.files, done.bytes = done.files + 1, done.bytes + data.size
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = open_folder(self.path)
        folders = [{"folder": m.folder, "files": m.files, "bytes": m.bytes} for m in messages if m is not None and m.files]
        files.create_dir(f"{root}/_log")
        write_whole(files, f"{root}/_log/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps({"overwrite": self.overwrite, "folders": folders}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Delete what the tasks that finished have written; what a broken one left is never read."""
        files, root = open_folder(self.path)
        for m in messages:
            if m is not None and m.files:
                files.delete_dir(f"{root}/{m.folder}")


class MidiFiles(DataSource):
    """Options: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "midi_files"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"seq_id", "content"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"rows to write lack {sorted(missing)}")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MidiFiles)


def vacuum(path: str) -> int:
    """Delete folders that no entry in force names; for when nothing reads or writes. Returns how many."""
    files, root = open_folder(path)
    kept = {f["folder"] for f in _visible(_entries(files, root))}
    gone = [f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("part-") and f.base_name not in kept]
    for folder in gone:
        files.delete_dir(folder)
    return len(gone)
