"""Byte-level BPE through a table of distinct words, and decoding through a join of ids with their pieces."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqdrift.llm.common import settle, settle_bucketed, shuffle_width, small_batches
from seqdrift.llm.packing import _byte_letters

#: Characters of text that share one list of words; a longer text has a list of its own.
CHUNK_CHARS = 1 << 24
#: Words of one bucket of the table, by count over all chunks; buckets never number more than ``MOST_BUCKETS``.
BUCKET_WORDS = 1 << 20
MOST_BUCKETS = 4096
#: Words that a task remembers. A bucket with more distinct ones encodes some again, which changes no id.
KNOWN_WORDS = 1 << 20
#: Words whose ids and text are put together at a time: some megabytes of indices.
SLICE = 1 << 17

_WORD = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space that one Unicode version may know and another not.
_ODD = re.compile(r"[^\S \t\n\r]")
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def split_words(text: str) -> list[str]:
    """Pieces of the text that are encoded alike alone and in place.

    The pre-tokenizer's pattern has no alternative that goes on to white space after anything else, and looks at nothing
    before a match, so a text may be cut wherever white space follows another character.
    """
    return _CUT.split(text) if _ODD.search(text) else _WORD.findall(text)


class _Places(dict):
    """Word to its place in the list; a new word goes to the end."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _compressed(data: bytes) -> bytes:
    """Compressed with a window of 16 MB, which meets a chunk's copies again."""
    how = zstandard.ZstdCompressionParameters.from_level(3, enable_ldm=True, window_log=24)
    return zstandard.ZstdCompressor(compression_params=how).compress(data)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte plane by byte plane, compressed."""
    return _compressed(np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def _before(sizes: np.ndarray) -> np.ndarray:
    """Where each stretch begins, and where the last one ends."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))


def packed_words(words: list[str]) -> tuple[bytes, bytes]:
    """(sizes, bytes) of the words."""
    raw = [w.encode() for w in words]
    return packed(np.fromiter(map(len, raw), np.int64, len(raw))), _compressed(b"".join(raw))


def unpacked_words(sizes: bytes, data: bytes) -> list[str]:
    ends, raw = _before(unpacked(sizes)).tolist(), zstandard.decompress(data)
    return [raw[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)]


#: A chunk: its distinct words, and for each document how many words it has and their places among those.
CHUNK = "chunk long, n_words long, word_sizes binary, words binary, doc_ids array<long>, sizes binary, places binary"
#: Words of a bucket that a chunk has, and their places in the chunk's list.
DEALT = "bucket int, chunk long, at binary, word_sizes binary, words binary"
#: Their ids, and which ids those are.
PART = "chunk long, at binary, sizes binary, ids binary, used array<int>"


def _split(chunk_chars: int):
    """Documents to chunks: the distinct words, and for each document its words' places among them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, sizes, places, chars = _Places(), [], [], [], 0

        def chunk() -> pa.RecordBatch:
            columns = (
                pa.array([uuid.uuid4().int >> 65], pa.int64()),
                pa.array([len(known)], pa.int64()),
                *(pa.array([c], pa.binary()) for c in packed_words(list(known))),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([packed(np.array(sizes, np.int64))], pa.binary()),
                pa.array([packed(np.concatenate(places) if places else np.empty(0))], pa.binary()),
            )
            return pa.RecordBatch.from_arrays(list(columns), names=["chunk", "n_words", "word_sizes", "words", "doc_ids", "sizes", "places"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = split_words(text.as_py() or "")
                ids.append(doc_id)
                sizes.append(len(words))
                places.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                chars += sum(map(len, words))
                if chars >= chunk_chars:
                    yield chunk()
                    known, ids, sizes, places, chars = _Places(), [], [], [], 0
        if ids:
            yield chunk()

    return split


def _deal(buckets: int):
    """Chunks to buckets: the words of each bucket, and where they stand in the chunk's list."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "word_sizes", "words")), strict=True):
                words = unpacked_words(sizes, data)
                bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int32, len(words))
                order = np.argsort(bucket, kind="stable")
                there, first = np.unique(bucket[order], return_index=True)
                at = np.split(order, first[1:])
                mine = [packed_words([words[i] for i in a.tolist()]) for a in at] if len(there) else []
                columns = (
                    pa.array(there, pa.int32()),
                    pa.array(np.full(len(there), chunk), pa.int64()),
                    pa.array([packed(np.diff(a, prepend=0)) for a in at] if len(there) else [], pa.binary()),
                    pa.array([m[0] for m in mine], pa.binary()),
                    pa.array([m[1] for m in mine], pa.binary()),
                )
                yield pa.RecordBatch.from_arrays(list(columns), names=["bucket", "chunk", "at", "word_sizes", "words"])

    return deal


def _encode(path: str, known_words: int = KNOWN_WORDS):
    """Each distinct word of a bucket to its ids, once; the ids go back to every chunk that has the word."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        tokenizer, known = _tokenizer(path), {}
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for chunk, at, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "at", "word_sizes", "words")), strict=True):
                words = unpacked_words(sizes, data)
                if len(known) > known_words:
                    known.clear()
                new = [w for w in words if w not in known]
                for word, found in zip(new, tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                    known[word] = np.array(found.ids, "<u4").tobytes()
                ids = [known[w] for w in words]
                flat = np.frombuffer(b"".join(ids), "<u4")
                sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
                for column, value in zip(rows, (chunk, at, packed(sizes), packed(flat), np.unique(flat)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["chunk", "at", "sizes", "ids", "used"])

    return encode


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all elements of the stretches, one after another; where each stretch begins among them)."""
    ends = _before(sizes)
    at = np.repeat(starts - ends[:-1], sizes)
    at += np.arange(ends[-1])
    return at, ends


def _assemble(slice_words: int):
    """Chunks with their words' ids and the ids' pieces to documents with their ids and the text of these, by position."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                parts = [(np.cumsum(unpacked(p["at"]), dtype=np.int64), unpacked(p["sizes"]), unpacked(p["ids"])) for p in row["parts"] or []]
                at, size, ids = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))
                word_size, word_start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                word_size[at], word_start[at] = size, _before(size)[:-1]
                pieces = sorted((p["id"], p["piece"]) for p in row["pieces"] or [])
                slot = np.zeros(max((i for i, _ in pieces), default=-1) + 1, np.int64)
                slot[[i for i, _ in pieces]] = np.arange(len(pieces))
                piece_ends = _before(np.array([len(p) for _, p in pieces], np.int64))
                letters = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
                places, bounds = unpacked(row["places"]), _before(unpacked(row["sizes"]))
                low = 0
                while low < len(row["doc_ids"]):
                    high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + slice_words, side="right")) - 1)
                    here = places[bounds[low] : bounds[high]]
                    take, ends = _ragged(word_start[here], word_size[here])
                    offsets, tokens = ends[bounds[low : high + 1] - bounds[low]], ids[take]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens, pa.int32()))
                    mine = slot[tokens]
                    take, ends = _ragged(piece_ends[mine], piece_ends[mine + 1] - piece_ends[mine])
                    data, cuts = letters[take].tobytes(), ends[offsets].tolist()
                    decoded = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][low:high], pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
                    low = high

    return assemble


def encode_documents(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, bucket_words: int = BUCKET_WORDS, known_words: int = KNOWN_WORDS, slice_words: int = SLICE) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of the whole text as the tokenizer at ``path`` gives them without
    special tokens, and the text that these ids stand for.

    Texts are split into words once. Each chunk of documents keeps its distinct words and, as one compressed list, its
    documents' words by place; only distinct words are dealt, by hash, into the buckets of the word table. There each is
    encoded once, and its ids go back to the chunks that have it, to be put together by position. A very common word
    comes once a chunk, so no bucket grows with a word's frequency, and neither texts nor places are shuffled: chunks lie
    in buckets, to which the ids come. To decode, the ids that
    a chunk has are joined with the vocabulary's pieces, and each document's ids are looked up in what the join gave.
    The tokenizer must be byte-level, with no normalizer and no added prefix space.

    A null or empty text has no ids; repeated rows come as often as they are there; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = settle_bucketed(chosen.mapInArrow(_split(chunk_chars), CHUNK), shuffle_width(spark), "chunk")
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(shuffle_width(spark), words // bucket_words))
    dealt = chunks.select("chunk", "word_sizes", "words").mapInArrow(_deal(buckets), DEALT)
    encoded = settle(dealt.repartition(buckets, "bucket").mapInArrow(_encode(path, known_words), PART))
    parts = encoded.groupBy("chunk").agg(F.collect_list(F.struct("at", "sizes", "ids")).alias("parts"))
    used = encoded.groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))
    pieces = used.select("chunk", F.explode("used").alias("id")).join(F.broadcast(id_pieces(spark, path)), "id").groupBy("chunk").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))
    whole = chunks.select("chunk", "doc_ids", "sizes", "places").join(parts, "chunk", "left").join(pieces, "chunk", "left")
    return whole.mapInArrow(_assemble(slice_words), "doc_id long, ids array<int>, decoded string")


def id_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the whole vocabulary, pieces as bytes: as many rows as the vocabulary has, whatever the corpus."""
    tokenizer = _tokenizer(path)
    byte_of = {chr(b): b for b in range(256)} | {letter: b for b, letter in _byte_letters().items()}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    rows = [(i, bytearray(added[i].encode()) if i in added else bytearray(byte_of[c] for c in piece)) for piece, i in tokenizer.get_vocab().items()]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(row, decoded): the table's columns but ``ids``, in a struct, and the text of its ``ids``.

    Ids are exploded and joined with the broadcast vocabulary; both keep the order of rows inside a task, so a row's
    pieces arrive one after another, and their bytes are cut out of the batch as they stand. Nothing is shuffled. The
    row itself travels with its first id only. An id that the vocabulary does not have is left out, as the library
    does; null or no ids give the empty text; bytes that are no UTF-8 become U+FFFD.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != "ids"])
    each = encoded.select(others.alias("row"), "ids").select("row", F.posexplode_outer("ids").alias("pos", "id"))
    each = each.select(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("row")).alias("row"), (F.coalesce("pos", F.lit(0)) == 0).alias("first"), "id")
    pieces = each.join(F.broadcast(id_pieces(encoded.sparkSession, path)), "id", "left").select("row", "first", F.coalesce("piece", F.lit(b"")).alias("piece"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = None, []

        def texts(rows: pa.Array, data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows, pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], names=["row", "decoded"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            piece = batch.column("piece").cast(pa.large_binary())
            offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
            data = memoryview(piece.buffers()[2] or b"")
            cuts = np.append(starts, len(piece))
            held.append(bytes(data[offsets[0] : offsets[cuts[0]]]))
            if len(starts):
                if row is not None:
                    yield texts(row, [b"".join(held)])
                if len(starts) > 1:
                    rows = batch.column("row").take(pa.array(starts[:-1]))
                    yield texts(rows, [bytes(data[offsets[a] : offsets[b]]) for a, b in zip(cuts[:-2], cuts[1:-1], strict=True)])
                row = batch.column("row").take(pa.array(starts[-1:]))
                held = [bytes(data[offsets[cuts[-2]] : offsets[cuts[-1]]])]
        if row is not None:
            yield texts(row, [b"".join(held)])

    schema = pieces.select("row").schema.add("decoded", "string")
    return pieces.mapInArrow(gather, schema)
