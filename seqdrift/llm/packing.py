"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import counted_rows, each_copy, groups_for, settle, small_batches

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 1 << 15
_CACHE_WORDS = 1 << 19
_LONG_WORD = 64
#: str.split() cuts at these; the tokenizer's white space does not include them.
_ODD_SPACES = re.compile("[\x1c-\x1f]")
_ENDINGS = frozenset(".,;:!?")
_LOADED: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones for themselves, and the
    others, in order, for the code points from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds(dict):
    """Word to ids, as little-endian 32-bit words; short words are remembered, up to a bound.

    A word of Latin letters, perhaps with one mark at its end, goes straight to the vocabulary's merge table; any other
    word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.marks = {m: self.whole(m) for m in _ENDINGS}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        mark = word[-1] if word[-1] in _ENDINGS else ""
        base = (word[:-1] if mark else word).lower()
        if base.isalpha() and max(base) < "\u0180" and is_normalized("NFC", word):
            raw = base if base.isascii() else base.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.merge(raw)]).tobytes()
            if mark:
                ids += self.marks[mark]
        else:
            ids = self.whole(word)
        if len(word) <= _LONG_WORD:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def encode_text(text: str | None, path: str) -> bytes:
    """A text's ids as little-endian 32-bit words.

    The tokenizer drops white space and never joins across it, so a text's ids are its white-space separated words' ids.
    A text with characters that only Python takes for white space is encoded whole.
    """
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    known = _LOADED[path]
    if not text:
        return b""
    if _ODD_SPACES.search(text):
        return known.whole(text)
    return b"".join(map(known.__getitem__, text.split()))


class SquareSums:
    """Open windows by fill level; each item goes where the sum of squared level counts grows least."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.next = window, 0
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of an item of 1 to ``window`` tokens. Full windows are not counted; ties take the fullest."""
        if length == self.window:
            self.next += 1
            return self.next - 1, 0
        levels = self.window - length + 1
        after = 2 * self.count[length:] + 1
        after[-1] = 0  # a full window is counted no more
        before = np.where(self.count[:levels] > 0, 1 - 2 * self.count[:levels], np.iinfo(np.int64).max // 2)
        before[0] = 0  # a new window comes from no level
        level = levels - 1 - int(np.argmin((after + before)[::-1]))
        if level:
            at = self.open[level].pop()
            self.count[level] -= 1
        else:
            level, at = 0, self.next
            self.next += 1
        fill = level + length
        if fill < self.window:
            self.open[fill].append(at)
            self.count[fill] += 1
        return at, level


def tokenise_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: whole windows from the start of a document, then what is left over."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = END_ID.to_bytes(4, "little")
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), ([], [], [], [], [])
            for doc_id, text in zip(ids, batch.column("text"), strict=True):
                data = encode_text(text.as_py(), path) + tail
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start : 4 * (start + window)]
                    for column, value in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack every document's ids, each followed by id 1, into windows of at most ``window`` ids.

    Documents are cut into whole windows and one rest. Pieces are dealt by a hash of their content into groups of about
    ``group_pieces`` and packed online, in hash order, group by group: a group leaves a few unfilled windows, so
    padding falls as groups grow. Only piece descriptions are shuffled, never ids.

    Null or empty text is the end id alone; repeated rows are packed as often as they come; an empty table gives no
    rows; other columns are ignored.
    """
    pieces = settle(tokenise_pieces(docs, path, window))
    groups = groups_for(pieces.count(), group_pieces)
    # Repeated rows may be any share of the table, so their number among equals has a part in where they go. Groups and
    # their order depend on the rows alone, not on how the table is split.
    key = F.xxhash64("doc_id", "start", "ids_crc32", "copy")
    dealt = each_copy(counted_rows(pieces)).select("*", key.alias("order")).withColumn("group", F.pmod(F.xxhash64("order"), F.lit(groups)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"], kind="stable", ignore_index=True)
        bins = SquareSums(window)
        places = [bins.place(n) for n in group["length"].tolist()]
        base = int(group["group"].iloc[0]) << 32
        group["sequence_id"] = [base + s for s, _ in places]
        group["offset"] = [o for _, o in places]
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("group").applyInPandas(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
