"""Substring dedup by relative Lempel-Ziv factors over a content-addressed reference index.

The reference is the corpus itself. A window of ``width`` words is anchored at the least hash of its runs of ``GRAM``
words (leftmost on ties), and the windows of one anchor occurrence are a phrase: equal stretches are cut into equal
phrases. The reference's phrases are indexed in blocks, the shuffle partitions, which an anchor names: a document asks
exactly the blocks that can hold its phrases, all of them, without being paired with every block.

The index keeps two places of every phrase that occurs twice (the first and the last in an order of documents by hash). A
document is parsed greedily from left to right: a factor starts with a phrase and one of its other places, goes on as
long as the next phrase has a place side by side with the last, and the longer one is taken. All windows inside a factor
start elsewhere too, so a factor has at least ``width`` words and all of them are removed. At factor boundaries (an edit,
or the edge of a copied passage) phrases differ although they share an anchor, and there window by window is looked up.
What is removed is the union of the factors and of those boundary windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import NULL_ID, discard, keyed_texts, release, settle, small_batches, split_by_keys
from seqdrift.llm.text import U, Words, join, mix, run_hashes, words_of

WIDTH = 35
GRAM = 8
#: Words of a text that its places in the index tell apart.
_PLACES = 1 << 24


def _sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """Index of the least of each ``span`` consecutive values, leftmost on ties, by doubling."""
    best, size = np.arange(len(values)), 1
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[left] <= values[right], left, right)
        size += step
    return best


def phrases(words: Words, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor, digest) of each phrase; window numbers count words of the chunk."""
    n = len(words.hash)
    row = words.row_of()
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none, none.view(U), none.view(U)
    at, grams = words.windows(gram, 3)
    values = np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    values[at] = grams
    anchor = _sliding_least(values, width - gram + 1)[: n - width + 1]
    start = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    if not len(start):
        return none, none, none, none.view(U), none.view(U)
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    low, high, anchor = start[first], start[last], anchor[first]
    # A phrase's first and last window overlap, so together they hold all of it.
    whole = run_hashes(words.hash, width, 21)
    digest = mix(join(whole[low], whole[high]) ^ ((high - low) * 64 + (anchor - low)).astype(U), 5)
    return row[low], low, high, values[anchor], digest


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text")):
                a, n = np.unique(phrases(words, width, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], names=["a", "n"])

    return run


def _phrase_rows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "h"))
            for words in words_of(batch.column("text")):
                row, low, high, a, d = phrases(words, width, gram)
                base = words.bounds[row]
                columns = (a.view(np.int64), d.view(np.int64), k[words.first + row], h[words.first + row], (low - base).astype(np.int32), (high - base).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "d", "k", "h", "lo", "hi"])

    return run


def _window_rows(width: int):
    """Two hashes of each window in the listed ranges of a document; ``n`` is how often its phrase occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "h"))
            lists = batch.column("ranges")
            flat = lists.flatten()
            lo, hi, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi", "n"))
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for words in words_of(batch.column("text")):
                _, one = words.windows(width, 31)
                at, two = words.windows(width, 57, words.second())
                place = np.zeros(len(words.hash) + 1, np.int64)
                place[at] = np.arange(len(at))
                rows = np.arange(words.first, words.first + len(words.bounds) - 1)
                mine = np.arange(cuts[rows[0]], cuts[rows[-1] + 1])
                doc = np.repeat(np.arange(len(rows)), np.diff(cuts[rows[0] : rows[-1] + 2]))
                size = hi[mine] - lo[mine] + 1
                each = np.repeat(np.arange(len(mine)), size)
                p = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + lo[mine][each]
                w = place[words.bounds[doc[each]] + p]
                columns = (one[w].view(np.int64), two[w].view(np.int64), k[rows[doc[each]]], h[rows[doc[each]]], p.astype(np.int32), n[mine][each])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w1", "w2", "k", "h", "p", "n"])

    return run


def duplicate_factors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(k, h, lo, hi, first, last): ranges of window starts whose windows all start somewhere else too, same document
    included; for whole phrases, with the other places (k, h, lo) that the index has of them."""
    small_batches(docs.sparkSession)
    keyed = keyed_texts(docs)
    texts = keyed.select("text").where("text is not null")
    # What has been counted is settled before it is joined back: a join between plain tables can split a hot key.
    anchors = settle(texts.mapInArrow(_anchors(width, gram), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a"))
    found = keyed.where("text is not null").mapInArrow(_phrase_rows(width, gram), "a long, d long, k long, h long, lo int, hi int")
    release(docs.sparkSession)
    found = settle(found.join(anchors, "a", "left_semi"))
    discard(anchors)
    release(docs.sparkSession)

    # An order of places by one number: documents by hash, then words.
    place = F.xxhash64("k", "h").bitwiseAND(-_PLACES).bitwiseOR(F.col("lo").cast("long").bitwiseAND(_PLACES - 1))
    ends = [by(c, "place").alias(f"{name}_{c}") for name, by in (("first", F.min_by), ("last", F.max_by)) for c in ("k", "h", "lo", "hi")]
    classes = settle(found.withColumn("place", place).groupBy("a", "d").agg(F.count("*").alias("n"), *ends))
    repeated = classes.where("n > 1").drop("n", "first_hi", "last_hi")

    def other(name: str) -> Column:
        """One of the phrase's indexed places, null where that is the phrase itself; a repeated row is its own copy."""
        self = (F.col("k") == F.col(f"{name}_k")) & (F.col("h") == F.col(f"{name}_h")) & (F.col("lo") == F.col(f"{name}_lo"))
        alone = (F.col("first_k") == F.col("last_k")) & (F.col("first_h") == F.col("last_h")) & (F.col("first_lo") == F.col("last_lo"))
        return F.when(~self | alone, F.struct(*[F.col(f"{name}_{c}").alias(c) for c in ("k", "h", "lo")])).alias(name)

    whole = found.join(repeated, ["a", "d"]).select("k", "h", "lo", "hi", other("first"), other("last"))

    # Boundaries: an anchor with a phrase that occurs once. One phrase of each class stands for all of them.
    open_anchors = settle(classes.groupBy("a").agg(F.min("n").alias("least")).where("least = 1").select("a"))
    stand = classes.join(open_anchors, "a", "left_semi").select("n", *[F.col(f"first_{c}").alias(c) for c in ("k", "h", "lo", "hi")])
    ranges = settle(stand.groupBy("k", "h").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("ranges")))
    wanted, _ = split_by_keys(keyed, ranges, ["k", "h"])
    windows = wanted.join(ranges.hint("shuffle_hash"), ["k", "h"]).select("k", "h", "text", "ranges").mapInArrow(_window_rows(width), "w1 long, w2 long, k long, h long, p int, n long")
    windows = settle(windows)
    release(docs.sparkSession)
    twice = settle(windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"))
    edges = windows.where("n = 1").join(twice, ["w1", "w2"], "left_semi").select("k", "h", F.col("p").alias("lo"), F.col("p").alias("hi"))
    nowhere = F.lit(None).cast(whole.schema["first"].dataType)
    return whole.unionByName(edges.withColumns({"first": nowhere, "last": nowhere}))


def greedy_factors(lo: np.ndarray, hi: np.ndarray, sources: list[np.ndarray], width: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, source number, which of its sources) of each factor, greedily, over phrases in order.

    ``sources`` are arrays (known, document, hash, first word) of each phrase's other places, two in all.
    """
    n, beside = len(lo), lo[1:] == hi[:-1] + 1
    length = [[1] * n for _ in sources]
    follows = []
    for s in sources:
        own = []
        for t in sources:
            same = s[0][:-1] & t[0][1:] & (s[1][:-1] == t[1][1:]) & (s[2][:-1] == t[2][1:]) & (t[3][1:] - s[3][:-1] == lo[1:] - lo[:-1]) & beside
            own.append(same.tolist())
        follows.append(own)
    for j in range(n - 2, -1, -1):
        for c, own in enumerate(follows):
            length[c][j] = 1 + max((length[t][j + 1] for t in range(len(sources)) if own[t][j]), default=0)
    known = [s[0].tolist() for s in sources]
    out, j = [], 0
    while j < n:
        size, c = max((length[c][j] if known[c][j] else 0, -c) for c in range(len(sources)))
        if size:
            out.append((int(lo[j]), int(hi[j + size - 1]) + width - int(lo[j]), j, -c))
        j += max(1, size)
    return out


_FACTOR = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())])


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, lists, texts = batch.column("k").to_pylist(), batch.column("matches"), batch.column("text")
            flat = lists.flatten()
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
            sources = []
            for name in ("first", "last"):
                known = flat.field(name).is_valid().to_numpy(zero_copy_only=False)
                parts = pa.compute.struct_field
                sources.append((known, *(pa.compute.fill_null(parts(flat, [name, c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "h", "lo"))))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for words in words_of(texts):
                body = words.data.tobytes()
                for i in range(len(words.bounds) - 1):
                    row = words.first + i
                    a, b = int(words.bounds[i]), int(words.bounds[i + 1])
                    mine = slice(cuts[row], cuts[row + 1])
                    factors = []
                    in_phrase = sources[0][0][mine] | sources[1][0][mine]
                    edges = lo[mine][~in_phrase]  # boundary windows
                    covered = np.bincount(edges, minlength=b - a + 1) - np.bincount(edges + width, minlength=b - a + 1)
                    if in_phrase.any():
                        at = np.flatnonzero(in_phrase) + cuts[row]
                        at = at[np.argsort(lo[at], kind="stable")]
                        own = [tuple(column[at] for column in s) for s in sources]
                        for start, size, j, c in greedy_factors(lo[at], hi[at], own, width):
                            doc = int(own[c][1][j])
                            factors.append((start, size, None if doc == NULL_ID else doc, int(own[c][3][j])))
                            covered[start] += 1
                            covered[start + size] -= 1
                    gone = np.cumsum(covered)[:-1] > 0
                    stay = np.flatnonzero(~gone) + a
                    kept = b" ".join([body[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    values = (k[row], b - a, int(gone.sum()), hashlib.sha256(kept).hexdigest(), edge.reshape(-1, 2).tolist(), factors)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            factors = pa.array([[dict(zip(_FACTOR.names, f, strict=True)) for f in fs] for fs in out[5]], pa.list_(_FACTOR))
            arrays = [*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.list_(pa.int64()))), factors]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors"])

    return run


def remove_duplicate_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Remove each word covered by a ``width``-word window that also starts anywhere else in the corpus.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged. Returns doc_id, n_words, n_removed, kept_sha256
    (of the kept words joined by one space), spans (what is removed, as [first word, word after the last]) and factors:
    the greedy parse, each with its first word, its length in words and the document and word where it also starts.

    Null text has no words; a text of fewer than ``width`` words stays; repeated rows are copies of each other; equal
    doc_ids with different texts are different documents; an empty table gives no rows; other columns are ignored.
    """
    matches = duplicate_factors(docs, width, gram)
    matches = settle(matches.groupBy("k", "h").agg(F.collect_set(F.struct("lo", "hi", "first", "last")).alias("matches")))
    # Only texts with factors are shuffled to them; the others are cut, that is left whole, where they are.
    some, none = split_by_keys(keyed_texts(docs), matches, ["k", "h"])
    joined = some.join(matches.hint("shuffle_hash"), ["k", "h"], "left").select("k", "text", "matches")
    joined = joined.unionByName(none.select("k", "text", F.lit(None).cast(joined.schema["matches"].dataType).alias("matches")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<bigint>>, factors array<struct<start: bigint, words: bigint, source_doc: bigint, source_start: bigint>>"
    return joined.mapInArrow(_cut(width), schema).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
