"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit distance.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks along a sequence, writing the current word at every
step and moving on or not by a random bit of (step, word): small edit distances become small Hamming distances. Sampling
a few steps of the walk is a hash that close sequences share with good probability; several walks, several samples each,
bring the miss rate below a target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import groups_for, keyed_texts, settle, small_batches, without
from seqdrift.llm.text import U, Words, mix, run_hashes, words_of

MIN_WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9
WALKS = 4
SAMPLED_STEPS = 5
#: Share of equal steps of two walks whose windows differ by a tenth of their words, as measured in the tests.
STEP_MATCH = 0.6
#: Items that one pass over the documents looks for; a larger benchmark takes several passes.
PASS_ITEMS = 200_000
PASS_BYTES = 64 << 20
_MARKS = b".,;:!?\"'()[]"
_PAD = 0xA5A5A5A5A5A5A5A5
_FILTER_BITS = 22


def window_class(length: int) -> int:
    """Window width for an item of so many words: the largest of 4, 8, 16, 32 that leaves room for every start offset
    below the stride, which is half the width."""
    return max(w for w in (4, 8, 16, 32) if w == 4 or w + w // 2 - 1 <= length)


def tables_for(recall: float, windows: int = 3) -> int:
    """Hash tables that bring the miss rate of an item seen through ``windows`` windows below 1 - recall."""
    hit = STEP_MATCH**SAMPLED_STEPS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit) / windows))


def cgk_keys(hashes: np.ndarray, starts: np.ndarray, width: int, walk: int, tables: int) -> np.ndarray:
    """(tables, windows) keys: words written at the sampled steps of one walk over each window of ``width`` words."""
    steps = 2 * width
    rng = np.random.default_rng([walk, width])
    samples = [np.sort(rng.choice(steps, SAMPLED_STEPS, replace=False)) for _ in range(tables)]
    wanted = {int(s) for row in samples for s in row}
    bits = [mix(hashes, 100 + 4 * walk + part) for part in range(-(-steps // 64))]
    at, ends = starts.copy(), starts + width
    keys = np.zeros((tables, len(starts)), U)
    last = max(wanted)
    for step in range(last + 1):
        inside = at < ends
        here = np.minimum(at, ends - 1)
        if step in wanted:
            word = np.where(inside, hashes[here], U(_PAD))
            for t, row in enumerate(samples):
                if step in row:
                    keys[t] = mix(keys[t] ^ word, step)
        at = at + (inside & ((bits[step // 64][here] >> U(step % 64)) & U(1)).astype(bool))
    return keys


def edit_distance_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(distance, end): least word edit distance of the item to any stretch of the region, and where it ends."""
    row = np.zeros(len(region) + 1, np.int64)
    steps = np.arange(len(region) + 1)
    for i, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


class Finder:
    """The benchmark's hash tables, built once in each worker."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float) -> None:
        self.similarity, self.ids = similarity, [i for i, _ in items]
        self.words: list[np.ndarray] = []
        for words in words_of(pa.array([t for _, t in items], pa.string()), lower=True, drop=_MARKS):
            self.words += [words.hash[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        self.tables = -(-tables_for(recall) // WALKS)
        self.allowed = np.array([int(len(w) * (1 - similarity) + 1e-9) for w in self.words], np.int64)
        self.classes: dict[int, list[int]] = {}
        self.exact: dict[int, list[int]] = {}  # items of a few words, by length
        self.short: list[int] = []  # items of a few words that may still differ
        for i, w in enumerate(self.words):
            if len(w) >= MIN_WORDS:
                self.classes.setdefault(window_class(len(w)), []).append(i)
            elif len(w) and self.allowed[i] == 0:
                self.exact.setdefault(len(w), []).append(i)
            elif len(w):
                self.short.append(i)
        self.known = np.zeros(1 << _FILTER_BITS, bool)
        for w in self.words:
            self.known[w >> U(64 - _FILTER_BITS)] = True
        self.index = {width: self._index(width, members) for width, members in self.classes.items()}

    def _index(self, width: int, members: list[int]) -> list[list[tuple[np.ndarray, ...]]]:
        flat = np.concatenate([self.words[i] for i in members])
        base = np.concatenate(([0], np.cumsum([len(self.words[i]) for i in members])))
        item, offset = (np.array(x) for x in zip(*((i, q) for i in range(len(members)) for q in range(len(self.words[members[i]]) - width + 1)), strict=True))
        found = []
        for walk in range(WALKS):
            rows = []
            for keys in cgk_keys(flat, base[item] + offset, width, walk, self.tables):
                order = np.argsort(keys, kind="stable")
                rows.append((keys[order], np.array(members)[item[order]], offset[order]))
            found.append(rows)
        return found

    def candidates(self, words: Words) -> np.ndarray:
        """(row, item, start) rows, sorted: where an item may start in a row, counted from the row's first word; of the
        places that one edit region covers, one."""
        inside = self.known[words.hash >> U(64 - _FILTER_BITS)]
        total = np.concatenate(([0], np.cumsum(inside)))
        row_of = words.row_of()
        length = np.diff(words.bounds)
        out = [np.empty((0, 3), np.int64)]
        for width, index in self.index.items():
            stride = width // 2
            # Every stride-th word of a row starts a window; a row's last windows are aligned to its end.
            number = np.maximum(0, (length - width) // stride + 1)
            row = np.repeat(np.arange(len(length)), number)
            starts = words.bounds[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number))
            # A window cannot be near an item unless most of its words are the benchmark's.
            starts = starts[total[starts + width] - total[starts] >= (2 * self.similarity - 1) * width]
            if not len(starts):
                continue
            for walk, tables in enumerate(index):
                for keys, (known, item, offset) in zip(cgk_keys(words.hash, starts, width, walk, self.tables), tables, strict=True):
                    low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                    each, at = _spread(low, high)
                    row = row_of[starts[each]]
                    out.append(np.stack((row, item[at], starts[each] - words.bounds[row] - offset[at]), axis=1))
        found = np.concatenate(out)
        region = found[:, 2] // np.maximum(1, self.allowed[found[:, 1]]) if len(found) else found[:, 2]
        order = np.lexsort((found[:, 2], region, found[:, 1], found[:, 0]))
        found, region = found[order], region[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1) | (region[1:] != region[:-1])
        return found[new]

    def _unchanged(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, distance, end word) of the items of a few words, as they stand."""
        for size, members in self.exact.items():
            at, keys = words.windows(size, 17)
            order = np.argsort(keys, kind="stable")
            goals = np.array([run_hashes(self.words[i], size, 17)[0] for i in members], U)
            low, high = np.searchsorted(keys[order], goals, "left"), np.searchsorted(keys[order], goals, "right")
            which, place = _spread(low, high)
            row = words.row_of()[at[order[place]]]
            ends = at[order[place]] + size - words.bounds[row]
            seen = set()
            for r, m, e in zip(row.tolist(), which.tolist(), ends.tolist(), strict=True):
                if (r, m) not in seen:
                    seen.add((r, m))
                    yield r, members[m], 0, e

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item id, item words, distance, end word) of each item found in each row, at its least distance."""
        for words in words_of(column, lower=True, drop=_MARKS):
            best = {(r, i): (d, e) for r, i, d, e in self._unchanged(words)}
            for i in self.short:
                for r in range(len(words.bounds) - 1):
                    self._verify(words, r, i, np.array([0]), len(words.hash), best)
            found = self.candidates(words)
            cuts = np.flatnonzero(np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1), [True]))) if len(found) else []
            row, own = -1, None
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                r, i = int(found[low, 0]), int(found[low, 1])
                if r != row:
                    row, own = r, np.unique(words.hash[words.bounds[r] : words.bounds[r + 1]])
                # An item too few of whose words are anywhere in the text is in no place of it.
                goal = self.words[i]
                there = own[np.minimum(np.searchsorted(own, goal), len(own) - 1)] == goal
                if there.sum() >= len(goal) - self.allowed[i]:
                    self._verify(words, r, i, found[low:high, 2], 0, best)
            for (r, i), (distance, end) in sorted(best.items()):
                yield words.first + r, self.ids[i], len(self.words[i]), distance, end

    def _verify(self, words: Words, r: int, i: int, starts: np.ndarray, slack: int, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Exact edit distance around each start."""
        goal, allowed = self.words[i], int(self.allowed[i])
        a, b = int(words.bounds[r]), int(words.bounds[r + 1])
        for start in starts.tolist():
            if best.get((r, i), (1, 0))[0] == 0:
                return
            low, high = max(a, a + start - 2 * allowed), min(b, a + start + len(goal) + 2 * allowed + slack)
            region = words.hash[low:high]
            if not len(region) or np.isin(goal, region).sum() < len(goal) - allowed:
                continue
            distance, end = edit_distance_within(goal, region)
            if distance <= allowed:
                best[r, i] = min(best.get((r, i), (distance, low + end - a)), (distance, low + end - a))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, index) of every index in the ranges low to high."""
    size = high - low
    each = np.repeat(np.arange(len(size)), size)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + low[each]


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The stated query set, in parts of a size that every task may hold whole."""
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(groups_for(size["n"], PASS_ITEMS), groups_for(size["b"], PASS_BYTES))
    if parts > 1:
        items = settle(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))))
    for part in range(parts):
        rows = (items if parts == 1 else items.where(F.col("part") == part)).select("item_id", "text").collect()
        yield sorted((r[0], r[1]) for r in rows)


def _leaks(texts: DataFrame, benchmark: DataFrame, similarity: float, recall: float) -> DataFrame:
    """The columns of ``texts`` but the last, the text, with the items found in it. Each pass but a single one is settled."""
    names = texts.columns[:-1]
    small_batches(texts.sparkSession)
    schema = ", ".join(f"{n} long" for n in (*names, "item_id", "item_words", "distance", "end_word"))

    def pass_of(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items, similarity, recall)
            for batch in batches:
                found = list(finder.matches(batch.column(len(names))))
                if found:
                    rows, *rest = zip(*found, strict=True)
                    columns = [*(batch.column(c).take(pa.array(rows)) for c in range(len(names))), *(pa.array(c, pa.int64()) for c in rest)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "item_id", "item_words", "distance", "end_word"])

        return texts.mapInArrow(run, schema)

    found, several = None, None
    for items in _passes(benchmark):
        if found is not None and several is None:
            found = several = settle(found)
        found = pass_of(items) if found is None else found.unionByName(settle(pass_of(items)))
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document and benchmark item it contains: doc_id, item_id, item_words, distance, end_word.

    Words are lower-cased (A-Z) and marks separate them. An item of L words is contained if some stretch of the document
    is within (1 - similarity) * L word edits of it. Windows of an item's size class start at every half width; every
    offset of every item is indexed, so an unchanged item always meets an equal window; edited items are met with
    probability ``recall`` or more (measured in the tests). Every candidate is verified by exact edit distance.

    Items of fewer than 5 words are looked for exactly, word by word; a benchmark of any size is gone through in passes
    of ``PASS_ITEMS``. Null and empty texts and items contain nothing and are in nothing; repeated rows each report their
    leaks; a null doc_id stays null; with an empty table there are no rows; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _leaks(texts, benchmark, similarity, recall)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents, all columns, that contain no benchmark item."""
    return without(docs, settle(_leaks(keyed_texts(docs), benchmark, similarity, recall).select("k", "h").distinct()))
