"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import discard, nested, release, settle, shuffle_width, small_batches, split_by_keys
from seqdrift.llm.graph import connected_components
from seqdrift.llm.text import U, Words, mix, words_of

SHINGLE = 5
PERCENT = 80
MAX_MATCHES = 4
#: Most classes, and shingles, that a block keeps of its own, and that one unit of work compares them with.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 1 << 19
_NULL_ID = -(1 << 63)
#: Stands for every block of a cell.
_ALL = -1


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row cuts, hashes): each row's distinct shingles in ascending order; a shorter row's words are one shingle."""
    rows = len(words.bounds) - 1
    at, hashes = words.windows(size, 41)
    row = np.searchsorted(words.bounds, at, side="right") - 1
    length = np.diff(words.bounds)
    short = np.flatnonzero((length > 0) & (length < size))
    if len(short):
        row, hashes = np.concatenate((row, short)), np.concatenate((hashes, words.whole(size - 1, 43)[short]))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return np.searchsorted(row, np.arange(rows + 1)), hashes


def counted_below(percent: int) -> np.uint64:
    """Tokens with a lower hash are counted over all documents and sorted rarest first; the others follow by hash. They
    are an eighth of all more than a prefix takes, so a document with much text of its own fills its prefix with that."""
    return U(min((1 << 64) - 1, (1 << 64) // 1000 * (10 * (100 - percent) + 125)))


def prefix_length(n: int, percent: int, matches: int) -> int:
    """Tokens of an n-set's prefix such that every partner shares ``matches`` of them in its own such prefix."""
    return n - -(-percent * n // 100) + matches


def _summaries(size: int, percent: int):
    """Per document: set size, a 128-bit set hash, and the tokens that can be in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "h"))
            for words in words_of(batch.column("text"), lower=True):
                cuts, hashes = shingle_sets(words, size)
                rows = np.arange(words.first, words.first + len(cuts) - 1)
                n = np.diff(cuts)
                sums = []
                for salt in (3, 4):
                    total = np.zeros(len(hashes) + 1, U)
                    np.cumsum(mix(hashes, salt), out=total[1:])
                    sums.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
                total = np.concatenate(([0], np.cumsum(hashes < counted_below(percent))))
                counted = total[cuts[1:]] - total[cuts[:-1]]
                most = n - -(-percent * n // 100) + MAX_MATCHES
                take = np.minimum(n, np.maximum(counted, most))
                each = np.repeat(cuts[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(hashes[each].view(np.int64)))
                columns = [pa.array(c) for c in (k[rows], h[rows], n.astype(np.int32), sums[0], sums[1], counted.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, tokens], names=["k", "h", "n", "d1", "d2", "counted", "tokens"])

    return run


def choose_prefix(n: int, counted: int, tokens: np.ndarray, df: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(matches, prefix tokens that others have too) of the cheapest prefix.

    The global order is: counted tokens by (document frequency, hash), then the others by hash. Tokens that no other
    document offers are not listed, but the counted ones among them come first and use up prefix places. Asking for more
    shared tokens lengthens the prefix. A list entry costs one step to scan; a candidate uses up as many entries as
    shared tokens are asked for, and costs ``n`` steps to verify.
    """
    early = tokens < counted_below(percent)
    order = np.lexsort((tokens, np.where(early, df, 0), ~early))
    tokens, df, early = tokens[order], df[order], early[order]
    place = np.arange(len(tokens)) + counted - early.sum()
    best = None
    for matches in range(1, min(MAX_MATCHES, n) + 1):
        inside = place < prefix_length(n, percent, matches)
        scanned = float(df[inside].sum())
        cost = scanned + scanned / matches * n
        if best is None or cost < best[0]:
            best = cost, matches, tokens[inside]
    return best[1], best[2]


def _prefixes(percent: int):
    """Per class: matches, prefix, the counted tokens that others have too, and how many of them a partner must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [], [], [])
            rows = zip(*(batch.column(c).to_pylist() for c in ("d1", "d2", "n", "counted")), batch.column("found"), strict=True)
            for d1, d2, n, counted, found in rows:
                values = found.values
                tokens = values.field("token").to_numpy(zero_copy_only=False).view(U)
                matches, chosen = choose_prefix(n, counted, tokens, values.field("df").to_numpy(zero_copy_only=False), percent)
                listed = tokens[tokens < counted_below(percent)]
                # At most n - ceil(t * n) tokens of a set are missing in a partner, so of the counted ones at least these
                # are shared: the longest prefix, with the most matches.
                need = counted - (n - -(-percent * n // 100))
                if len(chosen) >= matches and len(listed) >= need:
                    for column, value in zip(out, (d1, d2, n, matches, need, chosen.view(np.int64), listed.view(np.int64)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["d1", "d2", "n", "matches", "need", "prefix", "listed"])

    return run


def _overlaps(sets: list[np.ndarray], rows: int) -> np.ndarray:
    """Sizes of the first ``rows`` sets' intersections with all; only tokens that two sets have are looked at."""
    values = np.concatenate(sets) if sets else np.empty(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    at, owner = place[at[keep]], owner[keep]
    out = np.zeros((rows, len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(at, (low, low + 2048))
        part = np.zeros((len(sets), min(2048, int(shared.sum()) - low)), np.float32)
        part[owner[a:b], at[a:b] - low] = 1
        out += part[:rows] @ part.T
    return out


@dataclass
class Member:
    """A class of equal sets in a unit of work; ``tokens`` is its whole set where that has been fetched."""

    node: int
    visits: bool
    n: int
    matches: int
    need: int
    copies: int
    prefix: np.ndarray
    listed: np.ndarray
    tokens: np.ndarray | None


def _candidates(unit: list[Member], percent: int, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a resident and a visitor, and where ``inside`` of two residents, with like sizes and enough shared tokens
    in both prefixes. Residents come first."""
    own = sum(not m.visits for m in unit)
    n, need, matches = (np.array([getattr(m, c) for m in unit]) for c in ("n", "need", "matches"))
    enough = _overlaps([m.prefix for m in unit], own) >= np.minimum(matches[:own, None], matches[None, :])
    enough[:, :own] = np.triu(enough[:, :own], 1) if inside else False
    a, b = np.nonzero(enough)
    fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    a, b = a[fits], b[fits]
    if len(a):
        enough = _overlaps([m.listed for m in unit], own)[a, b] >= np.maximum(need[a], need[b])
        a, b = a[enough], b[enough]
    return a, b


def _met(unit: list[Member], percent: int, inside: bool) -> Iterator[tuple[int, int | None, int]]:
    """The members that have a candidate here: their whole sets are needed."""
    for i in np.unique(np.concatenate(_candidates(unit, percent, inside))):
        yield unit[i].node, None, 0


def _links(unit: list[Member], percent: int, inside: bool) -> Iterator[tuple[int, int | None, int]]:
    """Rows (node, other, links): a spanning forest of the unit's links, and each node's links weighted by copies."""
    a, b = _candidates(unit, percent, inside)
    sets, n, copies = [m.tokens for m in unit], np.array([m.n for m in unit]), np.array([m.copies for m in unit])
    if len(a) > 4 * len(unit):
        common = _overlaps(sets, sum(not m.visits for m in unit))[a, b].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    linked = 100 * common >= percent * (n[a] + n[b] - common)
    a, b = a[linked], b[linked]
    links = np.bincount(a, copies[b], len(unit)) + np.bincount(b, copies[a], len(unit))
    yield from ((unit[i].node, None, int(links[i])) for i in np.flatnonzero(links))
    root = list(range(len(unit)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            root[x] = y
            yield unit[i].node, unit[j].node, 0


_UNIT = ["cell", "sub", "part"]
_CARRIED = ["node", "visits", "n", "matches", "need", "copies", "prefix", "listed"]


def _by_unit(work, percent: int):
    """Rows come sorted by unit, residents first: the members of one unit are together."""

    def flush(key: tuple | None, unit: list[Member]) -> Iterator[pa.RecordBatch]:
        if len(unit) > 1 and not unit[0].visits:
            rows = list(work(unit, percent, key[2] == 0))
            if rows:
                a, b, n = zip(*rows, strict=True)
                keys = [pa.array([k] * len(a), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=[*_UNIT, "a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, unit = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in _UNIT), strict=True)
            numbers = zip(*(batch.column(c).to_pylist() for c in _CARRIED[:6]), strict=True)
            arrays = zip(*(batch.column(c) for c in ("prefix", "listed", "tokens")), strict=True)
            for now, number, (prefix, listed, tokens) in zip(keys, numbers, arrays, strict=True):
                if now != key:
                    yield from flush(key, unit)
                    key, unit = now, []
                short = [np.array(x.values, np.int64).view(U) for x in (prefix, listed)]
                unit.append(Member(*number, *short, np.frombuffer(tokens.as_py(), U) if tokens.is_valid else None))
        yield from flush(key, unit)

    return run


def _worked(members: DataFrame, work, percent: int) -> DataFrame:
    dealt = members.repartition(shuffle_width(members.sparkSession), *_UNIT).sortWithinPartitions(*_UNIT, "visits", "node")
    return dealt.select(*_UNIT, *_CARRIED, "tokens").mapInArrow(_by_unit(work, percent), "cell long, sub int, part int, a long, b long, links long")


def _units(prefixes: DataFrame) -> DataFrame:
    """(cell, sub, part, node, visits): which classes meet where, so that each two with a common prefix token meet once.

    A class lives in the cell of its most frequent prefix token, so those of a group of near copies, and those with one
    common passage, mostly live together. A large cell is split into blocks. A class visits the lower blocks of its own
    cell, all of which have the cell's token. In lower cells it visits the blocks in which some class with one of its
    prefix tokens lives, or all blocks of a cell of which a half or more have that token: so a token that many classes of
    a large cell have gives a row a cell, not a row a block. A block's visitors are split in parts.
    """
    postings = prefixes.select("node", "n", F.explode("prefix").alias("token"))
    meets = settle(postings.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"))
    some, _ = split_by_keys(postings, meets, ["token"])
    shared = settle(some.join(meets, "token"))

    def pieces(key: list[str]) -> list:
        return [F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("pieces")]

    homes = settle(shared.groupBy("node", "n").agg(F.max(F.struct("m", "token"))["token"].alias("cell")))
    cells = settle(homes.groupBy("cell").agg(*pieces(["cell"])))
    homes = settle(homes.join(cells, "cell").select("node", "n", "cell", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("sub")))

    lived = shared.select("node", "token").join(homes, "node")
    places = lived.groupBy("token").agg(F.min("cell").alias("least"), F.max("cell").alias("most"))
    wide = settle(places.where("least <> most").select("token"))  # only their classes have another cell to go to
    going = settle(lived.join(wide, "token", "left_semi"))
    spots = going.groupBy("token", "cell").agg(F.collect_set("sub").alias("subs")).join(cells, "cell")
    at = F.when(2 * F.size("subs") >= F.col("pieces"), F.array(F.lit(_ALL))).otherwise(F.col("subs"))
    spots = settle(spots.select("token", F.col("cell").alias("to"), F.explode(at).alias("at")))
    away = going.join(spots, "token").where(F.col("to") < F.col("cell"))
    away = settle(away.select("node", "n", F.col("to").alias("cell"), F.col("at").alias("sub")).distinct())
    everywhere = away.where(F.col("sub") == _ALL).join(cells, "cell").select("node", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("sub"))
    own = homes.where("sub > 0").select("node", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("sub") - 1)).alias("sub"))
    visits = settle(own.unionByName(away.where(F.col("sub") != _ALL).unionByName(everywhere).distinct()))
    parts = settle(visits.groupBy("cell", "sub").agg(*pieces(["cell", "sub"])))
    visitors = visits.join(parts, ["cell", "sub"]).select("cell", "sub", F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int").alias("part"), "node", F.lit(True).alias("visits"))
    stays = homes.join(parts, ["cell", "sub"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    units = settle(stays.select("cell", "sub", "part", "node", F.lit(False).alias("visits")).unionByName(visitors))
    discard(meets, shared, cells, homes, wide, going, spots, away, visits, parts)
    return units


def _sets(size: int):
    """Whole shingle sets of the candidates, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text"), lower=True):
                cuts, hashes = shingle_sets(words, size)
                tokens = [hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(words.first, len(tokens)), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    return run


def _components(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``jaccard_components`` with k, h (what a row is known by) and ``head``, the (last, h, k) of its component's first."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("k"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    base = settle(keyed.mapInArrow(_summaries(shingle, percent), "k long, h long, n int, d1 long, d2 long, counted int, tokens array<bigint>"))
    filled = base.where("n > 0")
    last = F.when(F.col("k") == _NULL_ID, (1 << 63) - 1).otherwise(F.col("k"))
    # Sets are known by 128 bits, one class a set.
    nodes = filled.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min(F.when(F.col("k") != _NULL_ID, F.col("k"))).alias("least"), F.min(F.struct(last.alias("last"), "h", "k")).alias("head"))
    nodes = settle(nodes)

    # One row stands for a class: its only one, or the head; repeated heads are equal and count once.
    many = settle(nodes.where("copies > 1").select("d1", "d2", "head.k", "head.h"))
    some, alone = split_by_keys(filled, many, ["d1", "d2"])
    heads = some.join(many.hint("shuffle_hash"), ["d1", "d2", "k", "h"], "left_semi").dropDuplicates(["d1", "d2"])
    apart = some.join(many.select("d1", "d2").hint("shuffle_hash"), ["d1", "d2"], "left_anti")
    single = alone.unionByName(apart).unionByName(heads.select(*alone.columns)).select("d1", "d2", "n", "counted", F.explode("tokens").alias("token"))
    shared = settle(single.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    release(docs.sparkSession)
    offered, _ = split_by_keys(single, shared, ["token"])
    found = offered.join(shared, "token").groupBy("d1", "d2", "n", "counted").agg(F.collect_list(F.struct("token", "df")).alias("found"))
    chosen = found.mapInArrow(_prefixes(percent), "d1 long, d2 long, n int, matches int, need int, prefix array<bigint>, listed array<bigint>")
    prefixes = settle(chosen.join(nodes, ["d1", "d2"]).withColumn("node", F.monotonically_increasing_id()))
    del single, some, alone, heads, apart, offered, found, chosen
    discard(shared, many)
    release(docs.sparkSession)

    units = _units(prefixes)
    carried = prefixes.select("node", "n", "matches", "need", "copies", "prefix", "listed")
    met = settle(_worked(units.join(carried, "node").withColumn("tokens", F.lit(None).cast("binary")), _met, percent))
    wanted = settle(met.select(F.col("a").alias("node")).distinct().join(prefixes.select("node", "head.k", "head.h"), "node"))
    near, _ = split_by_keys(keyed, wanted, ["k", "h"])
    # Repeated rows give one set each, all equal.
    fetched = near.join(wanted.hint("shuffle_hash"), ["k", "h"]).select("node", "text").mapInArrow(_sets(shingle), "node long, tokens binary").dropDuplicates(["node"])
    whole = settle(fetched.join(carried, "node"))
    again = units.join(met.select(*_UNIT, F.col("a").alias("node")), [*_UNIT, "node"])
    release(docs.sparkSession)
    links = settle(_worked(again.join(whole, "node"), _links, percent))
    discard(whole, units, met, wanted)

    parts = connected_components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = settle(prefixes.select("node", "d1", "d2", "least", "head").join(parts, "node").join(counts, "node", "left"))
    groups = joined.groupBy("label").agg(F.min("least").alias("group_least"), F.min("head").alias("group_head"))
    joined = joined.join(groups, "label").select("d1", "d2", "group_least", "group_head", "links")
    classes = nodes.join(joined, ["d1", "d2"], "left").select(
        "d1",
        "d2",
        F.when(F.col("group_head").isNull(), F.col("least")).otherwise(F.col("group_least")).alias("component_id"),
        F.coalesce("group_head", "head").alias("head"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    rows = base.select("k", "h", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    doc_id = F.when(F.col("k") != _NULL_ID, F.col("k"))
    empty = F.col("n") == 0
    return rows.select(
        "k",
        "h",
        F.when(~empty, F.col("head")).alias("head"),
        doc_id.alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(empty, doc_id).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least ``percent`` hundredths.

    Returns a row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), n_links (documents
    linked to it, copies of one text counted each).

    1. Documents with equal sets become one class; one row of each class goes on.
    2. Every counted token's document frequency is exact over all classes; each class picks the prefix that is cheapest
       by those frequencies (``choose_prefix``).
    3. Classes meet through the postings of their prefix tokens (``_units``): a class is sent only where a class with
       one of its prefix tokens lives, and a hot token's classes are split into blocks. A unit of work is bounded by
       ``BLOCK_ROWS`` and ``BLOCK_SHINGLES``. It keeps the classes that have a candidate, a partner with enough shared
       tokens in both the chosen prefixes and the longest ones.
    4. Those classes' whole sets are fetched and sent to the same units, and candidates are verified exactly. A spanning
       forest of links and each class's number of links come out, never the pairs. No candidate is dropped.
    5. Components of the links give component_id.

    A null text or one without words has no shingles and is linked with nothing. Rows with a null doc_id take part;
    component_id is null only where a component has no doc_id. Repeated rows are copies of one text. An empty table
    gives no rows; other columns are ignored.
    """
    return _components(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all columns: the one with the least doc_id (null last), then text hash.

    Documents without words stay. Of rows equal in doc_id and text one stays, whether or not they have words. Columns
    may have any names.
    """
    found = settle(_components(docs, shingle, percent))
    gone = settle(found.where((F.col("head.k") != F.col("k")) | (F.col("head.h") != F.col("h"))).select("k", "h").distinct())
    repeated = settle(found.groupBy("k", "h").count().where("count > 1").select("k", "h"))
    rows = nested(docs, k=F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), h=F.xxhash64("text"))
    # Only rows that may go are shuffled.
    some, stay = split_by_keys(rows, gone, ["k", "h"])
    rows = stay.unionByName(some.join(gone.hint("shuffle_hash"), ["k", "h"], "left_anti").select(*stay.columns))
    if not repeated.isEmpty():
        some, stay = split_by_keys(rows, repeated, ["k", "h"])
        rows = stay.unionByName(some.dropDuplicates(["k", "h"]))
    return rows.select("row.*")
