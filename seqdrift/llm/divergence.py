"""How sources of one language differ in their words: exact integer divergences, common terms dense and rare ones sparse."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.llm.common import settle, shuffle_width, small_batches

SCALE = 1_000_000_000
#: Term counts that a task holds before it passes them on.
HELD_TERMS = 1 << 19
#: A term is common if more than this share of its language's groups, and more than ``RARE_GROUPS`` of them, have it.
COMMON_SHARE = 4
RARE_GROUPS = 8
#: Terms and groups of a dense tile.
TILE_TERMS = 4096
TILE_GROUPS = 64
#: Pairs of groups that a task sums before it passes them on.
HELD_PAIRS = 1 << 18

#: Letters A-Z to a-z; other bytes below 0x80 end a term; the rest, which only occur in longer characters, stay.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over many documents; every group also has a row without a term."""
    groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        flat = [(lang, source, term, n, d) for (lang, source), terms in groups.items() for term, (n, d) in [(None, (0, 0)), *terms.items()]]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(c, pa.binary() if k == pa.string() and i == 2 else k) for i, (c, k) in enumerate(zip(zip(*flat, strict=True), kinds, strict=True))]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            known = groups.setdefault((lang, source), {})
            before = len(known)
            for term, n in Counter(terms_of(text)).items():
                if (sums := known.get(term)) is None:
                    known[term] = [n, 1]
                else:
                    sums[0] += n
                    sums[1] += 1
            held += len(known) - before
            if held > HELD_TERMS:
                yield rows()
                groups, held = {}, 0
    if groups:
        yield rows()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of every group; null texts, languages and sources are empty. The row without a term
    says only that the group is there."""
    small_batches(docs.sparkSession)
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("text")
    parts = docs.select(lang, source, text).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | int, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in decimals, so that no count is too large for it; 1 of nothing."""
    above = (F.lit(count) if isinstance(count, int) else count).cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)")
    below = F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(19,0)")
    return 1 + F.coalesce(F.call_function("div", (above * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)"), below), F.lit(0))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2 * 10^9, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _dense(tile_groups: int):
    """Tiles of ``tile_groups`` groups each way: for each pair of groups, what the tile's terms add to the value that they
    had if no group had them."""

    def tile(key: tuple, terms: pd.DataFrame, constants: pd.DataFrame) -> pd.DataFrame:
        lang, _, left, right = key
        out = {"lang": [], "a": [], "b": [], "part": []}
        if len(terms):
            none = constants.set_index("g")["p0"].sort_index()
            groups, base = none.index.to_numpy(), none.to_numpy(np.int64)
            number, names = pd.factorize(terms["term"])
            shares = np.repeat(base[:, None], len(names), axis=1)
            shares[np.searchsorted(groups, terms["g"].to_numpy()), number] = terms["p"].to_numpy(np.int64)
            mine = np.flatnonzero(groups // tile_groups == left)
            for i in mine:
                j = np.flatnonzero((groups // tile_groups == right) & (groups > groups[i]))
                if len(j):
                    part = _gap(shares[i][None, :], shares[j]).sum(axis=1) - len(names) * _gap(base[i], base[j])
                    for column, value in zip(out.values(), ([lang] * len(j), [groups[i]] * len(j), groups[j], part), strict=True):
                        column.extend(value)
        return pd.DataFrame(out).astype({"lang": object, "a": "int64", "b": "int64", "part": "int64"})

    return tile


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of rare terms to what each pair that shares a term adds to the two one-sided corrections."""
    sums: Counter = Counter()

    def rows() -> pa.RecordBatch:
        flat = [(lang, a, b, v) for (lang, a, b), v in sums.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat, strict=True), kinds, strict=True)], names=["lang", "a", "b", "part"])

    for batch in batches:
        for lang, groups, p, p0 in zip(*(batch.column(c).to_pylist() for c in ("lang", "g", "p", "p0")), strict=True):
            order = np.argsort(groups)
            g, p, p0 = (np.array(x, np.int64)[order] for x in (groups, p, p0))
            for i in range(len(g) - 1):
                j = slice(i + 1, None)
                part = _gap(p[i], p[j]) - _gap(p[i], p0[j]) - _gap(p0[i], p[j]) + _gap(p0[i], p0[j])
                for b, v in zip(g[j].tolist(), part.tolist(), strict=True):
                    sums[lang, int(g[i]), b] += v
            if len(sums) > HELD_PAIRS:
                yield rows()
                sums = Counter()
    if sums:
        yield rows()


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's words are from the other sources' and its language's.

    Terms are counted per group before any shuffle. A pair's value is the sum, over all kept terms, of the gap between two
    shares. It is made of: every term as if neither group had it, which is one number a pair; for common terms, tiles of
    ``tile_terms`` terms and ``tile_groups`` groups each way, as dense matrices of differences to that; for rare terms,
    what one group's counts add by themselves, which depends on the counts alone and is taken from their histogram, and
    what the pairs in a term's posting list change. All of it is whole numbers, so the sum is exact. Nothing is as large
    as terms times pairs. A posting list or a tile is bounded by the sources of a language, never by documents.

    ``min_docs`` documents of the language must have a kept term; part ``term`` keeps ranks to ``top``. Null text,
    language and source count as ''. Repeated rows count as often as they come; an empty table gives no rows; doc_id and
    other columns are ignored.
    """
    width = shuffle_width(docs.sparkSession)
    counted = settle(count_terms(docs))
    in_lang = Window.partitionBy("lang", "term")
    found = counted.where("term is not null").withColumns({"docs": F.sum("docs").over(in_lang), "everywhere": F.sum("n").over(in_lang), "spread": F.count("*").over(in_lang)})
    kept = settle(found.where(F.col("docs") >= min_docs).drop("docs"))

    of_term = kept.groupBy("lang", "term").agg(F.max("everywhere").alias("n"))
    langs = of_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "lang_total", "total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    many = F.count("*").over(Window.partitionBy("lang"))
    groups = settle(groups.withColumns({"g": number, "groups": many, "p0": share(0, F.col("total"), F.col("kept"))}))

    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("everywhere"), F.col("lang_total"), F.col("kept"))})
    common = (F.col("spread") > RARE_GROUPS) & (COMMON_SHARE * F.col("spread") > F.col("groups"))
    shares = settle(shares.select("lang", "source", "term", "g", "groups", "n", "p", "p0", "q", common.alias("common")))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # Common terms: a group's rows go to the tiles of its block of groups with each block.
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("groups") - 1) / tile_groups))
    mine = F.floor(F.col("g") / tile_groups)
    met = F.explode(F.transform(blocks, lambda other: F.struct(F.least(mine, other).alias("left"), F.greatest(mine, other).alias("right")))).alias("tile")
    n_common = shares.where("common").select("lang", "term").distinct().count()
    tiles = max(1, -(-n_common // tile_terms))
    tile = F.pmod(F.xxhash64("term"), F.lit(tiles))
    dense = shares.where("common").select("lang", tile.alias("block"), met, "term", "g", "p").select("lang", "block", "tile.*", "term", "g", "p")
    constants = groups.select("lang", met, "g", "p0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("block"), "tile.*", "g", "p0")
    key = ["lang", "block", "left", "right"]
    sums = dense.groupBy(*key).cogroup(constants.groupBy(*key)).applyInPandas(_dense(tile_groups), "lang string, a long, b long, part long")

    # Rare terms: pairs that share one.
    rare = shares.where("not common")
    postings = rare.groupBy("lang", "term").agg(*[F.collect_list(c).alias(c) for c in ("g", "p", "p0")]).where(F.size("g") > 1)
    sums = sums.unionByName(postings.select("lang", "g", "p", "p0").repartition(width).mapInArrow(_sparse, "lang string, a long, b long, part long"))
    shared = sums.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    shared = shared.unionByName(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))

    # Rare terms: what a group's own counts add, against every other group.
    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("b"), F.col("p0").alias("other"))
    alone = rare.groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("terms")).withColumnRenamed("g", "a")
    alone = alone.join(other.drop("item"), "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (gap(F.col("p"), F.col("other")) - gap(F.col("p0"), F.col("other")))).alias("own"))

    pairs = groups.select("lang", "source", "kept", F.col("g").alias("a"), "p0").join(other, "lang").where("a <> b")
    pairs = pairs.join(shared, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left")
    pairs = pairs.join(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("own").alias("others")), ["lang", "a", "b"], "left")
    parts = [F.coalesce(c, F.lit(0)) for c in ("part", "own", "others")]
    value = F.when(F.col("kept") == 0, F.lit(0)).otherwise(F.col("kept") * gap(F.col("p0"), F.col("other")) + parts[0] + parts[1] + parts[2]).cast("long")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
