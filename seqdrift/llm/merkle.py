"""Merkle-tree document fingerprints and edit localisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.llm.common import NULL_ID, settle, shuffle_width, split_by_keys

LEAF_CHARS = 32


def merkle_fingerprint(text: Column, leaf_chars: int = LEAF_CHARS) -> Column:
    """A text's tree as ``root/section,section/leaf.leaf``, with 64, 16 and 8 hex digits a node.

    Sections are split at blank lines, paragraphs at line ends, and a paragraph into runs of at most ``leaf_chars``
    code points counted from its own start, so an edit inside a paragraph leaves the other paragraphs' leaves alone.
    Every inner node is the SHA-256 of its children's digests: equal roots mean equal texts, and differing branches
    locate the edit.
    """

    def digest(nodes: Column) -> Column:
        return F.sha2(F.array_join(nodes, ","), 256)

    def paragraph(line: Column) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(f"(?s).{{1,{leaf_chars}}}"), F.lit(0)), lambda leaf: F.sha2(leaf, 256))

    def shown(tree: Column) -> Column:
        sections = F.transform(tree, lambda section: digest(F.transform(section, digest)))
        leaves = F.transform(F.flatten(F.flatten(tree)), lambda leaf: F.substring(leaf, 1, 8))
        heads = F.transform(sections, lambda node: F.substring(node, 1, 16))
        return F.concat_ws("/", digest(sections), F.array_join(heads, ","), F.array_join(leaves, "."))

    tree = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda section: F.transform(F.split(section, "\n"), paragraph))
    # A lambda's argument is evaluated once, however often the body names it.
    return F.transform(F.array(tree), shown)[0]


def leaves_of(fingerprint: Column) -> Column:
    leaves = F.substring_index(fingerprint, "/", -1)
    return F.when(leaves == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(leaves, "\\.")))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints' distinct leaves; 1 for equal fingerprints, also without leaves."""

    def dice(pair: Column) -> Column:
        both = F.size(pair["x"]) + F.size(pair["y"])
        return F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(pair["x"], pair["y"])) / both)

    return F.when(a == b, 1.0).otherwise(F.transform(F.array(F.struct(leaves_of(a).alias("x"), leaves_of(b).alias("y"))), dice)[0])


def next_documents(keys: DataFrame) -> DataFrame:
    """(k, h, cut, next_k, next_h) of distinct keys (k, h, cut): the key that sorts right before, for the first the last.

    Keys are range-partitioned and sorted; the first of each partition follows the last of the one before, which takes
    one row a partition.
    """
    ordered = keys.repartitionByRange(shuffle_width(keys.sparkSession), "k", "h").sortWithinPartitions("k", "h")
    placed = settle(ordered.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftrightunsigned("place", 33))
    parts = placed.groupBy("part").agg(F.max_by(F.struct("k", "h"), "place").alias("top"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = parts.select("part", F.coalesce(F.lag("top").over(Window.orderBy("part")), F.last("top").over(every)).alias("head"))
    local = Window.partitionBy("part").orderBy("place")
    linked = placed.withColumn("own", F.lag(F.struct("k", "h")).over(local)).join(F.broadcast(heads), "part")
    after = F.coalesce("own", "head")
    return settle(linked.select("k", "h", "cut", after["k"].alias("next_k"), after["h"].alias("next_h")))


def with_next_text(docs: DataFrame, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(k, text, fingerprint, next_head, next_fingerprint): ``next_head`` is as much of the next text as a third of the text.

    Neighbours are found among keys alone. Texts are dealt once by key; each sends what its neighbour asks for, its head
    and its fingerprint, to the neighbour's key. Rows equal in doc_id and text are one document there.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("h"), "text")
    keys = settle(texts.groupBy("k", "h").agg(F.max(F.expr("char_length(text) div 3")).alias("cut"), F.count("*").alias("n")))
    links = next_documents(keys.select("k", "h", "cut"))
    repeated = keys.where("n > 1").select("k", "h")
    one = texts
    if not repeated.isEmpty():
        some, rest = split_by_keys(texts, settle(repeated), ["k", "h"])
        one = rest.unionByName(some.dropDuplicates(["k", "h"]))
    asked = links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.col("cut").cast("int").alias("cut"))
    sent = one.join(asked.hint("shuffle_hash"), ["k", "h"]).select(
        F.col("to_k").alias("k"),
        F.col("to_h").alias("h"),
        F.substring("text", F.lit(1), F.col("cut")).alias("next_head"),
        merkle_fingerprint(F.col("text"), leaf_chars).alias("next_fingerprint"),
    )
    return texts.join(sent, ["k", "h"]).select("k", "text", merkle_fingerprint(F.col("text"), leaf_chars).alias("fingerprint"), "next_head", "next_fingerprint")


def fingerprint_documents(docs: DataFrame, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Fingerprint each document and its edited text, and compare them.

    The edited text replaces the last third (rounded down, in code points) by as many first code points of the next
    document in descending doc_id order; after the last comes the first. Null text counts as empty; null doc_id is the
    lowest; among equal doc_ids the order is by a hash of the text, and rows equal in both are one document with equal
    results; an empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next_text(base, leaf_chars).withColumns({"doc_id": F.when(F.col("k") != NULL_ID, F.col("k")), "n_chars": F.char_length("text").cast("long")})
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.expr("cast(n_chars - n_chars div 3 as int)")), "next_head"))
    edited = edited.withColumn("edited_fingerprint", merkle_fingerprint(F.col("edited"), leaf_chars))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
