"""Contiguous byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.llm.common import counted_rows, each_copy, settle, shuffle_width


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """Cut the documents, in doc_id order, into ``n_shards`` contiguous runs of near-equal bytes.

    A document weighs its UTF-8 bytes plus ``overhead``. Only (doc_id, size, crc) rows are range-partitioned; each
    partition's totals are prefix-summed (one row per partition), which turns local offsets into global ones. A
    document belongs to the shard that holds its midpoint, so shards are contiguous and differ from the target by at
    most one document's size. Texts themselves never move.

    Null text weighs ``overhead`` with the CRC of no bytes; null doc_id sorts first; repeated rows each get a slot;
    an empty table gives no rows; other columns are ignored.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    width = shuffle_width(docs.sparkSession)
    order = ["doc_id", "size", "text_crc32"]
    # Equal rows are one until their offsets are known, so no range is overfull of them.
    ordered = counted_rows(sized).repartitionByRange(width, *order).sortWithinPartitions(*order)
    # The id is partition number * 2^33 + row number; writing it out fixes it before it is used twice.
    placed = settle(ordered.withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumns({"part": F.shiftrightunsigned("place", 33), "bytes": F.col("size") * F.col("copies")})

    totals = placed.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.sum("copies").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per range partition, so the single-task window and the broadcast are bounded by the partition count.
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("all_bytes"),
    )
    local = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.join(F.broadcast(starts), "part").select(
        *order,
        "copies",
        "all_bytes",
        (F.col("bytes_before") + F.coalesce(F.sum("bytes").over(local), F.lit(0))).alias("offset"),
        (F.col("rows_before") + F.coalesce(F.sum("copies").over(local), F.lit(0))).alias("row"),
    )
    middle = 2 * (F.col("offset") + F.col("copy") * F.col("size")) + F.col("size")
    at = each_copy(settle(offsets)).withColumn("middle", middle)
    shard = F.expr(f"cast(least({n_shards - 1}, middle * {n_shards} div (2 * all_bytes)) as int)")
    at = settle(at.select(*order, shard.alias("shard"), (F.col("row") + F.col("copy")).alias("at")))
    first = at.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return at.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
