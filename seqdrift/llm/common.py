"""Session helpers that the training-data operators share."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; invent one only for a local test session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seqdrift-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def settle(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder.

    Cuts the lineage and survives lost executors, like checkpoint(); unlike it, the plan's size estimate is the table's,
    not the product of all joins so far, which grows beyond bounds over the rounds of an iterative operator.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def settle_bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """Like settle(), written in buckets by ``column``: a join on it shuffles the other side only."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"settled_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, column).option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of finished stages' shuffle files. Spark deletes them when the driver collects the objects that refer to
    them, which by itself may take half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of some megabytes, unless the session asks for a size of its own."""
    name, usual = "spark.sql.execution.arrow.maxBytesPerBatch", ("64MB", "67108864b", "67108864")
    if spark.conf.get(name, usual[0]) in usual:
        spark.conf.set(name, "4m")


def nested(df: DataFrame, **more: Column) -> DataFrame:
    """The table's columns inside one, ``row``, beside some more: so no name of the table's can clash with ours."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


#: Stands for a null doc_id, which sorts first.
NULL_ID = -(1 << 63)


def key_columns() -> dict[str, Column]:
    """What a row's text is known by: doc_id, null as the least number, and a hash that tells texts of one id apart."""
    return {"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "h": F.xxhash64("text")}


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(n) for n, c in key_columns().items()], F.col("text").cast("string").alias("text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows, all columns, whose (k, h) is not in ``gone``, a settled table of distinct keys. Only rows whose key may
    be there are shuffled."""
    some, stay = split_by_keys(nested(docs, **key_columns()), gone, ["k", "h"])
    kept = some.join(gone.hint("shuffle_hash"), ["k", "h"], "left_anti")
    return stay.unionByName(kept.select(*stay.columns)).select("row.*")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Copies of one row that one task numbers in a row.
COPIES = 1 << 16


def counted_rows(df: DataFrame) -> DataFrame:
    """The distinct rows, settled, with ``copies``, how often each occurs."""
    return settle(df.groupBy(*df.columns).agg(F.count("*").alias("copies")))


def each_copy(counted: DataFrame) -> DataFrame:
    """As many rows as ``copies`` says, with ``copy``: 0, 1, ... among equal ones, whatever partitions they came from.

    They are written out in blocks that are dealt out, so a row that makes up a third of the table is no one task's work.
    """
    few = counted.where(F.col("copies") <= COPIES).withColumn("first", F.lit(0).cast("long"))
    many = counted.where(F.col("copies") > COPIES)
    if not many.isEmpty():
        blocks = many.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
        few = few.unionByName(blocks.repartition(shuffle_width(counted.sparkSession), *counted.columns, "first"))
    last = F.least(F.col("copies"), F.col("first") + COPIES) - 1
    return few.withColumn("copy", F.explode(F.sequence("first", last))).drop("first", "copies")


def groups_for(rows: int, per_group: int) -> int:
    return max(1, math.ceil(rows / per_group))


#: 64-bit words of a key filter: its size, 4 MB, does not depend on the number of keys.
FILTER_WORDS = 1 << 18


def split_by_keys(df: DataFrame, keys: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, rows whose key is not), without a shuffle of ``df``.

    The keys become a bitmap of fixed size (one hash, ``FILTER_WORDS`` rows at most), which is broadcast. With very many
    keys it lets everything pass, which costs time and changes nothing. Key columns must not be null. Settle ``keys``
    first: it is read twice.
    """
    h = F.xxhash64(*columns)
    word, bit = h.bitwiseAND(FILTER_WORDS - 1), F.shiftrightunsigned(h, 18).bitwiseAND(63)
    bits = keys.select(word.alias("_word"), bit.cast("int").alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = df.withColumns({"_word": word, "_bit": bit.cast("int")}).join(F.broadcast(bits), "_word", "left")
    marked = marked.withColumn("_hit", F.coalesce(F.expr("shiftrightunsigned(_bits, _bit) & 1L"), F.lit(0)) == 1)
    return tuple(marked.where(c).drop("_word", "_bit", "_bits", "_hit") for c in (F.col("_hit"), ~F.col("_hit")))


def running_total(df: DataFrame, order: list[str], weight: str) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over all rows that sort before, over the whole table.

    Rows are range-partitioned and sorted; one total a partition is prefix-summed and added to the local sums. ``order``
    must tell rows apart (count equal rows first), which also keeps the ranges even.
    """
    ordered = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = settle(ordered.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftrightunsigned("place", 33))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.sum(weight).alias("w")).select("part", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("start"))
    local = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(F.broadcast(starts), "part").withColumn("before", F.col("start") + F.coalesce(F.sum(weight).over(local), F.lit(0)))
    return summed.drop("part", "place", "start")
