"""Thresholds of score streams from mergeable quantile sketches (KLL, Spark's own).

A value's share of the scores is off by at most ``rank_error(k)``, at 99 % confidence, however many scores and merges there
are. ``evaluation.percentiles`` is the exact form, for a table at rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Size of a sketch: about 8 k bytes.
K = 4096


def rank_error(k: int = K) -> float:
    """The published fit of the sketch's one-sided rank error."""
    return 2.296 / k**0.9021


def sketches(scores: DataFrame, by: list[str] | None = None, k: int = K) -> DataFrame:
    """(by, sketch) of all scores that are numbers: of a table, or, as a stream's state, of all it has brought so far."""
    known = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return known.groupBy(*(by or [])).agg(F.kll_sketch_agg_double(F.col("score").cast("double"), F.lit(k)).alias("sketch"))


def keep(scores: DataFrame, path: str, checkpoint: str, by: list[str] | None = None, k: int = K) -> StreamingQuery:
    """Write each micro-batch's sketches of a score stream; a batch that is run again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        sketches(batch, by, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scores.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """(by, sketch): the kept sketches of all micro-batches, merged."""
    return merged(spark.read.parquet(path), by)


def merged(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return parts.where("sketch is not null").groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def thresholds(sketch_rows: DataFrame, shares: list[float]) -> DataFrame:
    """(by, share, score): the score that a share of the scores does not exceed; none where there were no scores."""
    others = [c for c in sketch_rows.columns if c != "sketch"]
    rows = sketch_rows.where("sketch is not null").where(F.kll_sketch_get_n_double("sketch") > 0)
    parts = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("score")) for s in shares])
    return rows.select(*others, F.explode(parts).alias("q")).select(*others, "q.share", "q.score")
