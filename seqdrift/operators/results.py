"""Analytics over recorded experiments (transformations, scoring_function, confusion_matrix, rates, auroc)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unnest_confusion(stats: DataFrame) -> DataFrame:
    """The matrix is [[TP, FN], [FP, TN]]; its cells become named columns."""
    m = F.col("confusion_matrix")
    return stats.withColumns({"tp": m[0][0], "fn": m[0][1], "fp": m[1][0], "tn": m[1][1]}).drop("confusion_matrix")


def with_enough(stats: DataFrame, least: int = 100) -> DataFrame:
    return stats.withColumn("total", F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).where(F.col("total") >= least)


def ranked(stats: DataFrame, by: str = "auroc") -> DataFrame:
    """Best first, with a rank from 0; ties by transformations and scoring function."""
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), "transformations", "scoring_function")) - 1)


def overview(stats: DataFrame, column: str = "auroc") -> DataFrame:
    return stats.agg(F.count("*").alias("n"), F.max(column).alias("max"), F.min(column).alias("min"), F.avg(column).alias("mean"))


def top(stats: DataFrame, k: int = 20, by: str = "auroc") -> DataFrame:
    return stats.orderBy(F.col(by).desc(), "transformations", "scoring_function").limit(k)


def by_group(stats: DataFrame, key: str = "scoring_function", column: str = "auroc") -> DataFrame:
    return stats.groupBy(key).agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")).orderBy(F.col("mean").desc(), key)


def formatted(stats: DataFrame, *columns: str) -> DataFrame:
    return stats.withColumns({c: F.printf(F.lit("%.4f"), F.col(c)) for c in columns})
