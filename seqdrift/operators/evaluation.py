"""Thresholds, confusion counts, ROC curves and histograms of score tables (columns: score, is_ood)."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqdrift.operators.scoring import OODDetector


def pooled(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """One table of scores: ``is_ood`` tells the out-of-distribution rows."""
    return inside.select("score", F.lit(False).alias("is_ood")).unionByName(outside.select("score", F.lit(True).alias("is_ood")))


def threshold(scores: DataFrame, method: str = "percentile", value: float | None = None) -> float:
    """``value``: the number itself. ``percentile``: exact interpolated quantile of all scores; by default the share of
    in-distribution rows."""
    if method == "value":
        if value is None:
            raise ValueError("give a threshold")
        return float(value)
    if method != "percentile":
        raise ValueError(f"method must be value or percentile, not {method}")
    if value is None:
        value = scores.agg(F.avg(F.when(F.col("is_ood"), 0.0).otherwise(1.0))).first()[0]
    return percentiles(scores, "score", [float(value)])[0]


def counts_below(df: DataFrame, column: str, *counts: Column) -> DataFrame:
    """(value, n0, n1, ..., below0, below1, ...): each distinct value's counts, and those of all lesser values.

    Values are counted, range-partitioned and sorted; one row of totals a partition gives what comes before it.
    """
    names = [f"n{i}" for i in range(len(counts))]
    by = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(*[c.alias(n) for c, n in zip(counts, names, strict=True)])
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = by.repartitionByRange(width, "value").withColumn("part", F.spark_partition_id()).persist()
    totals = placed.groupBy("part").agg(*[F.sum(n).alias(n) for n in names]).orderBy("part").collect()
    local = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out, before = placed, {n: 0 for n in names}
    starts = []
    for row in totals:
        starts.append((row["part"], *before.values()))
        before = {n: before[n] + row[n] for n in names}
    if not starts:
        return placed.select("value", *names, *[F.lit(0).cast("long").alias(f"below{i}") for i in range(len(names))])
    table = df.sparkSession.createDataFrame(starts, "part int, " + ", ".join(f"start{i} long" for i in range(len(names))))
    out = out.join(F.broadcast(table), "part")
    return out.select("value", *names, *[(F.col(f"start{i}") + F.coalesce(F.sum(n).over(local), F.lit(0))).alias(f"below{i}") for i, n in enumerate(names)])


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """Exact interpolated quantiles of a column, as one list; None without rows. Two order statistics each are picked
    from counts by value, so no task holds all values."""
    ranked = counts_below(df, column, F.count("*"))
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    places = sorted({p for s in shares for p in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    wanted = df.sparkSession.createDataFrame([(p,) for p in places], "place long")
    inside = (F.col("place") >= F.col("below0")) & (F.col("place") < F.col("below0") + F.col("n0"))
    found = {r["place"]: r["value"] for r in ranked.join(F.broadcast(wanted), inside).select("place", "value").collect()}
    out = []
    for s in shares:
        at = s * (n - 1)
        low, high = math.floor(at), math.ceil(at)
        out.append(found[low] if low == high else (high - at) * found[low] + (at - low) * found[high])
    return out


def confusion(scores: DataFrame, at: float) -> DataFrame:
    """One row: tp, fn, fp, tn, tpr, fpr. A score over the threshold is positive."""
    hit = F.col("score") > at
    counts = scores.agg(
        F.count_if(F.col("is_ood") & hit).alias("tp"),
        F.count_if(F.col("is_ood") & ~hit).alias("fn"),
        F.count_if(~F.col("is_ood") & hit).alias("fp"),
        F.count_if(~F.col("is_ood") & ~hit).alias("tn"),
    )
    return counts.withColumns({"tpr": F.try_divide("tp", F.col("tp") + F.col("fn")), "fpr": F.try_divide("fp", F.col("fp") + F.col("tn"))})


def roc(scores: DataFrame, points: int = 100) -> DataFrame:
    """(t_idx, threshold, tpr, fpr) at ``points`` evenly spaced percentiles.

    All percentiles come from one aggregation and all counts from a second: scores are binned against the (few)
    thresholds, and counts over a threshold are sums over bins. Nothing is re-scored or cross-joined.
    """
    grid = [i / (points - 1) for i in range(points)]
    cuts = percentiles(scores, "score", grid)
    spark = scores.sparkSession
    if cuts is None:
        return spark.createDataFrame([], "t_idx int, threshold double, tpr double, fpr double")
    array = F.array(*[F.lit(c) for c in cuts])
    over = F.aggregate(array, F.lit(0), lambda s, c: s + F.when(F.col("score") > c, 1).otherwise(0))
    bins = scores.select("is_ood", over.alias("over")).groupBy("over").agg(F.count_if("is_ood").alias("ood"), F.count_if(~F.col("is_ood")).alias("inside"))
    # A score over the j-th of the ascending cuts is over more than j of them.
    down = Window.orderBy(F.col("over").desc())
    spine = spark.range(points + 1).select(F.col("id").cast("int").alias("over")).join(bins, "over", "left").fillna(0)
    sums = spine.withColumns({"tp": F.sum("ood").over(down), "fp": F.sum("inside").over(down), "all_ood": F.sum("ood").over(Window.partitionBy()), "all_in": F.sum("inside").over(Window.partitionBy())})
    return sums.where("over > 0").select((F.col("over") - 1).alias("t_idx"), F.element_at(array, F.col("over")).alias("threshold"), F.try_divide("tp", "all_ood").alias("tpr"), F.try_divide("fp", "all_in").alias("fpr"))


def auroc(scores: DataFrame, points: int = 100) -> DataFrame:
    """One row: trapezoid area under ``roc`` ordered by (fpr, tpr), without an added end point."""
    order = Window.orderBy("fpr", "tpr")
    steps = roc(scores, points).select(((F.col("fpr") - F.lag("fpr").over(order)) * (F.col("tpr") + F.lag("tpr").over(order)) / 2).alias("area"))
    return steps.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("auroc"))


def mann_whitney_auroc(scores: DataFrame) -> DataFrame:
    """One row: the exact area, ties counting half, from counts by score value."""
    won = counts_below(scores, "score", F.count_if("is_ood"), F.count_if(~F.col("is_ood")))
    return won.agg((F.sum(F.col("n0") * (F.col("below1") + F.col("n1") / 2)) / (F.sum("n0") * F.sum("n1"))).alias("auroc"))


def histogram(scores: DataFrame, bins: int = 50, index: str | None = None, listed: int = 20) -> DataFrame:
    """(bin, low, high, is_ood, n[, label]): equal-width bins over all scores, empty ones included; the last is closed.

    With an ``index`` column, ``label`` lists the first ``listed`` indices of a bin and how many more there are.
    """
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col("score") - low) / width), F.lit(bins - 1)).cast("int")
    rows = scores.withColumn("bin", place)
    counts = rows.groupBy("bin", "is_ood").agg(F.count("*").alias("n"))
    if index:
        # Only the lowest ``listed`` indices of a bin are ever gathered: each task keeps its own lowest before the shuffle.
        ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy("bin", "is_ood").orderBy(index))).where(F.col("rank_") <= listed)
        counts = counts.join(ranked.groupBy("bin", "is_ood").agg(F.array_sort(F.collect_list(index)).alias("first_")), ["bin", "is_ood"])
    spark = scores.sparkSession
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("is_ood", F.explode(F.array(F.lit(False), F.lit(True))))
    out = spine.join(counts, ["bin", "is_ood"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    columns = ["bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "is_ood", "n"]
    if index:
        more = F.when(F.col("n") > listed, F.concat(F.lit(" (+"), (F.col("n") - listed).cast("string"), F.lit(" more)"))).otherwise("")
        columns.append(F.concat(F.array_join(F.coalesce("first_", F.array().cast("array<bigint>")).cast("array<string>"), ","), more).alias("label"))
    return out.select(*columns)


def run_ood_detection(detector: OODDetector, inside: DataFrame, outside: DataFrame, percentile: float = 0.7) -> dict:
    """Threshold, confusion, area and the score tables of one detector."""
    scores = pooled(detector.score(inside), detector.score(outside)).persist()
    at = threshold(scores, "percentile", percentile)
    row = confusion(scores, at).first()
    return {
        "threshold": at,
        "confusion_matrix": [[row.tp, row.fn], [row.fp, row.tn]],
        "true_positive_rate": row.tpr,
        "false_positive_rate": row.fpr,
        "auroc": auroc(scores).first().auroc,
        "scores": scores,
    }


def experiment_grid(spark, **axes: Iterable) -> DataFrame:
    """Every combination of named settings, one row each."""
    grid = spark.range(1)
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return grid.drop("id")


def dataset_splits(samples: DataFrame, label: str, inside: Iterable, holdout_modulus: int = 5, id_col: str = "sample_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, in-distribution test, out-of-distribution test): every ``holdout_modulus``-th in-distribution id is held out."""
    is_in, held = F.col(label).isin(list(inside)), F.col(id_col) % holdout_modulus == 0
    return samples.where(is_in & ~held), samples.where(is_in & held), samples.where(~is_in)
