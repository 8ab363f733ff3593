"""Row limits with a total order, so the same rows come out whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
