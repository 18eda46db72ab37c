"""Joins of rows whose ranges overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[str, str], right_range: tuple[str, str], width: int) -> DataFrame:
    """Rows of both tables that agree in ``on`` and whose half-open ranges have a place in common, once each.

    An equi-join: either row stands in every bin of ``width`` places that its range touches, and a pair is kept in the first bin that
    both touch.  So one key with very long ranges is dealt to as many tasks as it has bins.  Empty ranges and null limits match nothing;
    other columns must have different names.
    """

    def binned(df: DataFrame, limits: tuple[str, str], first: str) -> DataFrame:
        low, high = (F.col(c).cast("long") for c in limits)
        own = df.where(low < high).withColumn(first, F.floor(low / width))
        return own.withColumn("_bin", F.explode(F.sequence(F.col(first), F.floor((high - 1) / width))))

    both = binned(left, left_range, "_first").join(binned(right, right_range, "_other"), [*on, "_bin"])
    meet = (F.col(left_range[0]) < F.col(right_range[1])) & (F.col(right_range[0]) < F.col(left_range[1]))
    return both.where(meet & (F.col("_bin") == F.greatest("_first", "_other"))).drop("_bin", "_first", "_other")


def running(df: DataFrame, by: list[str], order: str, size: str, start: str) -> DataFrame:
    """Adds ``start``: the sum of ``size`` over the rows before, in each group of ``by``."""
    from pyspark.sql import Window

    return df.withColumn(start, F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
