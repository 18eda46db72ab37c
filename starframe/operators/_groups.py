"""Grouping columns: a list of names, possibly empty, whose values may be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.functions.shared import cut

ONE = "_all"


def keys(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """The grouping columns to use; without any, one group of all rows."""
    return (df, list(by)) if by else (df.withColumn(ONE, F.lit(0)), [ONE])


def same(left: str, right: str, names: list[str]) -> Column:
    out = F.lit(True)
    for k, n in enumerate(names):
        one = F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
        out = one if k == 0 else out & one
    return out


#: A table of groups with fewer rows (each a few numbers) is broadcast; of a larger one Spark shuffles both sides.
BROADCAST_GROUPS = 100_000


def attach(df: DataFrame, per_group: DataFrame, names: list[str]) -> DataFrame:
    """Adds the columns of a table with one row per group.

    That table is computed and counted first: below BROADCAST_GROUPS rows it goes to the rows of ``df``, which then stay where they are.
    Without grouping columns it has one row, whose values become constants (none: no row of ``df`` has a group).
    """
    more = [c for c in per_group.columns if c not in names]
    if not names:
        row = per_group.first()
        made = {c: F.lit(row[c] if row else None).cast(per_group.schema[c].dataType) for c in more}
        return (df if row else df.limit(0)).withColumns(made)
    per_group = cut(per_group.select(*names, *more))
    if per_group.count() < BROADCAST_GROUPS:
        per_group = F.broadcast(per_group)
    return df.alias("l").join(per_group.alias("r"), same("l", "r", names), "inner").select("l.*", *(F.col(f"r.{c}") for c in more))


def tidy(df: DataFrame) -> DataFrame:
    return df.drop(ONE)
