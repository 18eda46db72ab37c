"""Reproducible samples: windows of big tables, strides, one block of each stratum, and the spread within windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starframe.functions.scalar import is_finite
from starframe.operators import _groups as G
from starframe.operators import stats

WINDOWS, WINDOW_BYTES, READ_ALL, MOST_POINTS = 16384, 16384, 1 << 30, 20_000_000


def window_sample(data_off: int, row_bytes: int, rows: int, windows: int = WINDOWS, window_bytes: int = WINDOW_BYTES, read_all: int = READ_ALL) -> list[tuple[int, int]]:
    """Row ranges to read of a table: all of it, or, over 1 GiB (``read_all``), one window in each equal part, at a place fixed by the part's number.

    A window holds whole rows, or the one row that starts in it.  These become the scan's partitions.
    """
    if rows * row_bytes <= read_all or rows < windows:
        return [(0, rows)] if rows else []
    part = rows * row_bytes // windows
    with np.errstate(over="ignore"):
        z = np.arange(windows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    at = data_off + part * np.arange(windows, dtype=np.int64) + (z % np.uint64(part - window_bytes + 1)).astype(np.int64)
    at = np.maximum(at - at % window_bytes, data_off)
    a = (at - data_off + row_bytes - 1) // row_bytes
    b = np.maximum((at + window_bytes - data_off) // row_bytes, a + 1)
    return [(int(x), int(y)) for x, y in zip(np.minimum(a, rows), np.minimum(b, rows), strict=True) if y > x]


def stride_of(total: int, most: int = MOST_POINTS) -> int:
    return total // (most // 2) if total > most else 1


def stride_sample(df: DataFrame, step: int, k: str) -> DataFrame:
    """Every ``step``-th row by its number."""
    return df.where(F.col(k) % step == 0)


def stratified_block_sample(df: DataFrame, order: str, strata: int, block: int, low: int, high: int, seed: int = 0) -> DataFrame:
    """Of each of ``strata`` equal parts of an integer order (low to high), one block of ``block`` numbers, at a place fixed by the
    part and the seed.  A filter: nothing is shuffled or sorted."""
    part = max(1, (high - low + 1) // strata)
    at = F.floor((F.col(order) - low) / part)
    shift = F.pmod(F.xxhash64(at, F.lit(seed)), F.lit(max(1, part - block + 1)))
    within = F.col(order) - low - at * part
    return df.where((F.col(order) >= low) & (F.col(order) <= high) & (at < strata) & (within >= shift) & (within < shift + block))


def window_spread(df: DataFrame, x: str, y: str, window: str, by: list[str] = ()) -> DataFrame:
    """Per group: the median over windows (of two points at least) of the range of x and of y, relative to the whole ranges, and
    ``sorted``: under a quarter in either, so a table sorted by position."""
    own = df.where(is_finite(F.col(x)) & is_finite(F.col(y)))
    own, keys = G.keys(own, list(by))
    each = own.groupBy(*keys, window).agg(F.count("*").alias("_n"), (F.max(x) - F.min(x)).alias("_dx"), (F.max(y) - F.min(y)).alias("_dy")).where("_n > 1")
    whole = own.groupBy(*keys).agg((F.max(x) - F.min(x)).alias("_x"), (F.max(y) - F.min(y)).alias("_y"))
    half = {"m": stats.nearest_rank(0.5)}
    sx = stats.order_stats(each, "_dx", half, keys).select(*keys, F.col("m").alias("_mx"))
    sy = stats.order_stats(each, "_dy", half, keys).select(*keys, F.col("m").alias("_my"))
    out = G.attach(G.attach(whole, sx, keys), sy, keys)
    out = out.select(*keys, (F.col("_mx") / F.nullif(F.col("_x"), F.lit(0.0))).alias("spread_x"), (F.col("_my") / F.nullif(F.col("_y"), F.lit(0.0))).alias("spread_y"))
    return G.tidy(out.withColumn("sorted", (F.col("spread_x") < 0.25) | (F.col("spread_y") < 0.25)))


def middle_rows(df: DataFrame, window: str, order: str, by: list[str] = ()) -> DataFrame:
    """Of each window (of bounded size), its middle row by an order."""
    own, keys = G.keys(df, list(by))
    w = Window.partitionBy(*keys, window)
    return G.tidy(own.withColumn("_at", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w)).where(F.col("_at") == F.floor(F.col("_n") / 2)).drop("_at", "_n"))
