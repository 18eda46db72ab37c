"""Views of stored lists of units in one call: maps and curves of big tables, and binned views of images of any size.

Both read what the view needs only: windows of rows of tables beyond a size, and sampled rows of images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.functions.shared import cut
from starframe.functions.scalar import is_finite
from starframe.operators import _groups as G
from starframe.operators import points, sampling
from starframe.sources import planned

UNIT = ["path", "hdu"]


def sampled_points(units: DataFrame, x: str, y: str, kinds: tuple[str, str] = ("double", "double"), **windows: int) -> DataFrame:
    """Points (path, hdu, _row, x, y, sampled) that stand for each table of a stored list of units.

    Small tables give all their rows.  Of big ones windows of rows are read, at most ``windows * window_bytes`` bytes whatever their
    size; if the windows of a table cover little of its range in x or y (it is sorted by position), each gives its middle row only, so
    that no window shows as a clump.  Tables without the columns, and ranges that can't be read, give nothing.
    """
    ranges = cut(planned.table_windows(units, **windows))
    rows = planned.range_rows(ranges.drop("sampled"), f"{x} {kinds[0]}, {y} {kinds[1]}").where("error is null")
    rows = cut(rows.select(*UNIT, "_row", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    # Windows do not overlap but may touch, so a row's window is the last one that begins at or before it: an equi-join on bins.
    marks = ranges.where("sampled").select(*UNIT, F.col("low").alias("_low"), F.col("high").alias("_high"))
    placed = _windows(rows, marks)
    spread = sampling.window_spread(placed, "x", "y", "_low", UNIT).where("sorted").select(*UNIT)
    middle = sampling.middle_rows(placed.join(F.broadcast(spread) if spread.count() < 100_000 else spread, UNIT, "left_semi"), "_low", "_row", UNIT)
    loose = placed.join(spread, UNIT, "left_anti")
    whole = rows.join(marks.select(*UNIT).distinct(), UNIT, "left_anti")
    columns = [*UNIT, "_row", "x", "y"]
    return middle.unionByName(loose).select(*columns, F.lit(True).alias("sampled")).unionByName(whole.select(*columns, F.lit(False).alias("sampled")))


def _windows(rows: DataFrame, marks: DataFrame) -> DataFrame:
    from starframe.operators.ranges import overlap_join

    return cut(overlap_join(rows.withColumn("_next", F.col("_row") + 1), marks, UNIT, ("_row", "_next"), ("_low", "_high"), 65536).drop("_next").dropDuplicates([*UNIT, "_row"]))


def density_map(units: DataFrame, x: str, y: str, width: int = 1024, kinds: tuple[str, str] = ("double", "double"), sky: bool = False, **windows: int) -> DataFrame:
    """Per table: the cells of its map (path, hdu, c, r, n, dots), from the points that stand for it."""
    return points.density_grid(sampled_points(units, x, y, kinds, **windows), "x", "y", width, UNIT, sky)


def envelope_map(units: DataFrame, x: str, y: str, width: int = 1024, kinds: tuple[str, str] = ("double", "double"), **windows: int) -> DataFrame:
    """Per table: the columns of its curve (path, hdu, c, lo, hi, n), from the points that stand for it."""
    return points.envelope(sampled_points(units, x, y, kinds, **windows), "x", "y", width, UNIT)


def binned_images(units: DataFrame, max_width: int, max_height: int, samples: int = 4, planes: list[int] | None = None, limit: int = planned.SAMPLED_BYTES) -> DataFrame:
    """Means of the finite pixels of the bins that make each image fit a view: path, hdu, plane, oy, ox, value (null: none), n.

    Images may differ in size: rows of pixels meet the plan of their unit in a join.  Sums are made before the shuffle.
    """
    plans = cut(planned.bin_plans(units, max_width, max_height, samples, limit))
    rows = G.attach(planned.sampled_rows(units, plans, planes), plans, UNIT)
    rows = rows.withColumn("_at", planned.offsets_of(F.least(F.col("factor"), F.size("values").cast("long")), F.col("samples")))
    cells = rows.select(*UNIT, "plane", F.floor(F.col("y") / F.col("factor")).alias("oy"), "factor", "_at", "values", F.explode(F.sequence(F.lit(0).cast("long"), F.col("out_width") - 1)).alias("ox"))
    held = F.transform("_at", lambda o: F.get("values", (F.col("ox") * F.col("factor") + o).cast("int")))
    cells = cells.withColumn("_v", F.filter(held, lambda v: is_finite(v)))
    total = F.aggregate("_v", F.lit(0.0), lambda t, v: t + v)
    out = cells.groupBy(*UNIT, "plane", "oy", "ox").agg(F.sum(total).alias("_t"), F.sum(F.size("_v")).alias("n"))
    return out.select(*UNIT, "plane", "oy", "ox", F.when(F.col("n") > 0, F.col("_t") / F.col("n")).alias("value"), "n")
