"""Light curves, spectra and sky positions as tables of points: ranges, envelopes, density grids, line segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starframe.functions.scalar import density_shade, from_loglam, is_finite, on_sphere, wrap180
from starframe.operators import _groups as G
from starframe.operators import stats


def points(df: DataFrame, x: str, y: str, by: list[str] = (), sky: bool = False, xlog: bool = False) -> DataFrame:
    """by, x, y of the points that can be plotted; only these columns reach the scan.  ``xlog``: x is a decimal logarithm."""
    out = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if xlog:
        out = out.withColumn("x", from_loglam(F.col("x")))
    ok = is_finite(F.col("x")) & is_finite(F.col("y"))
    return out.where(ok & on_sphere(F.col("x"), F.col("y")) if sky else ok)


def axis_ranges(df: DataFrame, x: str, y: str, by: list[str] = (), sky: bool = False, xlog: bool = False) -> DataFrame:
    """Per group: n, x_min, x_max, y_min, y_max, and the range of x wrapped to -180..180 (w_min, w_max): one aggregate."""
    own, by = G.keys(points(df, x, y, by, sky, xlog), list(by))
    w = wrap180(F.col("x"))
    return G.tidy(own.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min(w).alias("w_min"), F.max(w).alias("w_max")))


def sky_wrap(ranges: DataFrame) -> DataFrame:
    """Adds ``wrap``: right ascensions above 180 become negative where that narrows the field by more than a degree; x_min and x_max follow."""
    wrap = F.col("w_max") - F.col("w_min") < F.col("x_max") - F.col("x_min") - 1
    out = ranges.withColumn("wrap", wrap)
    return out.withColumn("x_min", F.when(F.col("wrap"), F.col("w_min")).otherwise(F.col("x_min"))).withColumn("x_max", F.when(F.col("wrap"), F.col("w_max")).otherwise(F.col("x_max")))


def columns_of(ranges: DataFrame, width: int = 1024, dots: bool = False) -> DataFrame:
    """Adds n_col, the centres x_first and x_last of the outer columns, and ``_per`` (columns per unit of x)."""
    span = F.col("x_max") - F.col("x_min")
    most = min(width, 1600) if dots else width
    some = is_finite(span) & (span > 0)
    out = ranges.withColumn("n_col", F.when(some, F.least(F.lit(most).cast("bigint"), F.col("n"))).otherwise(1).cast("int"))
    wide = F.col("n_col") > 1
    return (
        out.withColumn("_per", F.when(wide, F.col("n_col") / span).otherwise(0.0))
        .withColumn("x_first", F.when(wide, F.col("x_min") + 0.5 * span / F.col("n_col")).otherwise(0.5 * F.col("x_min") + 0.5 * F.col("x_max")))
        .withColumn("x_last", F.when(wide, F.col("x_max") - 0.5 * span / F.col("n_col")).otherwise(0.5 * F.col("x_min") + 0.5 * F.col("x_max")))
    )


def column_of(x: Column) -> Column:
    """The column of x, given the group's x_min, n_col and _per."""
    return F.greatest(F.lit(0), F.least(F.col("n_col") - 1, ((x - F.col("x_min")) * F.col("_per")).cast("int")))


def _placed(df: DataFrame, x: str, y: str, by: list[str], width: int, sky: bool, xlog: bool, dots: bool, more: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Points with the plan of their group: a second pass over the same points."""
    ranges = axis_ranges(df, x, y, by, sky, xlog)
    ranges = columns_of(sky_wrap(ranges) if sky else ranges.withColumn("wrap", F.lit(False)), width, dots)
    ranges, keys = G.keys(ranges.drop("y_min", "y_max"), list(by))
    if more is not None:
        ranges = G.attach(ranges, G.keys(more, list(by))[0], keys)
    own, _ = G.keys(points(df, x, y, by, sky, xlog), list(by))
    plan = ranges.select(*keys, "x_min", "n_col", "_per", "wrap", *([c for c in more.columns if c not in by] if more is not None else []))
    out = G.attach(own, plan, keys)
    return out.withColumn("x", F.when(F.col("wrap"), wrap180(F.col("x"))).otherwise(F.col("x"))).withColumn("c", column_of(F.col("x"))), keys


def envelope(df: DataFrame, x: str, y: str, width: int = 1024, by: list[str] = (), sky: bool = False, xlog: bool = False, dots: bool = False) -> DataFrame:
    """Per group and column: lo and hi of y (rounded to float, as plots keep them) and n; columns without points have no row."""
    placed, keys = _placed(df, x, y, list(by), width, sky, xlog, dots)
    v = F.col("y").cast("float")
    return G.tidy(placed.groupBy(*keys, "c").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n")))


def density_grid(df: DataFrame, x: str, y: str, width: int = 1024, by: list[str] = (), sky: bool = False, xlog: bool = False) -> DataFrame:
    """Per group, column and row of the plot's grid: the number of points, and dots, the same up to 255.  Rows cover
    :func:`starframe.operators.stats.plot_range` of y; points off it have no cell."""
    own = points(df, x, y, list(by), sky, xlog)
    span = stats.plot_range(own, "y", list(by)).select(*by, "y_min", "y_max")
    placed, keys = _placed(df, x, y, list(by), width, sky, xlog, True, span)
    rows = F.greatest(F.lit(16), F.least(F.lit(1024), F.floor(F.col("n_col") * 3 / 4)))
    placed = placed.withColumn("n_row", rows.cast("int")).withColumn("_r", (F.col("y") - F.col("y_min")) * (F.col("n_row") / (F.col("y_max") - F.col("y_min"))))
    cells = placed.where((F.col("_r") >= 0) & (F.col("_r") < F.col("n_row"))).groupBy(*keys, "c", F.col("_r").cast("int").alias("r")).agg(F.count("*").alias("n"))
    return G.tidy(cells.withColumn("dots", F.least(F.col("n"), F.lit(255)).cast("int")))


def density_shades(grid: DataFrame, cells: int, by: list[str] = ()) -> DataFrame:
    """Adds shade to a density grid: brighter where fuller, if over an eighth of the ``cells`` of the grid is occupied."""
    grid, keys = G.keys(grid, list(by))
    peak = grid.groupBy(*keys).agg(F.max("dots").alias("_peak"), F.count("*").alias("_used"))
    out = G.attach(grid, peak, keys)
    crowded = (F.col("_used") * 8 > cells) & (F.col("_peak") > 1)
    return G.tidy(out.withColumn("shade", F.when(crowded, density_shade(F.col("dots").cast("double"), F.col("_peak").cast("double"))).otherwise(255.0)).drop("_peak", "_used"))


def line_segments(columns: DataFrame, n_col: int, by: list[str] = (), c: str = "c") -> DataFrame:
    """Adds segment: the line of a plot bridges up to max(2, n_col / 50) empty columns and breaks at longer gaps."""
    columns, keys = G.keys(columns, list(by))
    w = Window.partitionBy(*keys).orderBy(c)
    broken = F.coalesce((F.col(c) - F.lag(c).over(w) > max(2, n_col // 50) + 1).cast("int"), F.lit(0))
    return G.tidy(columns.withColumn("_broken", broken).withColumn("segment", F.sum("_broken").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_broken"))


def plot_axes(ranges: DataFrame, x_label: str, y_label: str, x_unit: str = "", y_unit: str = "", sky: bool = False, xlog: bool = False, dots: bool = False) -> DataFrame:
    """One row of axis metadata per plot, from ranges with their columns: labels, units, flips and centres."""
    label = ("wavelength" if x_label[:1].islower() else "WAVELENGTH") if xlog else x_label
    return ranges.drop("_per").withColumns(
        {
            "x_label": F.lit(label), "x_unit": F.lit("Angstrom" if xlog else x_unit), "y_label": F.lit(y_label), "y_unit": F.lit(y_unit),
            "x_flip": F.lit(sky), "y_flip": F.lit(y_label.upper().startswith("MAG")), "points": F.lit(dots),
        }
    )
