"""Images as rows of pixels (by, y, values): binning, colour, spectra, crops and planes.

An image row is one record: a contiguous array of x values.  ``by`` names the image (path, hdu, plane or any key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.functions.scalar import is_finite
from starframe.operators import _groups as G
from starframe.operators import stats

#: Most samples on a side of a bin.
MOST_SAMPLES = 64


def bin_plan(width: int, height: int, max_width: int, max_height: int, samples: int = 4) -> dict[str, int]:
    """Factor, output size and samples on a side of a bin; pixels right of and below whole bins are left out."""
    f = max(1, -(-width // max_width), -(-height // max_height))
    k = min(f if samples <= 0 else min(samples, f), MOST_SAMPLES)
    return {"factor": f, "width": max(1, width // f), "height": max(1, height // f), "samples": k}


def samples_within(width: int, height: int, bytes_per_pixel: int, factor: int, samples: int, limit: int = 2 << 30) -> int:
    """Samples on a side such that the rows read add up to ``limit`` bytes at most, down to one row for each row of the result."""
    rows = max(1, height // factor)
    while samples > 1 and rows * samples * width * bytes_per_pixel > limit:
        samples -= 1
    return samples


def offsets(factor: int, samples: int) -> list[int]:
    """The pixels of a bin that are read, on one side."""
    return list(range(factor)) if samples >= factor else [((2 * i + 1) * factor) // (2 * samples) for i in range(samples)]


def bin2d(pixels: DataFrame, factor: int, width: int, height: int, samples: int = 0, by: list[str] = (), y: str = "y", values: str = "values") -> DataFrame:
    """Means of the finite pixels of each factor x factor bin: by, oy, ox, value (null where none is), n.

    With fewer ``samples`` than the factor, only the pixels at :func:`offsets` count, and other rows are filtered out first.  Sums
    are formed within each row of pixels, so ``width`` numbers of it are shuffled and not its pixels.
    """
    own, keys = G.keys(pixels, list(by))
    use = offsets(factor, samples if samples > 0 else factor)
    rows = own.where((F.col(y) >= 0) & (F.col(y) < height * factor))
    if len(use) < factor:
        rows = rows.where((F.col(y) % factor).isin(use))
        cell = lambda ox: F.array(*(F.try_element_at(values, (ox * factor + o + 1).cast("int")) for o in use))
    else:
        cell = lambda ox: F.slice(values, ox * factor + 1, factor)
    good = lambda ox: F.filter(cell(ox), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    parts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda ox: F.struct(ox.alias("ox"), good(ox).alias("v")))
    parts = F.transform(parts, lambda p: F.struct(p["ox"].alias("ox"), F.aggregate(p["v"], F.lit(0.0), lambda a, v: a + v.cast("double")).alias("s"), F.size(p["v"]).cast("long").alias("n")))
    cells = rows.select(*keys, F.floor(F.col(y) / factor).cast("int").alias("oy"), F.inline(parts))
    out = cells.groupBy(*keys, "oy", "ox").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("value"), F.sum("n").alias("n"))
    return G.tidy(out)


def bin2d_points(df: DataFrame, x: str, y: str, value: str, factor_x: float, factor_y: float | None = None, by: list[str] = ()) -> DataFrame:
    """The same on a table of (x, y, value): by, oy, ox, value, n."""
    own, keys = G.keys(df, list(by))
    v = F.when(is_finite(F.col(value)), F.col(value).cast("double"))
    out = own.groupBy(*keys, F.floor(F.col(y) / (factor_y or factor_x)).cast("long").alias("oy"), F.floor(F.col(x) / factor_x).cast("long").alias("ox")).agg(F.avg(v).alias("value"), F.count(v).alias("n"))
    return G.tidy(out)


def bayer_channel(x: Column, y: Column, pattern: Column | str, height: int, x_offset: int = 0, y_offset: int = 0, bottom_up: bool = False) -> Column:
    """The colour letter over a pixel of a mosaic of four-letter cells."""
    row = y.bitwiseXOR(F.lit((height - 1) & 1 if bottom_up else 0)) + y_offset
    at = (row.bitwiseAND(F.lit(1))) * 2 + (x + x_offset).bitwiseAND(F.lit(1)) + 1
    return F.substring(F.lit(pattern) if isinstance(pattern, str) else pattern, at.cast("int"), F.lit(1))


def bin_bayer(pixels: DataFrame, pattern: str, width: int, height: int, factor: int = 1, x_offset: int = 0, y_offset: int = 0, bottom_up: bool = False, by: list[str] = (), y: str = "y", values: str = "values") -> DataFrame:
    """Means by colour of a mosaic; ``factor`` counts 2x2 cells: by, oy, ox, channel, value, n.  Odd last rows and columns are left out."""
    own, keys = G.keys(pixels, list(by))
    w, h = width // 2 // factor, height // 2 // factor
    rows = own.where((F.col(y) >= 0) & (F.col(y) < h * 2 * factor)).select(*keys, F.col(y).cast("int").alias("_y"), F.posexplode(F.slice(values, 1, w * 2 * factor)).alias("_x", "_v"))
    v = F.when(is_finite(F.col("_v")), F.col("_v").cast("double"))
    channel = bayer_channel(F.col("_x"), F.col("_y"), pattern, height, x_offset, y_offset, bottom_up)
    out = rows.groupBy(*keys, F.floor(F.col("_y") / (2 * factor)).cast("int").alias("oy"), F.floor(F.col("_x") / (2 * factor)).cast("int").alias("ox"), channel.alias("channel")).agg(F.avg(v).alias("value"), F.count(v).alias("n"))
    return G.tidy(out)


def rgb(binned: DataFrame, channel: str = "channel", by: list[str] = ()) -> DataFrame:
    """One row for each cell of three binned planes (channel 0, 1, 2): red, green, blue, opaque (all three are finite)."""
    own, keys = G.keys(binned, list(by))
    out = own.groupBy(*keys, "oy", "ox").pivot(channel, [0, 1, 2]).agg(F.max("value"))
    out = out.withColumnsRenamed({"0": "red", "1": "green", "2": "blue"})
    return G.tidy(out.withColumn("opaque", is_finite(F.col("red")) & is_finite(F.col("green")) & is_finite(F.col("blue"))))


def envelope_row(pixels: DataFrame, width: int = 1024, by: list[str] = (), values: str = "values") -> DataFrame:
    """Spectra kept as one row of pixels: by, c, lo, hi (float), n; value i of W falls into column ((i + 1) n_col - 1) / W, cut."""
    own, keys = G.keys(pixels, list(by))
    size = F.size(values)
    rows = own.select(*keys, size.alias("_w"), F.least(size, F.lit(width)).alias("_n"), F.posexplode(values).alias("_i", "_v")).where(is_finite(F.col("_v")))
    v = F.col("_v").cast("float")
    c = F.floor(((F.col("_i").cast("long") + 1) * F.col("_n") - 1) / F.col("_w")).cast("int")
    return G.tidy(rows.groupBy(*keys, c.alias("c")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n")))


def crop_plan(x: int, y: int, w: int, h: int, width: int, height: int, bayer: bool = False) -> tuple[int, int, int, int]:
    """A region clamped to the image, of one pixel at least; of a mosaic, grown to whole 2x2 cells."""
    x0, y0 = min(max(x, 0), width - 1), min(max(y, 0), height - 1)
    x1, y1 = min(max(x + w, x0 + 1), width), min(max(y + h, y0 + 1), height)
    if bayer:
        x0, y0, x1, y1 = x0 // 2 * 2, y0 // 2 * 2, min(-(-x1 // 2) * 2, width // 2 * 2), min(-(-y1 // 2) * 2, height // 2 * 2)
    return x0, y0, x1 - x0, y1 - y0


def crop(pixels: DataFrame, x: int, y: int, w: int, h: int, column: str = "y", values: str = "values") -> DataFrame:
    """Rows y to y + h, pixels x to x + w; the filter on rows reaches the source."""
    return pixels.where((F.col(column) >= y) & (F.col(column) < y + h)).withColumn(values, F.slice(values, x + 1, w))


def select_plane(pixels: DataFrame, plane: int | list[int] | None = None, planes: int = 1, column: str = "plane") -> DataFrame:
    """The middle plane, a given one (the last if beyond), or several."""
    if isinstance(plane, list):
        return pixels.where(F.col(column).isin(plane))
    return pixels.where(F.col(column) == (planes // 2 if plane is None else min(plane, planes - 1)))


def stretched(cells: DataFrame, stretch: DataFrame, by: list[str] = (), value: str = "value") -> DataFrame:
    """Adds level (0..255, null where missing) to binned cells, by the stretch of the whole image: a zoomed part keeps its look."""
    from starframe.functions.scalar import stretch8

    own, keys = G.keys(cells, list(by))
    look = G.keys(stretch, list(by))[0].select(*keys, "c0", "inv", "m")
    out = G.attach(own, look, keys).withColumn("level", F.when(is_finite(F.col(value)), stretch8(F.col(value), F.col("c0"), F.col("inv"), F.col("m"))))
    return G.tidy(out.drop("c0", "inv", "m"))


def reference_positions(width: int, height: int, most: int = 200_000) -> tuple[list[int] | None, list[int] | None]:
    """Rows and columns of the view that statistics use (none: all)."""
    if width * height <= most:
        return None, None
    r = min(max(-(-most // width), 128), height)
    c = min(max(most // r, 1), width)
    pick = lambda n, size: [((2 * i + 1) * size) // (2 * n) for i in range(n)]
    return pick(r, height), pick(c, width)


def reference_sample(pixels: DataFrame, width: int, height: int, by: list[str] = (), y: str = "y", values: str = "values", side: int = 2560, most: int = 200_000) -> DataFrame:
    """The values that a stretch is made from, the same for a picture of any size: the image binned to 2560 a side with up to 4x4
    samples, then rows and columns spread evenly over that; where they hold under 1000 finite values, the first ``most`` finite cells
    in the order of the view."""
    plan = bin_plan(width, height, side, side, 4)
    cells = bin2d(pixels, plan["factor"], plan["width"], plan["height"], plan["samples"], by, y, values).where(is_finite(F.col("value")))
    rows, cols = reference_positions(plan["width"], plan["height"], most)
    if rows is None:
        return cells
    grid = cells.where(F.col("oy").isin(sorted(set(rows))) & F.col("ox").isin(sorted(set(cols))))
    own, keys = G.keys(grid, list(by))
    few = G.keys(cells.select(*by).distinct() if by else cells.limit(1).select(), list(by))[0].distinct().alias("l").join(own.groupBy(*keys).agg(F.count("*").alias("_n")).alias("r"), G.same("l", "r", keys), "left").select("l.*", (F.coalesce("r._n", F.lit(0)) < 1000).alias("_few"))
    enough = G.tidy(G.attach(own, few.where(~F.col("_few")), keys).drop("_few"))
    # The view has width * height cells at most, so a rank by position is a bounded window for each image.
    first = G.attach(G.keys(cells, list(by))[0], few.where("_few"), keys).drop("_few").where(F.col("oy") * plan["width"] + F.col("ox") < F.lit(side * side))
    from pyspark.sql import Window

    first = G.tidy(first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("oy", "ox"))).where(F.col("_k") <= most).drop("_k"))
    return enough.unionByName(first)


def auto_stretch_of(pixels: DataFrame, width: int, height: int, by: list[str] = ()) -> DataFrame:
    return stats.auto_stretch(reference_sample(pixels, width, height, by), "value", by)
