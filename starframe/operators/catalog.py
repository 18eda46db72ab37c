"""Listings of data units: what each is, what a file opens on, colour and row order.

``hdus`` has a row per unit: path, hdu, format (fits, xisf, asdf), xtension, extname, bitpix, naxes, bscale, bzero, supported,
error, and may have the axes that :func:`starframe.operators.tables.pick_axes` found, joined as kind, sky (null: no plot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.functions.scalar import type_name


def _axis(n: int) -> Column:
    return F.try_element_at("naxes", F.lit(n)).cast("long")


def is_image() -> Column:
    """Primary units, images and tile-compressed ones whose axes are all one at least."""
    return (F.col("format") != "fits") | ((F.col("hdu") == 0) | F.col("xtension").isin("IMAGE", "IUEIMAGE") | F.coalesce(F.col("zimage"), F.lit(False))) & (F.size("naxes") >= 1) & F.forall("naxes", lambda x: x >= 1) & ~F.coalesce(F.col("groups"), F.lit(False))


def classify_hdus(hdus: DataFrame) -> DataFrame:
    """Adds unit (image, plot, table; null: not listed), planes, n_rows, n_columns, element type."""
    w, h = _axis(1), F.coalesce(_axis(2), F.lit(1).cast("long"))
    planes = F.aggregate(F.slice("naxes", 3, 9), F.lit(1).cast("long"), lambda a, x: a * x)
    shown = is_image() & (F.coalesce(F.col("supported"), F.lit(True)) | (F.col("format") != "fits"))
    unit = (
        F.when(shown & (F.col("format") == "xisf"), "image")
        .when(shown, F.when((h == 1) | ((h <= 8) & (w >= 64 * h)), "plot").otherwise("image"))
        .when(is_image(), F.lit(None))
        .when(F.col("kind").isNotNull(), "plot")
        .when((F.size("naxes") == 2) & F.col("xtension").isin("BINTABLE", "TABLE") & ~F.coalesce(F.col("zimage"), F.lit(False)), "table")
    )
    table = ~is_image() & unit.isNotNull()
    return hdus.withColumns(
        {
            "unit": unit, "planes": F.when(shown, F.greatest(planes, F.lit(1))), "n_rows": F.when(table, _axis(2)), "n_columns": F.when(table, F.col("tfields")),
            "element": F.when(shown, F.coalesce(F.col("dtype"), type_name(F.col("bitpix"), F.col("bscale"), F.col("bzero")))),
        }
    )


def select_hdu(hdus: DataFrame, hdu: int | None = None) -> DataFrame:
    """What a file opens on: one row per path with hdu, is_table, is_sky, reason (null if there is something to show).

    The named unit, or an ASDF file's preferred array, else the first image of two pixels a side or table with axes, else the first
    row of pixels.  ``preferred`` marks the ASDF array.
    """
    own = classify_hdus(hdus)
    if hdu is not None:
        own = own.where(F.col("hdu") == hdu)
    w, h = _axis(1), F.coalesce(_axis(2), F.lit(1).cast("long"))
    good = is_image() & F.coalesce(F.col("supported"), F.lit(True))
    plot = ~is_image() & F.col("kind").isNotNull()
    rank = (
        F.when(good & F.coalesce(F.col("preferred"), F.lit(False)), 0).when(good & (F.lit(hdu is not None) | (F.col("format") == "xisf") | ((w >= 2) & (h >= 2))), 1).when(plot, 1)
        .when(good & (w >= 2), 2).when(is_image() & ~F.col("supported"), 3).when(F.col("xtension").isin("BINTABLE", "TABLE"), 4).otherwise(5)
    )
    best = own.withColumn("_rank", rank).groupBy("path").agg(F.min_by(F.struct("hdu", "_rank", plot.alias("is_table"), F.coalesce(F.col("sky"), F.lit(False)).alias("is_sky"), "error", "cmptype", "format"), F.struct("_rank", "hdu")).alias("b"))
    shown = F.col("b._rank") <= 2
    reason = F.when(shown, None).when(F.col("b._rank") == 3, F.coalesce("b.error", F.concat(F.lit("tiles can not be decoded: "), F.coalesce("b.cmptype", F.lit("unknown codec"))))).when(F.col("b.format") == "asdf", "ASDF tree without a usable array").when(F.col("b._rank") == 4, "tables only, and none has axes").otherwise("empty: nothing to display")
    return best.select("path", F.when(shown, F.col("b.hdu")).alias("hdu"), (shown & F.col("b.is_table")).alias("is_table"), (shown & F.col("b.is_table") & F.col("b.is_sky")).alias("is_sky"), reason.alias("reason"))


def classify_color(images: DataFrame, mono: bool = False, plane: int | None = None) -> DataFrame:
    """Adds color (rgb, bayer, mono) and pattern to images with naxes, planes, format and the keywords CTYPE3, BAYERPAT, COLORTYP."""
    ctype = F.upper(F.coalesce(F.col("CTYPE3"), F.lit("")))
    three = (F.size("naxes") == 3) & (_axis(3) == 3) & (F.col("format") != "asdf")
    rgb = three & ((ctype == "") | ctype.contains("RGB") | ctype.contains("COLO")) & F.lit(plane is None)
    pattern = F.upper(F.coalesce(F.col("BAYERPAT"), F.col("COLORTYP")))
    bayer = (F.coalesce(F.col("planes"), F.lit(1)) == 1) & (_axis(1) >= 2) & (_axis(2) >= 2) & F.coalesce(pattern.rlike("^[RGB]{4}$"), F.lit(False))
    color = F.when(F.lit(mono) | (F.col("unit") != "image"), "mono").when(rgb, "rgb").when(bayer, "bayer").otherwise("mono")
    return images.withColumn("color", color).withColumn("pattern", F.when(color == "bayer", pattern))


def row_order(images: DataFrame) -> DataFrame:
    """Adds flip: the first row is the bottom one, unless ROWORDER is TOP-DOWN or the file is XISF."""
    top = (F.upper(F.coalesce(F.col("ROWORDER"), F.lit(""))) == "TOP-DOWN") | (F.col("format") == "xisf")
    return images.withColumn("flip", ~top)


def listing(hdus: DataFrame, most: int = 100_000) -> DataFrame:
    """Units that hold something, in file order, at most so many of a file."""
    return classify_hdus(hdus.where(F.col("hdu") < most)).where(F.col("unit").isNotNull()).orderBy("path", "hdu")
