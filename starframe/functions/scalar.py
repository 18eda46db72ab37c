"""Scalar expressions: finiteness, sky coordinates, value mapping, card values and names of types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite.  (Spark orders NaN above everything, so aggregates must filter by this first.)"""
    return F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))


def on_sphere(lon: Column, lat: Column) -> Column:
    """Within -360..360 by -90..90: placeholders such as -999 are not."""
    return lon.between(-360, 360) & lat.between(-90, 90)


def wrap180(x: Column) -> Column:
    return F.when(x > 180, x - 360).otherwise(x)


def label360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def from_loglam(x: Column) -> Column:
    """10**x; what overflows becomes infinite and is then not finite."""
    return F.pow(F.lit(10.0), x)


def scaled(raw: Column, scale: Column | float = 1.0, zero: Column | float = 0.0, null: Column | int | None = None) -> Column:
    """raw * scale + zero, null where raw has the null value (compared before scaling)."""
    value = raw if null is None else F.when(raw == null, F.lit(None)).otherwise(raw)
    return value.cast("double") * scale + zero


def midtone(t: Column, m: Column) -> Column:
    """The midtones curve: 0 to 0, m to 0.5, 1 to 1."""
    return (m - 1) * t / ((2 * m - 1) * t - m)


def stretch8(v: Column, c0: Column, inv: Column, m: Column) -> Column:
    """A value as 0..255: clamped (v - c0) * inv through the midtones curve."""
    t = F.greatest(F.least((v - c0) * inv, F.lit(1.0)), F.lit(0.0))
    return F.floor(255 * midtone(t, m) + 0.5).cast("int")


def density_shade(n: Column, peak: Column) -> Column:
    """Brightness of a cell with n points where the fullest has peak."""
    return 60 + 195 * F.ln(n) / F.ln(peak)


def wcs_linear(i: Column, crval: Column, cdelt: Column, crpix: Column | float = 1.0) -> Column:
    """World coordinate of pixel i (from 1) on a linear axis."""
    return crval + (i - crpix) * cdelt


def type_name(bitpix: Column, bscale: Column, bzero: Column) -> Column:
    """Element type, with the unsigned ones that a zero point stands for."""
    unit = F.coalesce(bscale, F.lit(1.0)) == 1
    zero = F.coalesce(bzero, F.lit(0.0))
    return (
        F.when((bitpix == 8) & unit & (zero == -128), "int8").when(bitpix == 8, "uint8")
        .when((bitpix == 16) & unit & (zero == 32768), "uint16").when(bitpix == 16, "int16")
        .when((bitpix == 32) & unit & (zero == 2147483648), "uint32").when(bitpix == 32, "int32")
        .when(bitpix == 64, "int64").when(bitpix == -32, "float32").when(bitpix == -64, "float64")
    )


def to_double(text: Column) -> Column:
    """A number as cards write it; exponents may use D."""
    return F.translate(F.trim(text), "Dd", "EE").try_cast("double")


def to_int(text: Column) -> Column:
    """An integer, or a number cut to one if below 9e18 in size."""
    d = to_double(text)
    return F.coalesce(F.trim(text).try_cast("bigint"), F.when(F.abs(d) < 9e18, d.cast("bigint")))


def printable(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x20-\\x7e]", "?")


def unquote(text: Column) -> Column:
    """The value of a quoted string: doubled quotes become one, trailing blanks go."""
    return F.rtrim(F.replace(F.regexp_extract(text, "^ *'((?:[^']|'')*)", 1), F.lit("''"), F.lit("'")))


def tform(form: Column) -> dict[str, Column]:
    """What a binary TFORM says: repeat, type letter, element type of a variable-length array, width in bytes."""
    repeat = F.coalesce(F.regexp_extract(form, "^ *([0-9]*)", 1).try_cast("bigint"), F.lit(1).cast("bigint"))
    code = F.regexp_extract(form, "^ *[0-9]*([LXBIJKAEDCMPQ])", 1)
    size = F.when(code.isin("L", "B", "A"), 1).when(code == "I", 2).when(code.isin("J", "E"), 4).when(code.isin("K", "D", "C", "P"), 8).when(code.isin("M", "Q"), 16)
    width = F.when(code == "X", F.floor((repeat + 7) / 8)).when(code.isin("P", "Q"), F.when(repeat == 0, 0).otherwise(size)).otherwise(repeat * size)
    return {"repeat": repeat, "type": code, "element": F.regexp_extract(form, "^ *[0-9]*[PQ]([LXBIJKAEDCM])", 1), "width": width.cast("bigint")}
