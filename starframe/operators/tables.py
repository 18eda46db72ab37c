"""Columns of table units: descriptions from header cards, choice of plot axes, row ranges and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starframe.functions.scalar import scaled, tform, to_double, to_int

# Conventional column names, in order of preference.
LIGHT_X = "TIME BTJD BKJD BJD BJD_TDB HJD MJD JD".split()
LIGHT_Y = "PDCSAP_FLUX SAP_FLUX FLUX RATE NET_RATE COUNT_RATE MAG MAGNITUDE COUNTS".split()
SPECTRUM_X = "WAVELENGTH WAVE LAMBDA LAM LOGLAM FREQUENCY FREQ ENERGY VELOCITY VELO CHANNEL".split()
SPECTRUM_Y = "FLUX FLUX_DENSITY FLAM F_LAMBDA FNU F_NU SPEC SPECTRUM INTENSITY COUNTS RATE DATA".split()
SKY = [p.split("/") for p in "RA/DEC RAJ2000/DEJ2000 _RAJ2000/_DEJ2000 RA_ICRS/DE_ICRS RAJ2000/DECJ2000 RA_J2000/DEC_J2000 ALPHA_J2000/DELTA_J2000 ALPHAWIN_J2000/DELTAWIN_J2000 RAMEAN/DECMEAN RA_OBJ/DEC_OBJ TARGET_RA/TARGET_DEC RA_DEG/DEC_DEG RADEG/DECDEG GLON/GLAT".split()]

#: Most columns of a table, and of its head.
MOST_COLUMNS, HEAD_COLUMNS = 999, 60


def describe_columns(cards: DataFrame, keys: list[str] = ("path", "hdu")) -> DataFrame:
    """One row per column of binary or ASCII tables, from parsed cards: keys, n, name, unit, form, repeat, type, element, width,
    byte_offset, scale, zero, null; ``bad`` marks tables with a form that can't be read.

    One aggregate over the cards of the columns; offsets are running sums of the widths.
    """
    keys = list(keys)
    own = cards.where(F.col("kind") == "v").select(*keys, "seq", "value", F.regexp_extract("key", "^T(TYPE|FORM|UNIT|SCAL|ZERO|NULL|BCOL)([1-9][0-9]{0,2})$", 1).alias("_what"), F.regexp_extract("key", "([0-9]*)$", 1).try_cast("int").alias("n")).where(F.col("_what") != "")
    get = lambda what: F.min_by("value", F.when(F.col("_what") == what, F.col("seq"))).alias(f"_{what}")
    rows = own.groupBy(*keys, "n").agg(*(get(w) for w in ("TYPE", "FORM", "UNIT", "SCAL", "ZERO", "NULL", "BCOL")))
    form = F.trim("_FORM")
    parts = tform(form)
    text = F.col("_BCOL").isNotNull()
    ascii_width = F.regexp_extract(form, "^[AIFED]([0-9]+)", 1).try_cast("bigint")
    out = rows.select(
        *keys, "n", F.coalesce(F.trim("_TYPE"), F.concat(F.lit("col"), F.col("n"))).alias("name"), F.coalesce(F.trim("_UNIT"), F.lit("")).alias("unit"), form.alias("form"),
        F.when(text, 1).otherwise(parts["repeat"]).cast("long").alias("repeat"), F.when(text, F.substring(form, 1, 1)).otherwise(parts["type"]).alias("type"), parts["element"].alias("element"),
        F.when(text, ascii_width).otherwise(parts["width"]).alias("width"), to_int(F.col("_BCOL")).alias("_bcol"),
        F.coalesce(F.nullif(to_double(F.col("_SCAL")), F.lit(0.0)), F.lit(1.0)).alias("scale"), F.coalesce(to_double(F.col("_ZERO")), F.lit(0.0)).alias("zero"), to_int(F.col("_NULL")).alias("null"),
    )
    w = Window.partitionBy(*keys).orderBy("n")
    before = F.coalesce(F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("byte_offset", F.when(F.col("_bcol").isNotNull(), F.col("_bcol") - 1).otherwise(before)).withColumn("bad", F.bool_or(F.col("width").isNull()).over(Window.partitionBy(*keys))).drop("_bcol")


def axis_rules(spark: SparkSession) -> DataFrame:
    """(x, y, kind, priority): pairs of names in order; about 250 rows."""
    pairs = [(x, y, "light") for x in LIGHT_X for y in LIGHT_Y] + [(x, y, "spectrum") for x in SPECTRUM_X for y in SPECTRUM_Y] + [(x, y, "sky") for x, y in SKY]
    return spark.createDataFrame([(x, y, k, n) for n, (x, y, k) in enumerate(pairs)], "x string, y string, kind string, priority int")


def pick_axes(columns: DataFrame, keys: list[str] = ("path", "hdu"), rows: str | None = None) -> DataFrame:
    """What to plot of each table: keys, x, y, kind (light, spectrum, sky), points, sky, xlog, y_flip, x_label, x_unit, y_unit, repeat.

    Numeric columns that are no variable-length arrays, of equal repeat, first rule first.  ``rows`` names a column with the number
    of rows, of which there must be two points at least.  Names are matched without case, the first column of a name counts.
    """
    keys = list(keys)
    usable = columns.where(F.col("type").isin(*"BIJKED") & (F.col("repeat") >= 1)).withColumn("_u", F.upper("name"))
    usable = usable.groupBy(*keys, "_u").agg(F.min_by(F.struct("name", "unit", "repeat", "n", *([rows] if rows else [])), "n").alias("c"))
    rules = F.broadcast(axis_rules(columns.sparkSession))
    x = usable.join(rules, F.col("_u") == F.col("x")).select(*keys, F.col("c").alias("cx"), "y", "kind", "priority")
    y = usable.select(*keys, F.col("_u").alias("y"), F.col("c").alias("cy"))
    pairs = x.join(y, [*keys, "y"]).where((F.col("cx.n") != F.col("cy.n")) & (F.col("cx.repeat") == F.col("cy.repeat")))
    best = pairs.groupBy(*keys).agg(F.min_by(F.struct("cx", "cy", "kind"), "priority").alias("p"))
    if rows:
        best = best.where(F.col(f"p.cx.{rows}") * F.col("p.cx.repeat") >= 2)
    log = F.upper("p.cx.name") == "LOGLAM"
    lower = F.col("p.cx.name").rlike("^[a-z]")
    return best.select(
        *keys, F.col("p.cx.name").alias("x"), F.col("p.cy.name").alias("y"), F.col("p.kind").alias("kind"), (F.col("p.kind") != "spectrum").alias("points"), (F.col("p.kind") == "sky").alias("sky"),
        log.alias("xlog"), F.upper("p.cy.name").startswith("MAG").alias("y_flip"),
        F.when(log, F.when(lower, "wavelength").otherwise("WAVELENGTH")).otherwise(F.col("p.cx.name")).alias("x_label"), F.when(log, "Angstrom").otherwise(F.col("p.cx.unit")).alias("x_unit"),
        F.col("p.cy.unit").alias("y_unit"), F.col("p.cx.repeat").alias("repeat"),
    )


def scaled_columns(df: DataFrame, columns: list[dict]) -> DataFrame:
    """Applies null values and scaling: columns as rows of :func:`describe_columns`; a scaled column becomes double."""
    made = {}
    for c in columns:
        name, plain = c["name"], c.get("scale", 1.0) == 1.0 and c.get("zero", 0.0) == 0.0
        if name not in df.columns or isinstance(df.schema[name].dataType, (T.ArrayType, T.StringType, T.BinaryType, T.StructType, T.BooleanType)):
            continue
        null = c.get("null") if c.get("type") in tuple("BIJK") else None
        if not plain:
            made[name] = scaled(F.col(name), c["scale"], c["zero"], null)
        elif null is not None:
            made[name] = F.nullif(F.col(name), F.lit(null).cast(df.schema[name].dataType))
    return df.withColumns(made) if made else df


def rows_between(df: DataFrame, first: int, count: int, row: str = "_row") -> DataFrame:
    """Rows by number; past the end there are none.  The filter reaches sources that number their rows."""
    return df.where((F.col(row) >= first) & (F.col(row) < first + count))


def head(df: DataFrame, n: int, row: str = "_row") -> DataFrame:
    """The first n rows and at most 60 columns."""
    return df.where(F.col(row) < n).select(*df.columns[: HEAD_COLUMNS + 1])


def ascii_fields(lines: DataFrame, columns: list[dict], line: str = "line") -> DataFrame:
    """Fields of the lines of an ASCII table: text trimmed; numeric forms as numbers where they can be read."""
    out = []
    for c in columns:
        text = F.trim(F.substring(line, int(c["byte_offset"]) + 1, int(c["width"])))
        number = {"I": to_int, "F": to_double, "E": to_double, "D": to_double}.get(c["type"])
        out.append((number(text) if number else text).alias(c["name"]))
    return lines.select(*[x for x in lines.columns if x != line], *out)
