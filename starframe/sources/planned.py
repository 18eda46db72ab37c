"""Rows of FITS tables and images, planned from a stored list of data units (``files.scan_hdus``): no file is opened for planning.

The list is a table like any other: filters on path and unit prune it, its rows become ranges of rows, and tasks read just these
ranges by path.  A unit's header comes along, so a task walks no file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.operators.images import MOST_SAMPLES
from starframe.operators.sampling import READ_ALL, WINDOW_BYTES, WINDOWS, window_sample
from starframe.sources import fits
from starframe.sources.fits_sources import PARTITION_BYTES, _pixel_batch, arrow, pixels

#: Bytes of rows that are read of a plane for a binned view.
SAMPLED_BYTES = 2 << 30
ROWS = "path string, hdu int, plane bigint, y bigint, values array<double>, truncated boolean"


def _keywords(header: str) -> dict:
    kw: dict = {}
    for k in range(0, len(header), fits.CARD):
        card = header[k : k + fits.CARD]
        if card[8:10] == "= ":
            kw.setdefault(card[:8].rstrip(), fits._value(card))
    return kw


def table_ranges(units: DataFrame, first: int = 0, last: int | None = None, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Ranges of rows [low, high) of table units, of about ``range_bytes`` each; ``first`` and ``last`` bound the rows of every unit."""
    own = units.where(F.col("error").isNull() & (F.col("rowlen") > 0) & (F.col("tfields") > 0) & ~F.col("zimage"))
    end = F.col("n_rows") if last is None else F.least("n_rows", F.lit(last))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(range_bytes) / F.col("rowlen")))
    own = own.withColumns({"_end": end.cast("long"), "_step": step}).where(F.col("_end") > first)
    own = own.withColumn("low", F.explode(F.sequence(F.lit(first).cast("long"), F.col("_end") - 1, F.col("_step"))))
    return own.select("path", "hdu", "data_off", "rowlen", "heap", "header", "low", F.least(F.col("low") + F.col("_step"), F.col("_end")).alias("high"))


def table_rows(units: DataFrame, schema: str, first: int = 0, last: int | None = None, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Typed rows of table units of files that tasks open by path: path, hdu, _row, the columns of ``schema``, and ``error``.

    A unit without one of the columns in its type, and one whose file can't be read, has one row with ``error`` for each range.
    """
    return range_rows(table_ranges(units, first, last, range_bytes), schema)


def table_windows(units: DataFrame, windows: int = WINDOWS, window_bytes: int = WINDOW_BYTES, read_all: int = READ_ALL, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The ranges of rows that stand for each table unit: windows spread over it (``sampled``), or, up to ``read_all`` bytes, all of it."""
    big = (F.col("n_rows") * F.col("rowlen") > read_all) & (F.col("n_rows") >= windows)

    def choose(tables):
        for table in tables:
            for k, r in enumerate(table.select(["data_off", "rowlen", "n_rows"]).to_pylist()):
                ends = window_sample(r["data_off"], r["rowlen"], r["n_rows"], windows, window_bytes, read_all)
                low, high = (pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1))
                rest = table.slice(k, 1).select(["path", "hdu", "data_off", "rowlen", "heap", "header"]).take(pa.array([0] * len(ends)))
                yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in rest.schema.names), low, high], names=[*rest.schema.names, "low", "high"])

    own = units.where(F.col("error").isNull() & (F.col("rowlen") > 0) & (F.col("tfields") > 0) & ~F.col("zimage")).where(big)
    own = own.select("path", "hdu", "data_off", "rowlen", "heap", "header", "n_rows").repartition("path", "hdu")
    picked = own.mapInArrow(choose, "path string, hdu int, data_off bigint, rowlen bigint, heap bigint, header string, low bigint, high bigint")
    return picked.withColumn("sampled", F.lit(True)).unionByName(table_ranges(units.where(~big), range_bytes=range_bytes).withColumn("sampled", F.lit(False)))


def range_rows(ranges: DataFrame, schema: str) -> DataFrame:
    """Typed rows of ranges of table units (path, hdu, data_off, rowlen, heap, header, low, high), as :func:`table_rows` gives them."""
    names, kinds = zip(*(x.strip().split(" ", 1) for x in schema.split(", ")), strict=True)
    types = [arrow(k) for k in kinds]

    def told(r: dict, error: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([r["hdu"]], pa.int32()), pa.array([None], pa.int64()), *(pa.nulls(1, t) for t in types), pa.array([error])], names=["path", "hdu", "_row", *names, "error"])

    def rows(tables):
        held: dict = {}
        for table in tables:
            for r in table.to_pylist():
                try:
                    cols = {c["name"]: c for c in fits.columns(_keywords(r["header"]))}
                    if wrong := [c for c, k in zip(names, kinds, strict=True) if c not in cols or fits.spark_type(cols[c]) != k]:
                        yield told(r, f"no column {wrong[0]} of that type")
                        continue
                    if r["path"] not in held:
                        held.clear()
                        held[r["path"]] = fits.Bytes(r["path"])
                    source, wide = held[r["path"]], r["rowlen"]
                    for k in range(r["low"], r["high"], 65536):
                        raw = np.frombuffer(source.read(r["data_off"] + k * wide, min(65536, r["high"] - k) * wide), np.uint8)
                        raw = raw[: len(raw) // wide * wide].reshape(-1, wide)
                        n = len(raw)
                        heap = lambda at, m: source.read(r["data_off"] + r["heap"] + at, m)  # noqa: B023, E731
                        data = [pa.array(fits.cells(raw, cols[c], heap), t) for c, t in zip(names, types, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n, pa.string()), pa.array([r["hdu"]] * n, pa.int32()), pa.array(np.arange(k, k + n)), *data, pa.nulls(n, pa.string())], names=["path", "hdu", "_row", *names, "error"])
                        if n < min(65536, r["high"] - k):
                            yield told(r, "the file ends before its rows")
                            break
                except Exception as e:  # noqa: BLE001  a damaged unit concerns its own rows only
                    yield told(r, str(e) or type(e).__name__)

    return ranges.repartition("path", "hdu", "low").mapInArrow(rows, f"path string, hdu int, _row bigint, {schema}, error string")


def image_ranges(units: DataFrame, planes: list[int] | None = None, y: tuple[int, int] | None = None, every: int = 1, offset: int = 0, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Ranges of rows of planes of image units: path, hdu, plane, low, high, every and what reading needs.

    Of each ``every`` rows one is read, the one that is ``offset`` behind a multiple: a sampled image costs its share of the bytes.
    """
    own = _planes(units, planes)
    low, high = (F.lit(0), F.col("height")) if y is None else (F.greatest(F.lit(0), F.lit(y[0])), F.least(F.col("height"), F.lit(y[1])))
    return _stepped(own.withColumns({"every": F.lit(every), "_offset": F.lit(offset)}), low, high, range_bytes)


def _planes(units: DataFrame, planes: list[int] | None) -> DataFrame:
    """Planes of image units with their width and height."""
    own = units.where(F.col("error").isNull() & (F.size("naxes") > 0) & F.forall("naxes", lambda a: a.between(1, 1 << 40)) & ~F.col("groups") & ~F.col("zimage") & (F.col("tfields") == 0))
    product = F.aggregate(F.slice("naxes", 3, 1 << 20), F.lit(1).cast("long"), lambda a, x: a * x)
    own = own.withColumns({"width": F.get("naxes", F.lit(0)), "height": F.coalesce(F.get("naxes", F.lit(1)), F.lit(1)).cast("long"), "_n": product})
    own = own.where(F.col("_n").cast("double") * F.col("height") * F.col("width") < 1 << 50)
    chosen = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1) if planes is None else F.filter(F.array(*(F.lit(p).cast("long") for p in planes)), lambda p: p.between(0, F.col("_n") - 1))
    return own.withColumn("plane", F.explode(chosen))


def _stepped(own: DataFrame, low: Column, high: Column, range_bytes: int) -> DataFrame:
    """Planes as ranges of rows between limits: of each ``every`` rows the one that is ``_offset`` behind a multiple."""
    begin = F.ceil((low - F.col("_offset")) / F.col("every")) * F.col("every") + F.col("_offset")
    row_bytes = F.col("width") * F.abs("bitpix") / 8
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(range_bytes) / row_bytes)) * F.col("every")
    own = own.withColumns({"_low": begin.cast("long"), "_high": high.cast("long"), "_step": step}).where("_low < _high")
    own = own.withColumn("low", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1, F.col("_step"))))
    return own.select("path", "hdu", "plane", "width", "height", "bitpix", "bscale", "bzero", "blank", "data_off", "low", F.least(F.col("low") + F.col("_step"), F.col("_high")).alias("high"), F.col("every").cast("int").alias("every"))


def bin_plans(units: DataFrame, max_width: int, max_height: int, samples: int = 4, limit: int = SAMPLED_BYTES) -> DataFrame:
    """How each image unit is binned to fit a view: path, hdu, factor, samples (on a side of a bin), out_width, out_height.

    The rows read of a plane add up to ``limit`` bytes at most: beyond it fewer rows of a bin are read, down to one (as many samples
    are taken in x).  ``samples`` 0: all pixels, as far as the limit allows.
    """
    own = _planes(units, [0])
    factor = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("width") / max_width), F.ceil(F.col("height") / max_height))
    own = own.withColumn("factor", factor.cast("long"))
    own = own.withColumns({"out_width": F.greatest(F.lit(1).cast("long"), F.floor(F.col("width") / F.col("factor"))), "out_height": F.greatest(F.lit(1).cast("long"), F.floor(F.col("height") / F.col("factor")))})
    most = F.least(F.col("factor"), F.lit(samples if samples > 0 else MOST_SAMPLES).cast("long"), F.lit(MOST_SAMPLES).cast("long"))
    once = F.col("out_height").cast("double") * F.col("width") * F.abs("bitpix") / 8
    fewer = F.greatest(F.lit(1).cast("long"), F.least(most, F.floor(limit / once)))
    return own.select("path", "hdu", "factor", fewer.cast("long").alias("samples"), "out_width", "out_height")


def offsets_of(factor: Column, samples: Column) -> Column:
    """The places within a bin that are read, on one side (of which an image may have less than the factor)."""
    spread = F.transform(F.sequence(F.lit(0).cast("long"), samples - 1), lambda i: F.floor((2 * i + 1) * factor / (2 * samples)))
    return F.when(samples >= factor, F.sequence(F.lit(0).cast("long"), factor - 1)).otherwise(spread)


def sampled_ranges(units: DataFrame, plans: DataFrame, planes: list[int] | None = None, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Ranges of the rows that :func:`bin_plans` asks for; rows below whole bins are left out, and where all are asked for, ranges
    are read as one."""
    own = _planes(units, planes).join(plans, ["path", "hdu"])
    side = F.least("factor", "height")
    whole = F.col("samples") >= side
    own = own.withColumn("_offset", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(offsets_of(side, F.col("samples")))))
    own = own.withColumn("every", F.when(whole, F.lit(1).cast("long")).otherwise(F.col("factor")))
    return _stepped(own, F.lit(0), F.least(F.col("height"), F.col("out_height") * F.col("factor")), range_bytes)


def sampled_rows(units: DataFrame, plans: DataFrame, planes: list[int] | None = None, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows of pixels that plans of :func:`bin_plans` ask for, as :func:`image_rows` gives them; no other row is read."""
    return sampled_ranges(units, plans, planes, range_bytes).repartition("path", "hdu", "plane", "low").mapInArrow(_image_rows, ROWS)


def _image_rows(tables):
    held: dict = {}
    for table in tables:
        for r in table.to_pylist():
            width, size = r["width"], abs(r["bitpix"]) // 8
            # Rows that follow each other are read at once, some megabytes at a time.
            block = max(1, (4 << 20) // (width * size)) if r["every"] == 1 else 1
            ys, parts, cut = [], [], False
            for y in range(r["low"], r["high"], r["every"] * block):
                n = min(block, r["high"] - y) if r["every"] == 1 else 1
                out = np.full(n * width, np.nan) if width < 1 << 28 else np.zeros(0)
                try:
                    if r["path"] not in held:
                        held.clear()
                        held[r["path"]] = fits.Bytes(r["path"])
                    raw = held[r["path"]].read(r["data_off"] + (r["plane"] * r["height"] + y) * width * size, n * width * size)
                    got = pixels(np.frombuffer(raw[: len(raw) // size * size], fits.DTYPES[r["bitpix"]]), r["bscale"], r["bzero"], r["blank"])
                    out[: len(got)] = got
                    cut |= len(got) < n * width
                except Exception:  # noqa: BLE001
                    cut = True
                ys += range(y, y + n)
                parts.append(out)
                if len(parts) * len(out) >= 1 << 20 or cut or y + r["every"] * block >= r["high"]:
                    values = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(parts)), width).cast(pa.list_(pa.float64())) if width < 1 << 28 else pa.nulls(len(ys), pa.list_(pa.float64()))
                    yield _pixel_batch(r["path"], r["hdu"], r["plane"], ys, values, cut)
                    ys, parts, cut = [], [], False


def image_rows(units: DataFrame, planes: list[int] | None = None, y: tuple[int, int] | None = None, every: int = 1, offset: int = 0, range_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Rows of pixels of image units that tasks open by path: path, hdu, plane, y, values, truncated (some of the batch is missing)."""
    return image_ranges(units, planes, y, every, offset, range_bytes).repartition("path", "hdu", "plane", "low").mapInArrow(_image_rows, ROWS)
