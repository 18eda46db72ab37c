"""Data sources ``fits_table`` and ``fits_image``: rows of tables and images, read by ranges of bytes.

Partitions are ranges of rows of one data unit, so a big unit is many tasks and only the rows asked for are read.  Filters on
``_row``, ``plane`` and ``y`` are pushed down (with ``spark.sql.python.filterPushdown.enabled``) and choose the ranges.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from starframe.sources import fits

PARTITION_BYTES = 64 << 20


def files(path: str) -> list[str]:
    """Files of a path, folder or pattern, sorted."""
    path = path.removeprefix("file:")
    if os.path.isdir(path):
        path = os.path.join(path, "*")
    return sorted(p for p in glob.glob(path) if os.path.isfile(p))


class _Range(InputPartition):
    def __init__(self, path, hdu, first, last, extra=None):
        self.path, self.hdu, self.first, self.last, self.extra = path, hdu, first, last, extra


class _Reader(DataSourceReader):
    """Keeps the limits that filters set on integer columns."""

    limited: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.options = options
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name not in self.limited or isinstance(f, In) or not isinstance(value, int):
                yield f
                continue
            low, high = self.low.get(name, 0), self.high.get(name, 1 << 62)
            if isinstance(f, EqualTo):
                low, high = max(low, value), min(high, value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                low = max(low, value)
            elif isinstance(f, GreaterThan):
                low = max(low, value + 1)
            elif isinstance(f, LessThan):
                high = min(high, value)
            elif isinstance(f, LessThanOrEqual):
                high = min(high, value + 1)
            self.low[name], self.high[name] = low, high
            yield f  # also applied to the rows

    def span(self, name: str, n: int) -> tuple[int, int]:
        return min(max(self.low.get(name, 0), 0), n), min(self.high.get(name, n), n)

    def step(self, row_bytes: int) -> int:
        return max(1, int(self.options.get("partitionbytes", PARTITION_BYTES)) // max(1, row_bytes))


def _unit(path: str, hdu: int) -> tuple[fits.Bytes, dict]:
    source = fits.Bytes(path)
    for u in fits.walk(source, hdu + 1):
        if u["hdu"] == hdu and not u["error"]:
            return source, u
    raise ValueError(f"{path}: there is no HDU {hdu}")


def _units(options: dict, table: bool = False) -> Iterator[tuple[str, fits.Bytes, dict]]:
    """The unit asked for of every file; in permissive mode files without it, or without readable columns, are left out."""
    hdu, mode = int(options.get("hdu", 1)), options.get("mode", "permissive").lower()
    for p in files(options["path"]):
        try:
            source, u = _unit(p, hdu)
            if table and u["tfields"] and not fits.columns(u["keywords"]):
                raise ValueError(f"{p}: the columns of HDU {hdu} can't be read")
        except (ValueError, OSError):
            if mode == "failfast":
                raise
            continue
        yield p, source, u


class TableReader(_Reader):
    limited = ("_row",)

    def partitions(self):
        out = []
        for p, source, u in _units(self.options, table=True):
            rows = min(u["n_rows"], max(0, source.size - u["data_off"]) // u["rowlen"]) if u["rowlen"] else 0
            a, b = self.span("_row", rows)
            if self.options.get("windows") == "true":
                from starframe.operators.sampling import window_sample

                ranges = [(max(x, a), min(y, b)) for x, y in window_sample(u["data_off"], u["rowlen"], rows) if max(x, a) < min(y, b)]
                per = max(1, len(ranges) // 64)
                out += [_Range(p, u["hdu"], 0, 0, ranges[k : k + per]) for k in range(0, len(ranges), per)]
                continue
            step = self.step(u["rowlen"])
            out += [_Range(p, u["hdu"], k, min(k + step, b), None) for k in range(a, b, step)]
        return out or [_Range(None, 0, 0, 0)]

    def read(self, part):
        if part.path is None:
            return
        source, u = _unit(part.path, part.hdu)
        wanted = self.options.get("columns")
        cols = [c for c in fits.columns(u["keywords"]) if not wanted or c["name"] in wanted.split(",")]
        schema = pa.schema([("path", pa.string()), ("hdu", pa.int32()), ("_row", pa.int64()), *((c["name"], arrow(fits.spark_type(c))) for c in cols)])
        heap = lambda at, n: source.read(u["data_off"] + u["heap"] + at, n)
        for a, b in part.extra or [(part.first, part.last)]:
            for k in range(a, b, 65536):
                n = min(65536, b - k)
                raw = np.frombuffer(source.read(u["data_off"] + k * u["rowlen"], n * u["rowlen"]), np.uint8)
                raw = raw[: len(raw) // u["rowlen"] * u["rowlen"]].reshape(-1, u["rowlen"])
                data = [pa.array([part.path] * len(raw)), pa.array([part.hdu] * len(raw), pa.int32()), pa.array(np.arange(k, k + len(raw)))]
                data += [pa.array(fits.cells(raw, c, heap), schema.field(c["name"]).type) for c in cols]
                yield pa.RecordBatch.from_arrays(data, schema=schema)


class ImageReader(_Reader):
    limited = ("y", "plane")

    def partitions(self):
        out = []
        for p, _source, u in _units({"hdu": "0"} | self.options):
            axes = u["naxes"]
            if not axes or min(axes) < 1 or u["groups"] or u["zimage"]:
                continue
            height = axes[1] if len(axes) > 1 else 1
            planes = int(np.prod(axes[2:], dtype=np.int64)) if len(axes) > 2 else 1
            ya, yb = self.span("y", height)
            step = self.step(axes[0] * abs(u["bitpix"]) // 8)
            for plane in range(*self.span("plane", planes)):
                out += [_Range(p, u["hdu"], y, min(y + step, yb), plane) for y in range(ya, yb, step)]
        return out or [_Range(None, 0, 0, 0)]

    def read(self, part):
        if part.path is None:
            return
        source, u = _unit(part.path, part.hdu)
        width, height = u["naxes"][0], u["naxes"][1] if len(u["naxes"]) > 1 else 1
        size = abs(u["bitpix"]) // 8
        for y in range(part.first, part.last, 256):
            n = min(256, part.last - y)
            raw = source.read(u["data_off"] + (part.extra * height + y) * width * size, n * width * size)
            got = np.frombuffer(raw[: len(raw) // size * size], fits.DTYPES[u["bitpix"]])
            rows = pixels(got, u["bscale"], u["bzero"], u["blank"])
            full = len(rows) // width
            if full:
                values = pa.FixedSizeListArray.from_arrays(pa.array(rows[: full * width]), width).cast(pa.list_(pa.float64()))
                yield _pixel_batch(part.path, part.hdu, part.extra, range(y, y + full), values, False)
            if full < n:  # what lies past the end of the file is missing
                rest = [[*rows[full * width :], *[float("nan")] * (width - len(rows) + full * width)]] if len(rows) > full * width else []
                rest += [[float("nan")] * width] * (n - full - len(rest))
                yield _pixel_batch(part.path, part.hdu, part.extra, range(y + full, y + n), pa.array(rest, pa.list_(pa.float64())), True)


PIXELS = "path string, hdu int, plane bigint, y bigint, values array<double>, truncated boolean"


def _pixel_batch(path, hdu, plane, ys, values, cut) -> pa.RecordBatch:
    n = len(ys)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array([hdu] * n, pa.int32()), pa.array([plane] * n, pa.int64()), pa.array(list(ys), pa.int64()), values, pa.array([cut] * n, pa.bool_())],
        names=["path", "hdu", "plane", "y", "values", "truncated"],
    )


def pixels(raw: np.ndarray, scale: float = 1.0, zero: float = 0.0, blank: int | None = None) -> np.ndarray:
    """Raw pixels as doubles: scaled, and NaN where the raw integer is the blank one."""
    out = raw.astype(np.float64) * scale + zero
    if blank is not None and raw.dtype.kind in "iu":
        out[raw == blank] = np.nan
    return out


def arrow(kind: str) -> pa.DataType:
    plain = {"boolean": pa.bool_(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    if kind.startswith("array<"):
        return pa.list_(arrow(kind[6:-1]))
    if kind.startswith("struct<"):
        part = plain["float" if "float" in kind else "double"]
        return pa.struct([("re", part), ("im", part)])
    return plain[kind]


class FitsTable(DataSource):
    """Rows of a table unit: path, hdu, _row and its columns (unscaled).  Options: path, hdu, columns, windows, partitionBytes, mode.

    The schema is that of the first file; read files of one schema together.
    """

    @classmethod
    def name(cls):
        return "fits_table"

    def schema(self):
        _, _, u = next(_units(self.options, table=True))
        wanted = self.options.get("columns")
        cols = [c for c in fits.columns(u["keywords"]) if not wanted or c["name"] in wanted.split(",")]
        return "path string, hdu int, _row bigint" + "".join(f", `{c['name']}` {fits.spark_type(c)}" for c in cols)

    def reader(self, schema: StructType):
        return TableReader(self.options)


class FitsImage(DataSource):
    """Rows of an image unit: path, hdu, plane, y, values, truncated.  Options: path, hdu, partitionBytes, mode."""

    @classmethod
    def name(cls):
        return "fits_image"

    def schema(self):
        return PIXELS

    def reader(self, schema: StructType):
        return ImageReader(self.options)


def register(spark) -> None:
    for source in (FitsTable, FitsImage):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_table(spark, path: str, hdu: int = 1, columns: list[str] | None = None, scaled: bool = True, windows: bool = False, mode: str = "permissive"):
    """Typed rows of a table unit of files of one schema, with null values and scaling applied."""
    from starframe.operators import tables

    register(spark)
    read = spark.read.format("fits_table").option("hdu", hdu).option("mode", mode).option("windows", str(windows).lower())
    df = (read.option("columns", ",".join(columns)) if columns else read).load(path)
    if not scaled:
        return df
    _, _, u = next(_units({"path": path, "hdu": str(hdu)}))
    found = fits.columns(u["keywords"])
    if any(c["ascii"] for c in found):
        from pyspark.sql import functions as F

        from starframe.functions.scalar import to_double, to_int

        number = {"I": to_int, "F": to_double, "E": to_double, "D": to_double}
        return df.withColumns({c["name"]: number[c["type"]](F.col(c["name"])) for c in found if c["type"] in number and c["name"] in df.columns})
    return tables.scaled_columns(df, found)


def read_image(spark, path: str, hdu: int = 0, mode: str = "permissive"):
    register(spark)
    return spark.read.format("fits_image").option("hdu", hdu).option("mode", mode).load(path)
