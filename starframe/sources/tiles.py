"""Tile-compressed images: a row per tile, decoded by library codecs, then rows of pixels.

GZIP_1, GZIP_2 and uncompressed tiles are read; tiles of other codecs, and damaged ones, come out with ``error`` and missing pixels.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starframe.sources import fits

SEGMENTS = "path string, hdu int, tile bigint, plane bigint, y bigint, x0 bigint, values array<double>, error string"
#: Pixels of a tile.
MOST_TILE = 1 << 28
_RANDOM: list[np.ndarray] = []


def unshuffle(data: bytes, size: int) -> bytes:
    """Byte planes to items."""
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]


def dither_table() -> np.ndarray:
    """10,000 uniform numbers of the minimal standard generator (multiplier 16807, seed 1), as dithering uses them."""
    if not _RANDOM:
        seed, out = 1, np.empty(10_000)
        for k in range(10_000):
            seed = seed * 16807 % 2147483647
            out[k] = seed / 2147483647
        _RANDOM.append(out.astype(np.float32))
    return _RANDOM[0]


def dither_index(seed: int, n: int) -> np.ndarray:
    """The number's place for each of n pixels: from 500 times the seed's number on, starting anew with the next seed at the end."""
    table, parts, left = dither_table(), [], n
    while left > 0:
        first = int(table[seed] * 500)
        run = min(left, 10_000 - first)
        parts.append(np.arange(first, first + run))
        left -= run
        seed = (seed + 1) % 10_000
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def dequantize(raw: np.ndarray, scale: float, zero: float, method: str = "NO_DITHER", tile: int = 0, dither: int = 1, blank: int | None = None) -> np.ndarray:
    """Quantised integers as doubles: i * scale + zero, less a number in 0..1 and plus a half where dithered; blanks are NaN.

    ``tile`` counts from 0; blank pixels use up a number too; dithering 2 keeps exact zeros as -2147483646.
    """
    out = raw.astype(np.float64)
    if method.startswith("SUBTRACTIVE_DITHER"):
        out = (out - dither_table()[dither_index((tile + dither - 1) % 10_000, len(raw))] + 0.5) * scale + zero
        if method.endswith("2"):
            out[raw == -2147483646] = 0.0
    else:
        out = out * scale + zero
    if blank is not None:
        out[raw == blank] = np.nan
    return out


def _decode(kw: dict, raw: np.ndarray, cols: dict, heap, tile: int, n: int) -> np.ndarray:
    """Pixels of a tile (raw: its row); fewer than n where its data is short."""
    kind, bitpix = kw.get("ZCMPTYPE", ""), fits._int(kw.get("ZBITPIX"))
    one = lambda name: fits.cells(raw, cols[name], heap)[0] if name in cols else None
    data, packed = one("COMPRESSED_DATA"), kind
    if not len(data or ()):
        data, packed = one("GZIP_COMPRESSED_DATA"), "GZIP_1"
    if not len(data or ()):
        data, packed = one("UNCOMPRESSED_DATA"), "NOCOMPRESS"
    if not len(data or ()):
        raise ValueError("no data")
    floats = bitpix < 0 and "ZSCALE" not in cols and "ZSCALE" not in kw
    dtype = np.dtype(fits.DTYPES[bitpix] if floats or bitpix > 0 else ">i4")
    if packed == "NOCOMPRESS":
        values = np.array(data)
    elif packed in ("GZIP_1", "GZIP_2"):
        blob = zlib.decompressobj(47).decompress(np.array(data, np.int64).astype(np.uint8).tobytes(), 8 * n)
        size = len(blob) // n or 1
        dtype = dtype if size == dtype.itemsize else np.dtype({1: "u1", 2: ">i2", 4: ">i4", 8: ">i8"}[size])
        values = np.frombuffer(unshuffle(blob, dtype.itemsize) if packed == "GZIP_2" else blob, dtype)
    else:
        raise ValueError(f"{kind} compression is not supported")
    blank = fits._int(kw["ZBLANK"]) if "ZBLANK" in kw else one("ZBLANK")
    if bitpix < 0 and not floats:
        scale, zero = (one(c) if c in cols else fits._float(kw.get(c, d), 0.0) for c, d in (("ZSCALE", "1"), ("ZZERO", "0")))
        return dequantize(values, scale, zero, kw.get("ZQUANTIZ", "NO_DITHER"), tile, fits._int(kw.get("ZDITHER0"), 1) or 1, blank)
    from starframe.sources.fits_sources import pixels

    return pixels(values, fits._float(kw.get("BSCALE", "1"), 1.0) or 1.0, fits._float(kw.get("BZERO", "0"), 0.0), blank if values.dtype.kind in "iu" else None)


def _unit(held: dict, path: str, hdu: int):
    """The file, unit and columns of a compressed image, and its tile sizes; a ValueError says what is wrong with it."""
    if (path, hdu) not in held:
        held.clear()
        source = fits.Bytes(path)
        u = next((x for x in fits.walk(source, hdu + 1) if x["hdu"] == hdu and not x["error"]), None)
        if u is None:
            raise ValueError(f"the file has no unit {hdu} any more")
        kw, axes = u["keywords"], u["naxes"]
        size = [fits._int(kw.get(f"ZTILE{i + 1}"), 0) if f"ZTILE{i + 1}" in kw else (axes[0] if i == 0 else 1) for i in range(len(axes))]
        if not axes or min(axes) < 1 or min(size) < 1:
            raise ValueError("the sizes of tiles are not valid")
        held[path, hdu] = source, u, {c["name"]: c for c in fits.columns(kw)}, size
    return held[path, hdu]


def _tile(held: dict, path: str, hdu: int, tile: int) -> tuple[list[tuple], np.ndarray, str | None]:
    """(plane, y, x0) of the lines of a tile, their pixels, and why some are missing."""
    source, u, cols, size = _unit(held, path, hdu)
    axes, at, start = u["naxes"], tile, []
    for a, s in zip(axes, size, strict=True):
        start.append(at % -(-a // s) * s)
        at //= -(-a // s)
    shape = [min(s, a - b) for a, b, s in zip(axes, start, size, strict=True)]
    n = int(np.prod(shape, dtype=np.int64))
    if n > MOST_TILE:
        raise ValueError(f"a tile of {n} pixels is too large")
    error, values = None, np.full(n, np.nan)
    try:
        raw = np.frombuffer(source.read(u["data_off"] + tile * u["rowlen"], u["rowlen"]), np.uint8).reshape(1, -1)
        got = _decode(u["keywords"], raw, cols, lambda a, k: source.read(u["data_off"] + u["heap"] + a, k), tile, n)[:n]
        values[: len(got)] = got
        error = None if len(got) == n else "the tile is short"
    except Exception as e:  # noqa: BLE001  whatever a damaged tile brings about concerns that tile only
        error = str(e) or type(e).__name__
    high = shape[1] if len(shape) > 1 else 1
    strides = np.cumprod([1, *axes[2:]])
    places = []
    for k in range(n // shape[0]):
        rest, plane = k // high, 0
        for i, s in enumerate(shape[2:]):
            plane += (start[2 + i] + rest % s) * int(strides[i])
            rest //= s
        places.append((plane, (start[1] if len(start) > 1 else 0) + k % high, start[0]))
    return places, values.reshape(-1, shape[0]), error


def _tiles(tables):
    held: dict = {}
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    for table in tables:
        for path, hdu, tile in zip(*(table.column(c).to_pylist() for c in ("path", "hdu", "tile")), strict=True):
            try:
                places, lines, error = _tile(held, path, hdu, tile)
                values = pa.FixedSizeListArray.from_arrays(pa.array(lines.ravel()), lines.shape[1]).cast(pa.list_(pa.float64()))
            except Exception as e:  # noqa: BLE001
                places, values, error = [(None, None, None)], pa.nulls(1, pa.list_(pa.float64())), str(e) or type(e).__name__
            n = len(places)
            columns = [pa.array([path] * n, pa.string()), pa.array([hdu] * n, pa.int32()), pa.array([tile] * n, pa.int64()), *(pa.array([p[k] for p in places], pa.int64()) for k in range(3)), values, pa.array([error] * n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _placed(tiles: DataFrame) -> DataFrame:
    """Adds ``box``: the first place and the size of each tile on every axis, from its number and the sizes in the header."""
    number = lambda k: F.nullif(F.call_function("regexp_extract", F.col("header"), F.concat(F.lit("ZTILE"), k.cast("string"), F.lit(" *= +([0-9]+)")), F.lit(1)), F.lit("")).try_cast("bigint")
    size = F.transform("naxes", lambda a, i: F.coalesce(number(i + 1), F.when(i == 0, a).otherwise(F.lit(1).cast("bigint"))))
    count = F.zip_with("naxes", "_size", lambda a, s: F.ceil(a / F.greatest(s, F.lit(1))))
    before = F.transform("_count", lambda _, i: F.aggregate(F.slice("_count", 1, i), F.lit(1).cast("bigint"), lambda x, c: x * c))
    tiles = tiles.withColumn("_size", size).withColumn("_count", count).withColumn("_before", before)
    place = F.transform("_count", lambda c, i: F.struct((F.call_function("div", F.col("tile"), F.get("_before", i)) % c * F.get("_size", i)).alias("at"), F.get("_size", i).alias("size"), F.get("naxes", i).alias("axis")))
    return tiles.withColumn("box", place).drop("_size", "_count", "_before")


def decode_tiles(hdus: DataFrame, planes: list[int] | None = None, y: tuple[int, int] | None = None, x: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of the tiles of compressed units (rows of scan_hdus): a row per line of a tile, with ``error`` where it failed.

    Tiles are dealt to tasks one by one, so one big image uses many.  ``planes``, and ranges of ``y`` and ``x``, choose tiles by their
    place in the grid before any is read; of the tiles chosen, lines outside of planes and ``y`` are left out.
    """
    units = hdus.where(F.col("zimage") & F.col("error").isNull() & (F.col("n_rows") > 0))
    tiles = units.select("path", "hdu", "naxes", "header", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1)).alias("tile"))
    tiles = _placed(tiles)
    held = lambda k, low, high: F.coalesce((F.get("box", k)["at"] < high) & (F.get("box", k)["at"] + F.get("box", k)["size"] > low), F.lit(True))
    for k, limits in ((0, x), (1, y)):
        tiles = tiles.where(held(F.lit(k), *limits)) if limits else tiles
    if planes is not None:
        # The number of a plane, taken apart along the axes behind the first two.
        outer = F.slice("box", 3, 1 << 20)
        axis = lambda p: F.aggregate(outer, F.struct(p.alias("left"), F.lit(True).alias("fits")), lambda s, b: F.struct(F.call_function("div", s["left"], b["axis"]).alias("left"), (s["fits"] & ((s["left"] % b["axis"]) >= b["at"]) & ((s["left"] % b["axis"]) < b["at"] + b["size"])).alias("fits")))["fits"]
        tiles = tiles.where(F.exists(F.array(*(F.lit(p).cast("bigint") for p in planes)), axis)) if planes else tiles.limit(0)
    out = tiles.select("path", "hdu", "tile").repartition("path", "hdu", "tile").mapInArrow(_tiles, SEGMENTS)
    out = out if planes is None else out.where(F.col("plane").isNull() | F.col("plane").isin(planes))
    return out if y is None else out.where(F.col("y").isNull() | ((F.col("y") >= y[0]) & (F.col("y") < y[1])))


def assemble(segments: DataFrame) -> DataFrame:
    """Rows of pixels from lines of tiles: path, hdu, plane, y, values, truncated."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "values")))
    rows = segments.where("plane is not null").groupBy("path", "hdu", "plane", "y").agg(parts.alias("_p"), F.bool_or(F.col("error").isNotNull()).alias("truncated"))
    return rows.select("path", "hdu", "plane", "y", F.flatten(F.transform("_p", lambda p: p["values"])).alias("values"), "truncated")
