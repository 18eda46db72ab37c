"""Pixels by ranges of bytes: what rows of an image need is joined with the frames that hold it, and only those are read.

``frames``: path, block, frame, pos, raw, at, stored, comp: the bytes [pos, pos + raw) of a block's data are those that ``stored``
bytes of the file from ``at`` on decode to.  ``chunks``: path, block, hdu, plane, y0, rows, width, kind, sx, sy, base, lo, hi, parts:
rows y0.. of a plane lie in the bytes [lo, hi) of the block's data, the first pixel at lo + base, with strides sx and sy.  With
``parts`` over 1 the data was shuffled: byte b of item i is at b * (size / parts) + i.

A frame is decoded once for all chunks that want it, and chunks are put together from pieces.  Any failure concerns its frame only:
the pixels it holds are missing, and ``error`` says why.
"""

from __future__ import annotations

import bz2
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.operators.ranges import overlap_join

#: Bytes of a chunk of rows, and of a frame of data that is stored as it is; bytes that a frame may decode to.
PIECE, MOST_RAW = 4 << 20, 1 << 30
#: Rows of a batch that are Python objects at once.
AT_ONCE = 16
ROWS = "path string, hdu int, plane bigint, y bigint, values array<double>, truncated boolean, error string"


def decode(comp: str, data: bytes, raw: int) -> bytes:
    """The ``raw`` bytes of a frame; a ValueError where it can't have so many, or has others."""
    if not 0 <= raw <= MOST_RAW:
        raise ValueError(f"a frame of {raw} bytes is too large")
    if comp == "":
        out = data
    elif comp == "zlib":
        out = zlib.decompressobj().decompress(data, raw + 1)
    elif comp == "bzp2":
        out = bz2.BZ2Decompressor().decompress(data, raw + 1)
    elif comp in ("lz4", "lz4hc", "zstd"):
        # A byte of LZ4 makes 255 at most.
        if comp != "zstd" and raw > 255 * len(data) + 64:
            raise ValueError("a frame's declared size is more than it can decode to")
        out = pa.Codec("zstd" if comp == "zstd" else "lz4_raw").decompress(data, raw).to_pybytes()
    else:
        raise ValueError(f"compression {comp} is not supported")
    if len(out) != raw:
        raise ValueError(f"a frame has {len(out)} bytes, not {raw}")
    return out


def even_frames(units: DataFrame, at: Column, size: Column) -> DataFrame:
    """Frames of data stored as it is: ``units`` (path, block, ...) with the columns of a frame, PIECE bytes each."""
    own = units.where(size > 0).select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(PIECE).cast("long"))).alias("frame", "pos"))
    raw = F.least(F.lit(PIECE).cast("long"), size - F.col("pos"))
    return own.withColumns({"raw": raw, "stored": raw, "at": at + F.col("pos"), "comp": F.lit("")})


def chunked(units: DataFrame) -> DataFrame:
    """Chunks of units: path, block, hdu, kind, item, parts, count (items), origin, lead, lead_steps, height, width, sy, sx, plane (null: all).

    Strides and ``origin`` are bytes; ``lead`` has the axes before the last two.
    """
    product = lambda xs: F.aggregate(xs, F.lit(1).cast("long"), lambda a, x: a * x)
    planes = units.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), product(F.col("lead")) - 1))).where(F.col("plane").isNull() | (F.col("p") == F.col("plane")))
    place = F.zip_with(F.transform("lead", lambda d, k: F.call_function("div", F.col("p"), product(F.slice("lead", k + 2, 1 << 20))) % d), "lead_steps", lambda i, s: i * s)
    planes = planes.withColumn("origin", F.col("origin") + F.aggregate(place, F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("plane", F.col("p")).drop("p", "lead", "lead_steps")
    # Where rows lie close together, as in a transposed array, every chunk would need all of the plane.
    rows = F.when(F.abs("sx") <= F.abs("sy"), F.greatest(F.lit(1).cast("long"), F.floor(PIECE / F.greatest(F.abs("sy"), F.lit(1))))).otherwise(F.col("height"))
    out = planes.withColumn("step", F.least(rows, F.col("height"))).withColumn("y0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1, F.col("step"))))
    out = out.withColumns({"rows": F.least("step", F.col("height") - F.col("y0")), "first": F.col("origin") + F.col("y0") * F.col("sy")})
    reach = lambda f: f((F.col("rows") - 1) * F.col("sy"), F.lit(0)) + f((F.col("width") - 1) * F.col("sx"), F.lit(0))
    out = out.withColumns({"lo": F.col("first") + reach(F.least), "hi": F.col("first") + reach(F.greatest) + F.col("item")})
    # Shuffled items are whole ones.
    out = out.withColumns({"lo": F.when(F.col("parts") > 1, F.floor(F.col("lo") / F.col("item")) * F.col("item")).otherwise(F.col("lo")), "hi": F.when(F.col("parts") > 1, F.ceil(F.col("hi") / F.col("item")) * F.col("item")).otherwise(F.col("hi"))})
    return out.withColumn("base", F.col("first") - F.col("lo")).select("path", "block", "hdu", "plane", "y0", "rows", "width", "kind", "item", "parts", "count", "sx", "sy", "base", "lo", "hi")


def wanted(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with the ranges that chunks want of them: one row for each chunk, part and frame."""
    part = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: F.when(F.col("parts") > 1, F.struct((b * F.col("count") + F.col("lo") / F.col("item")).cast("long").alias("a"), (b * F.col("count") + F.col("hi") / F.col("item")).cast("long").alias("z"))).otherwise(F.struct(F.col("lo").alias("a"), F.col("hi").alias("z")))))
    ranges = chunks.select("path", "block", "hdu", "plane", "y0", part.alias("part", "r")).select("path", "block", "hdu", "plane", "y0", "part", F.col("r.a").alias("want_from"), F.col("r.z").alias("want_to"))
    return overlap_join(ranges, frames.withColumn("end", F.col("pos") + F.least("raw", F.lit(MOST_RAW + 1))), ["path", "block"], ("want_from", "want_to"), ("pos", "end"), PIECE)


def _each(table):
    """Rows as dictionaries; a batch may hold thousands of rows of megabytes, so only a few of its rows are copied at once."""
    for k in range(0, table.num_rows, AT_ONCE):
        yield from table.slice(k, AT_ONCE).to_pylist()


def _pieces(tables):
    from starframe.sources import fits

    names = ["path", "hdu", "plane", "y0", "part", "off", "piece", "error"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    held: dict[str, fits.Bytes] = {}
    for table in tables:
        for r in _each(table):
            data, error = b"", r["error"]
            try:
                stored = r.get("bytes")
                if stored is None and "bytes" not in table.schema.names:
                    if r["path"] not in held:
                        held.clear()
                        held[r["path"]] = fits.Bytes(r["path"])
                    stored = held[r["path"]].read(r["at"], r["stored"])
                if len(stored or b"") < r["stored"]:
                    raise ValueError("the file ends before its data")
                data = decode(r["comp"], stored, r["raw"])
            except Exception as e:  # noqa: BLE001  whatever a damaged frame brings about concerns that frame only
                error = error or str(e) or type(e).__name__
            rows = []
            for w in r["wants"]:
                a, z = max(w["want_from"], r["pos"]), min(w["want_to"], r["pos"] + r["raw"])
                rows.append((r["path"], w["hdu"], w["plane"], w["y0"], w["part"], a - w["want_from"], None if error else data[a - r["pos"] : z - r["pos"]], error))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)


def _rows(tables):
    names = [x.split()[0] for x in ROWS.split(", ")]
    for table in tables:
        for r in _each(table):
            size, item = r["hi"] - r["lo"], r["item"]
            each = size // r["parts"]
            try:
                buffer, have = np.zeros((r["parts"], each), np.uint8), np.zeros((r["parts"], each), bool)
                errors = []
                for p in r["pieces"] or []:
                    if p["error"] is not None:
                        errors.append(p["error"])
                        continue
                    buffer[p["part"], p["off"] : p["off"] + len(p["piece"])] = np.frombuffer(p["piece"], np.uint8)
                    have[p["part"], p["off"] : p["off"] + len(p["piece"])] = True
                flat, known = (np.ascontiguousarray(x.T).ravel() if r["parts"] > 1 else x.ravel() for x in (buffer, have))
                shape, strides = (r["rows"], r["width"]), (r["sy"], r["sx"])
                out = np.ndarray(shape, np.dtype(r["kind"]), flat, r["base"], strides).astype(np.float64)
                there = np.ndarray(shape, bool, known, r["base"], strides) & np.ndarray(shape, bool, known, r["base"] + item - 1, strides)
                out[~there] = np.nan
                whole = bool(there.all())
                error = None if whole else errors[0] if errors else "the data is missing or cut short"
                values = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), r["width"]).cast(pa.list_(pa.float64()))
                n = r["rows"]
            except Exception as e:  # noqa: BLE001
                n, whole, error, values = 1, False, str(e) or type(e).__name__, pa.nulls(1, pa.list_(pa.float64()))
            columns = [[r["path"]] * n, [r["hdu"]] * n, [r["plane"]] * n, list(range(r["y0"], r["y0"] + n)), values, [not whole] * n, [error] * n]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), None, pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([c if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pixels(chunks: DataFrame, frames: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows of pixels of chunks: path, hdu, plane, y, values, truncated, error.

    ``files`` with ``content``: bytes come from there; else tasks read ranges of the files by path.  ``frames`` may have ``bytes``.
    """
    want = F.struct("hdu", "plane", "y0", "part", "want_from", "want_to")
    more = [c for c in ("bytes", "error") if c in frames.columns]
    found = wanted(chunks, frames).groupBy("path", "block", "frame", "pos", "raw", "at", "stored", "comp", *more).agg(F.collect_list(want).alias("wants"))
    if "error" not in more:
        found = found.withColumn("error", F.lit(None).cast("string"))
    if "bytes" not in more and files is not None and "content" in files.columns:
        stored = F.substring("content", (F.col("at") + 1).cast("int"), F.least("stored", F.lit(MOST_RAW)).cast("int"))
        found = found.join(files.select("path", "content"), "path").withColumn("bytes", stored).drop("content")
    pieces = found.mapInArrow(_pieces, "path string, hdu int, plane bigint, y0 bigint, part int, off bigint, piece binary, error string")
    held = pieces.groupBy("path", "hdu", "plane", "y0").agg(F.collect_list(F.struct("part", "off", "piece", "error")).alias("pieces"))
    return chunks.join(held, ["path", "hdu", "plane", "y0"], "left").mapInArrow(_rows, ROWS)
