"""Results written out: selected rows as text, binned planes and plots as Parquet, thumbnails as PNG bytes in a column."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starframe.operators import _groups as G
from starframe.operators import images


def write_rows_tsv(df: DataFrame, path: str, max_rows: int = 100_000, order: list[str] | None = None) -> None:
    """The first ``max_rows`` rows as tab-separated text with a line of column names; nested values as JSON, bytes as hex.

    Rows are in the order of some columns, unless named those of path, hdu and _row that there are; without any they are any rows.
    """
    order = [c for c in ("path", "hdu", "_row") if c in df.columns] if order is None else order
    df = df.orderBy(*order) if order else df
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(F.struct(c.alias("v"))) if isinstance(f.dataType, T.MapType) else F.to_json(c)
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        out.append(c.alias(f.name))
    df.limit(max_rows).select(*out).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_results(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Binned planes, envelopes, grids or axis rows as Parquet, in folders by some columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def png(levels: np.ndarray) -> bytes:
    """8-bit levels, rows from the top: grey (height, width) or with alpha (height, width, 4)."""
    height, width = levels.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(levels, np.uint8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if levels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def _pack(names: list[str], types, width: int, height: int, flip: bool):
    def pack(table: pa.Table) -> pa.Table:
        oy, ox = table["oy"].to_numpy(), table["ox"].to_numpy()
        inside = (oy >= 0) & (oy < height) & (ox >= 0) & (ox < width)
        row = (height - 1 - oy if flip else oy)[inside]
        cols = ["red", "green", "blue"] if "red" in table.column_names else ["level"]
        rgba = np.zeros((height, width, 4), np.uint8)
        full = np.ones(inside.sum(), bool)
        for k, c in enumerate(cols):
            v = table[c].to_pandas().to_numpy(np.float64, na_value=np.nan)[inside]
            full &= ~np.isnan(v)
            rgba[row, ox[inside], k] = np.nan_to_num(v)
        rgba[row, ox[inside], 3] = np.where(full, 255, 0)
        if len(cols) == 1:
            rgba[:, :, 1] = rgba[:, :, 2] = rgba[:, :, 0]
        image = rgba[:, :, 0] if len(cols) == 1 and rgba[:, :, 3].all() else rgba
        return pa.table([*(table[n].slice(0, 1) for n in names), pa.array([png(image)], pa.binary())], names=[*names, "png"])

    return pack


def thumbnails(cells: DataFrame, stretch: DataFrame, width: int, height: int, by: list[str] = ("path", "hdu"), flip: bool = True) -> DataFrame:
    """One row for each image: its keys and a PNG, at most 2048 a side, from binned cells (oy, ox, value) and their stretch.

    Grey, or with alpha where cells are missing; ``flip``: the first row is the bottom one.  Levels are column expressions; a task
    packs one small picture at a time.
    """
    if max(width, height) > 2048:
        raise ValueError("thumbnails have 2048 pixels a side at most")
    own, keys = G.keys(images.stretched(cells, stretch, list(by)), list(by))
    own = own.select(*keys, "oy", "ox", "level")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema.fields)
    return G.tidy(own.groupBy(*keys).applyInArrow(_pack(keys, None, width, height, flip), f"{kind}, png binary"))


def fits_tables(df: DataFrame, forms: dict[str, str], by: str, more: dict[str, object] | None = None) -> DataFrame:
    """FITS files as rows (path, content): a binary table for each value of ``by``, which must keep groups small enough for a task.

    ``forms``: TFORM by column; ``more``: further keywords (scaling, null values).  Rows are in the order of the columns, so that a
    task that runs again writes the same bytes.
    """
    from starframe.sources import fits

    def pack(table: pa.Table) -> pa.Table:
        cols = []
        table = table.sort_by([(c, "ascending") for c in forms])
        for name, form in forms.items():
            v = table[name].to_numpy()
            cols.append((name, form, v.astype(f"S{form[:-1]}") if form.endswith("A") else v.astype(np.dtype(fits.NUMPY[form[-1]]).newbyteorder("="))))
        content = fits.table_bytes(cols, [fits.card(k, v) for k, v in (more or {}).items()])
        return pa.table([pa.array([str(table[by][0].as_py())]), pa.array([content], pa.binary())], names=["path", "content"])

    return df.select(by, *(c for c in forms if c != by)).groupBy(by).applyInArrow(pack, "path string, content binary")


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of 32-bit floats, NaN for null, without a Python object for each value."""
    lengths = pc.unique(pc.list_value_length(values)).to_pylist()
    if len(lengths) != 1 or lengths[0] is None:
        raise ValueError("the rows of an image need values, as many in each")
    return pc.list_flatten(values).to_numpy().astype(np.float32, copy=False).reshape(len(values), lengths[0])


def fits_images(rows: DataFrame, by: str, y: str = "y", values: str = "values") -> DataFrame:
    """FITS files as rows (path, content): a 32-bit float image for each value of ``by``, its rows in the order of ``y``."""
    from starframe.sources import fits

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(y)
        content = fits.image_bytes(_matrix(table[values]))
        return pa.table([pa.array([str(table[by][0].as_py())]), pa.array([content], pa.binary())], names=["path", "content"])

    return rows.select(by, y, values).groupBy(by).applyInArrow(pack, "path string, content binary")


def _packed(rows: DataFrame, by: str, y: str, values: str, make) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(y)
        content = make(_matrix(table[values]))
        return pa.table([pa.array([str(table[by][0].as_py())]), pa.array([content], pa.binary())], names=["path", "content"])

    return rows.select(by, y, values).groupBy(by).applyInArrow(pack, "path string, content binary")


def asdf_cubes(rows: DataFrame, by: str, shape: tuple[int, ...], frame: int = 4 << 20, y: str = "y", values: str = "values", kind: str = "float32") -> DataFrame:
    """ASDF files as rows (path, content): for each value of ``by`` an array ``data`` of one plane of ``shape`` for each row, LZ4 in frames."""
    from starframe.sources.asdf import DTYPES

    def make(cube: np.ndarray) -> bytes:
        cube = cube.reshape(-1, *shape)
        raw = memoryview(np.ascontiguousarray(cube, f"<{DTYPES[kind]}").reshape(-1)).cast("B")
        blocks = []
        for k in range(0, len(raw), frame):
            part = raw[k : k + frame]
            packed = pa.Codec("lz4_raw").compress(part, asbytes=True)
            blocks.append((len(packed) + 4).to_bytes(4, "big") + len(part).to_bytes(4, "little") + packed)
        data = b"".join(blocks)
        sizes = b"".join(n.to_bytes(8, "big") for n in (len(data), len(data), len(raw)))
        tree = f"#ASDF 1.0.0\n#ASDF_STANDARD 1.5.0\n%YAML 1.1\n%TAG ! tag:stsci.edu:asdf/\n--- !core/asdf-1.1.0\ndata: !core/ndarray-1.0.0\n  source: 0\n  datatype: {kind}\n  byteorder: little\n  shape: {list(cube.shape)}\n...\n"
        return tree.encode() + b"\xd3BLK" + (48).to_bytes(2, "big") + bytes(4) + b"lz4\0" + sizes + bytes(16) + data

    return _packed(rows, by, y, values, make)


def xisf_images(rows: DataFrame, by: str, subblocks: int = 3, y: str = "y", values: str = "values", codec: str = "zlib") -> DataFrame:
    """XISF files as rows (path, content): a grey Float32 image for each value of ``by``, shuffled and compressed (zlib, lz4, zstd), in subblocks."""
    import zlib

    def make(image: np.ndarray) -> bytes:
        raw = np.frombuffer(image.astype("<f4").tobytes(), np.uint8).reshape(-1, 4).T.tobytes()
        parts = [raw[k * len(raw) // subblocks : (k + 1) * len(raw) // subblocks] for k in range(subblocks)]
        packed = [zlib.compress(p) if codec == "zlib" else pa.Codec({"lz4": "lz4_raw"}.get(codec, codec)).compress(p, asbytes=True) for p in parts]
        listed = ":".join(f"{len(a)},{len(b)}" for a, b in zip(packed, parts, strict=True))
        return _xisf(image, b"".join(packed), f'compression="{codec}+sh:{len(raw)}:4" subblocks="{listed}"')

    return _packed(rows, by, y, values, make)


def xisf_embedded(rows: DataFrame, by: str, encoding: str = "base64", y: str = "y", values: str = "values") -> DataFrame:
    """XISF files as rows (path, content) whose samples stand in the header, as base64 or hex text in lines."""
    import base64
    import textwrap

    def make(image: np.ndarray) -> bytes:
        raw = image.astype("<f4").tobytes()
        return _xisf(image, b"", text="\n".join(textwrap.wrap(raw.hex() if encoding == "hex" else base64.b64encode(raw).decode(), 76)), encoding=encoding)

    return _packed(rows, by, y, values, make)


def _xisf(image: np.ndarray, data: bytes, more: str = "", text: str = "", encoding: str = "") -> bytes:
    """A file of one grey image: its data after the header, or as encoded text within it."""
    at = 4096
    place = f'location="attachment:{at}:{len(data)}" {more}/>' if data else f'location="embedded"><Data encoding="{encoding}">{text}</Data></Image>'
    xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0" xmlns="http://www.pixinsight.com/xisf"><Image id="main" geometry="{image.shape[1]}:{image.shape[0]}:1" sampleFormat="Float32" colorSpace="Gray" {place}</xisf>'.encode()
    return (b"XISF0100" + len(xml).to_bytes(4, "little") + bytes(4) + xml).ljust(at, b"\0") + data


def tiled_images(rows: DataFrame, by: str, tile: tuple[int, int] = (32, 16), y: str = "y", values: str = "values") -> DataFrame:
    """FITS files as rows (path, content): a 32-bit float image for each value of ``by``, in gzipped tiles (width, height)."""

    def make(image: np.ndarray) -> bytes:
        return _tiled(image, tile, [t.astype(">f4").tobytes() for t in _tiles_of(image, tile)], {"ZCMPTYPE": "GZIP_1"})

    return _packed(rows, by, y, values, make)


def quantised_images(rows: DataFrame, by: str, scale: float, tile: tuple[int, int] = (32, 16), y: str = "y", values: str = "values") -> DataFrame:
    """The same with values as whole numbers of ``scale``, dithered (SUBTRACTIVE_DITHER_1), their bytes in planes (GZIP_2)."""
    from starframe.sources.tiles import dither_index, dither_table

    def make(image: np.ndarray) -> bytes:
        packed = []
        for k, part in enumerate(_tiles_of(image, tile)):
            v = part.astype(np.float64).ravel()
            whole = np.floor(v / scale + dither_table()[dither_index(k % 10_000, v.size)]).astype(">i4")
            packed.append(np.frombuffer(whole.tobytes(), np.uint8).reshape(-1, 4).T.tobytes())
        return _tiled(image, tile, packed, {"ZCMPTYPE": "GZIP_2", "ZQUANTIZ": "SUBTRACTIVE_DITHER_1", "ZDITHER0": 1}, scale)

    return _packed(rows, by, y, values, make)


def _tiles_of(image: np.ndarray, tile: tuple[int, int]) -> list[np.ndarray]:
    return [image[top : top + tile[1], left : left + tile[0]] for top in range(0, image.shape[0], tile[1]) for left in range(0, image.shape[1], tile[0])]


def _tiled(image: np.ndarray, tile: tuple[int, int], data: list[bytes], more: dict[str, object], scale: float | None = None) -> bytes:
    """A file of one image in tiles whose data are gzipped into the heap; with ``scale`` they are whole numbers of it."""
    import gzip

    from starframe.sources import fits

    heap = [gzip.compress(x, mtime=0) for x in data]
    ends = np.cumsum([0, *map(len, heap)])
    columns = [("COMPRESSED_DATA", "1PB", np.stack([np.diff(ends), ends[:-1]], axis=1).astype(np.int32))]
    if scale is not None:
        columns += [("ZSCALE", "1D", np.full(len(heap), scale)), ("ZZERO", "1D", np.zeros(len(heap)))]
    keys = {"ZIMAGE": True, "ZBITPIX": -32, "ZNAXIS": 2, "ZNAXIS1": image.shape[1], "ZNAXIS2": image.shape[0], "ZTILE1": tile[0], "ZTILE2": tile[1], **more}
    return fits.table_bytes(columns, [fits.card(k, v) for k, v in keys.items()], "COMPRESSED", b"".join(heap))


def gzipped(files: DataFrame, members: int = 2) -> DataFrame:
    """Files (path, content) gzipped, in so many members one behind the other; other columns are dropped."""
    import gzip

    def pack(tables):
        for table in tables:
            for k, content in enumerate(table.column("content")):
                raw = content.as_py()
                parts = [raw[i * len(raw) // members : (i + 1) * len(raw) // members] for i in range(members)]
                yield pa.RecordBatch.from_arrays([table.column("path").slice(k, 1), pa.array([b"".join(gzip.compress(p, mtime=0) for p in parts)], pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(pack, "path string, content binary")


def write_files(files: DataFrame, folder: str, suffix: str = ".fits") -> DataFrame:
    """Writes each row (path, content) to a file of a folder that driver and executors share; returns their paths (path, format).

    A file is written under another name and then renamed, so a task that runs twice leaves one whole file.
    """
    import os
    import uuid

    folder = folder.removeprefix("file://").removeprefix("file:")

    def write(tables):
        os.makedirs(folder, exist_ok=True)
        for table in tables:
            paths = []
            for name, content in zip(table.column("path").to_pylist(), table.column("content"), strict=True):
                paths.append(f"{folder}/{name}{suffix}")
                part = f"{paths[-1]}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content.as_py())
                os.replace(part, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return files.select("path", "content").mapInArrow(write, "path string").withColumn("format", F.lit("fits"))
