"""Files and their data units as tables: kinds by magic, HDU lists, header cards, and the same over bytes in a column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starframe.operators import headers
from starframe.sources import fits

#: Suffixes in use.
SUFFIXES = "fits fit fts fz xisf asdf pha pi arf rmf rsp rsp2 evt lc hk mkf dph img".split()
HDUS = "path string, hdu int, format string, xtension string, extname string, bitpix int, naxes array<bigint>, rowlen bigint, n_rows bigint, pcount bigint, gcount bigint, bscale double, bzero double, blank bigint, groups boolean, zimage boolean, cmptype string, supported boolean, tfields bigint, heap bigint, hdr_off bigint, hdr_len bigint, data_off bigint, data_len bigint, next_off bigint, header string, truncated boolean, error string"
#: Bytes that a file's kind is told by; shorter files are none.
HEAD = 16
#: Bytes of pixels in a batch.
BATCH_BYTES = 8 << 20
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def kind_of(magic: Column) -> Column:
    """fits, xisf, asdf or gzip by the first bytes; null for others."""
    head = F.hex(F.substring(magic, 1, 9))
    return (
        F.when(head == "53494D504C4520203D", "fits").when(head.startswith("5849534630313030"), "xisf").when(head.startswith("2341534446"), "asdf").when(head.startswith("1F8B"), "gzip")
    )


def from_content(df: DataFrame, column: str = "content", path: str = "path") -> DataFrame:
    """Files already in memory: path, format, gz, length, error and content of any table with a binary column."""
    magic = kind_of(F.col(column))
    short = F.octet_length(column) < HEAD
    error = F.when(short, "too short").when(magic.isNull(), "unknown kind of file")
    return df.select(F.col(path).alias("path"), F.when(~short, magic).alias("format"), (magic == "gzip").alias("gz"), F.octet_length(column).cast("bigint").alias("length"), *([F.col("modificationTime").alias("mtime")] if "modificationTime" in df.columns else []), error.alias("error"), F.col(column).alias("content"))


def scan_files(spark: SparkSession, path: str, pattern: str | None = None, content: bool = False) -> DataFrame:
    """One row per file under a path: path, format, gz, length, mtime, error (and content).  Kinds go by magic, not by name.

    Without ``content`` Spark lists the files and tasks open each for its first bytes, so files may have any size; ``format``
    of a gzipped file is what is in it; empty files have no row, as in Spark's own listings.  With ``content`` whole files are read (2 GiB at most), from any store that Spark reads.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (read.option("pathGlobFilter", pattern) if pattern else read).load(path)
    return from_content(df) if content else _classified(df.select("path", "length", "modificationTime"))


def _heads(tables):
    """The first bytes of files, of gzipped ones those inside; why a file can't be opened."""
    for table in tables:
        heads, gz, errors = [], [], []
        for path in table.column("path").to_pylist():
            try:
                head, packed, error = *fits.head(path, HEAD), None
            except OSError as e:
                head, packed, error = None, None, f"can't be opened: {e.strerror or e}"
            heads.append(head)
            gz.append(packed)
            errors.append(error)
        names = ["path", "length", "modificationTime"]
        yield pa.RecordBatch.from_arrays([*(pa.array(table.column(n)) for n in names), pa.array(heads, pa.binary()), pa.array(gz, pa.bool_()), pa.array(errors, pa.string())], names=[*names, "head", "gz", "problem"])


def _classified(listed: DataFrame) -> DataFrame:
    """Files of a listing (path, length, modificationTime): path, format, gz, length, mtime, error."""
    found = listed.mapInArrow(_heads, "path string, length bigint, modificationTime timestamp, head binary, gz boolean, problem string")
    short, kind = F.octet_length("head") < HEAD, kind_of(F.col("head"))
    error = F.coalesce(F.col("problem"), F.when(short, "too short").when(kind.isNull(), "unknown kind of file"))
    return found.select("path", F.when(error.isNull(), kind).alias("format"), "gz", "length", F.col("modificationTime").alias("mtime"), error.alias("error"))


def _hdus(tables, most: int):
    names = [x.split()[0] for x in HDUS.split(", ")]
    kinds = [_ARROW[x.split()[1]] for x in HDUS.split(", ")]
    for table in tables:
        rows = []
        contents = table.column("content").to_pylist() if "content" in table.schema.names else [None] * table.num_rows
        for path, content in zip(table.column("path").to_pylist(), contents, strict=True):
            try:
                source = fits.Bytes(None if content is not None else path, content)
                for u in fits.walk(source, most):
                    cut = source.truncated or u.get("data_off", 0) + u.get("data_len", 0) > source.size
                    rows.append({"path": path, "format": "fits", "truncated": cut, **u})
            except (OSError, ValueError, OverflowError, MemoryError) as e:
                rows.append({"path": path, "hdu": 0, "error": str(e)})
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def scan_hdus(files: DataFrame, most: int = fits.MOST_HDUS) -> DataFrame:
    """One row per FITS data unit of a table of files (path, and content or readable paths): a walk from header to header within a
    file, and files side by side; a walk ends after ``most`` units.  Write the result as Parquet: it is the index that later jobs
    start from."""
    own = files.where(F.col("format").isin("fits", "gzip")).select("path", *(["content"] if "content" in files.columns else []))
    return own.mapInArrow(lambda tables: _hdus(tables, most), HDUS)


def scan_cards(hdus: DataFrame) -> DataFrame:
    """Header cards of units with their header text: path, hdu, seq, card, kind, key, value, is_string, comment; no Python per card."""
    return headers.parse_cards(headers.split_cards(hdus.where("error is null").select("path", "hdu", "header")))


def hdus_of(files: DataFrame) -> DataFrame:
    """Units of all formats in one table: FITS units, XISF images and ASDF arrays."""
    from starframe.sources import asdf, xisf

    common = ["path", "hdu", "format", "extname", "bitpix", "naxes", "supported", "error"]
    return scan_hdus(files).unionByName(xisf.images(files).select(*common, "dtype"), allowMissingColumns=True).unionByName(asdf.arrays(files).select(*common, "dtype"), allowMissingColumns=True)


def table_rows(files: DataFrame, schema: str, hdu: int = 1) -> DataFrame:
    """Typed rows of a table unit of files in memory (path, content): path, _row and the columns of ``schema`` (names and types).

    Files without the unit or one of the columns in its type, or whose columns do not fit a row, have no rows.
    """
    from starframe.sources.fits_sources import arrow

    names, kinds = zip(*(x.strip().split(" ", 1) for x in schema.split(", ")), strict=True)

    def rows(tables):
        import numpy as np

        for table in tables:
            for path, content in zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True):
                source = fits.Bytes(content=content)
                u = next((u for u in fits.walk(source, hdu + 1) if u["hdu"] == hdu and not u["error"]), None)
                if u is None or not u["rowlen"]:
                    continue
                cols = {c["name"]: c for c in fits.columns(u["keywords"])}
                if any(c not in cols or fits.spark_type(cols[c]) != k for c, k in zip(names, kinds, strict=True)):
                    continue
                n = min(u["n_rows"], max(0, source.size - u["data_off"]) // u["rowlen"])
                raw = np.frombuffer(source.read(u["data_off"], n * u["rowlen"]), np.uint8).reshape(n, u["rowlen"])
                heap = lambda at, k: source.read(u["data_off"] + u["heap"] + at, k)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n)), *(pa.array(fits.cells(raw, cols[c], heap), arrow(k)) for c, k in zip(names, kinds, strict=True))], names=["path", "_row", *names])

    return files.select("path", "content").mapInArrow(rows, f"path string, _row bigint, {schema}")


def image_rows(files: DataFrame, hdu: int = 0) -> DataFrame:
    """Rows of pixels of an image unit of files in memory: path, hdu, plane, y, values, truncated; what is cut off is NaN.

    Rows come in batches of some megabytes.  A unit of which a file holds less than a thousandth has one row, of null values.
    """
    from starframe.sources.fits_sources import PIXELS, _pixel_batch, pixels

    def rows(tables):
        import numpy as np

        for table in tables:
            for path, content in zip(table.column("path").to_pylist(), table.column("content"), strict=True):
                source = fits.Bytes(content=content.as_py())
                u = next((u for u in fits.walk(source, hdu + 1) if u["hdu"] == hdu and not u["error"]), None)
                if u is None or not u["naxes"] or min(u["naxes"]) < 1 or u["zimage"]:
                    continue
                width, height = u["naxes"][0], u["naxes"][1] if len(u["naxes"]) > 1 else 1
                total, size = 1, abs(u["bitpix"]) // 8
                for n in u["naxes"]:
                    total *= n
                if total * size > 1000 * max(source.size, fits.BLOCK):  # axes that the file can't have been written with
                    yield _pixel_batch(path, hdu, 0, range(1), pa.nulls(1, pa.list_(pa.float64())), True)
                    continue
                step = max(1, BATCH_BYTES // (8 * width))
                for plane in range(total // (width * height)):
                    for y in range(0, height, step):
                        n = min(step, height - y)
                        raw = source.read(u["data_off"] + (plane * height + y) * width * size, n * width * size)
                        got = np.full(n * width, np.nan)
                        have = pixels(np.frombuffer(raw[: len(raw) // size * size], fits.DTYPES[u["bitpix"]]), u["bscale"], u["bzero"], u["blank"])
                        got[: len(have)] = have
                        values = pa.FixedSizeListArray.from_arrays(pa.array(got), width).cast(pa.list_(pa.float64()))
                        short = source.size < u["data_off"] + total * size
                        yield _pixel_batch(path, hdu, plane, range(y, y + n), values, short)

    return files.select("path", "content").mapInArrow(rows, PIXELS)


def unzipped(files: DataFrame, most: int = fits.MOST_GZIP) -> DataFrame:
    """Files of a table with ``content``, gzipped ones replaced by what is in them, of which up to ``most`` bytes are inflated.

    ``format`` is that of the file inside, ``gz`` stays true; ``error`` tells of one that is cut short, damaged or too long.
    """

    def inflate(tables):
        for table in tables:
            for k, content in enumerate(table.column("content")):
                data, cut = fits.inflate(content.as_py() or b"", most)
                error = "the gzip data is damaged, cut short or too long" if cut else None
                yield pa.RecordBatch.from_arrays([table.column("path").slice(k, 1), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "_cut"])

    columns = files.columns
    packed = files.where("format = 'gzip'")
    opened = packed.select("path", "content").mapInArrow(inflate, "path string, content binary, _cut string")
    made = opened.select("path", "_cut", F.col("content").alias("_content"), kind_of(F.col("content")).alias("_format"), F.octet_length("content").cast("bigint").alias("_length"))
    made = made.withColumn("_error", F.coalesce(F.col("_cut"), F.when(F.col("_length") < 16, "too short").when(F.col("_format").isNull(), "unknown kind of file")))
    new = {"format": F.col("_format"), "length": F.col("_length"), "content": F.col("_content"), "error": F.col("_error")}
    joined = packed.drop(*[c for c in new if c in columns]).join(made, "path").withColumns(new)
    return files.where("format is null or format <> 'gzip'").unionByName(joined.select(*columns))
