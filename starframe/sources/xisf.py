"""XISF: headers parsed by Spark's own XML functions, samples decoded by library codecs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starframe.operators.ranges import running
from starframe.sources import stored as S

_ATTRS = ["id", "geometry", "sampleFormat", "colorSpace", "pixelStorage", "byteOrder", "orientation", "location", "compression", "subblocks"]
_SCHEMA = (
    "Image array<struct<" + ", ".join(f"_{a}: string" for a in _ATTRS) + ", Data: struct<content_: string, _encoding: string, _compression: string>, content_: string, "
    "FITSKeyword: array<struct<_name: string, _value: string, _comment: string>>, Property: array<struct<_id: string, _type: string, _value: string, content_: string>>, "
    "ColorFilterArray: struct<_pattern: string, _width: string, _height: string>>>"
)
MOST_HEADER = 16 << 20


def headers_of(files: DataFrame) -> DataFrame:
    """path, content, xml (null with a reason where the header can't be used)."""
    c = F.col("content")
    byte = lambda k: F.conv(F.hex(F.substring(c, k, 1)), 16, 10).cast("bigint")
    size = byte(9) + byte(10) * 256 + byte(11) * 65536 + byte(12) * 16777216
    xml = F.make_valid_utf8(F.substring(c, F.lit(17), F.least(size, F.lit(MOST_HEADER)).cast("int")).cast("string"))
    own = files.where("format = 'xisf'").select("path", "content", xml.alias("xml"), size.alias("_n"), F.octet_length(c).alias("_length"))
    bad = F.when(F.col("_n") > MOST_HEADER, "the header is too long").when(F.col("_n") + 16 > F.col("_length"), "the header is cut short").when(F.upper("xml").contains("<!DOCTYPE"), "the header has a document type").when(~F.col("xml").contains("<xisf"), "the header is not valid")
    return own.withColumn("error", bad)


def _parsed(files: DataFrame) -> DataFrame:
    own = headers_of(files)
    # Attributes are matched without their namespace.
    doc = F.regexp_replace(F.regexp_replace("xml", "^\\s*<\\?xml[^>]*\\?>", ""), " xmlns(:[a-z]+)?=\"[^\"]*\"| xsi:[a-zA-Z]+=\"[^\"]*\"", "")
    parsed = F.when(F.col("error").isNull(), F.from_xml(doc, _SCHEMA, {"mode": "PERMISSIVE", "valueTag": "content_"}))
    return own.select("path", "content", "error", parsed.alias("doc"))


def images(files: DataFrame) -> DataFrame:
    """One row per image: path, hdu, geometry, format and place of its samples; ``error`` where it can't be read.  A file whose
    header is bad gives one row with the reason."""
    rows = _parsed(files).select("path", "content", "error", F.posexplode_outer("doc.Image").alias("hdu", "i"))
    axes = F.transform(F.split("i._geometry", ":"), lambda x: x.try_cast("bigint"))
    place = F.split(F.coalesce("i._location", F.lit("")), ":")
    data = F.coalesce("i.Data._compression", "i._compression", F.lit(""))
    codec = F.split(data, ":")
    kind = F.col("i._sampleFormat")
    size = F.when(kind == "UInt8", 1).when(kind == "UInt16", 2).when(kind.isin("UInt32", "Float32"), 4).when(kind.isin("UInt64", "Float64"), 8)
    name = F.regexp_replace(codec[0], "\\+sh$", "")
    out = rows.select(
        "path", F.coalesce("hdu", F.lit(0)).alias("hdu"), F.lit("xisf").alias("format"), F.coalesce("i._id", F.lit("")).alias("extname"), F.coalesce(axes, F.array().cast("array<bigint>")).alias("naxes"),
        F.when(kind == "Float32", -32).when(kind == "Float64", -64).otherwise(size * 8).cast("int").alias("bitpix"), F.lower(kind).alias("dtype"), size.alias("item"),
        F.coalesce("i._pixelStorage", F.lit("Planar")).alias("storage"), F.coalesce("i._byteOrder", F.lit("little")).alias("byte_order"), F.coalesce("i._colorSpace", F.lit("Gray")).alias("color_space"),
        place[0].alias("place"), F.try_element_at(place, F.lit(2)).try_cast("bigint").alias("data_off"), F.try_element_at(place, F.lit(3)).try_cast("bigint").alias("data_len"),
        name.alias("codec"), codec[0].endswith("+sh").alias("shuffled"), F.try_element_at(codec, F.lit(2)).try_cast("bigint").alias("raw_size"), F.try_element_at(codec, F.lit(3)).try_cast("int").alias("shuffle_size"),
        F.coalesce("i._subblocks", F.lit("")).alias("subblocks"), F.coalesce("i.Data.content_", "i.content_").alias("text"), F.coalesce("i.Data._encoding", F.when(place[0] == "inline", F.try_element_at(place, F.lit(2)))).alias("encoding"), "content", "error",
    )
    out = out.withColumn("error", _reason())
    return out.withColumn("supported", F.col("error").isNull())


def _reason() -> Column:
    """Why an image of the list can't be read."""
    name = F.col("codec")
    return (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.size("naxes") == 0, "no image in this file")
        .when((F.size("naxes") < 2) | F.exists("naxes", lambda x: x.isNull() | (x < 1)), "the image's geometry is not valid")
        .when(F.col("item").isNull(), "the sample format is not supported")
        .when(~name.isin("", "zlib", "lz4", "lz4hc", "zstd"), F.concat(F.lit("compression "), name, F.lit(" is not supported")))
        .when(~F.col("place").isin("attachment", "embedded", "inline"), "the image's place is not supported")
    )


def properties(files: DataFrame) -> DataFrame:
    """Cards of the images: FITS keywords, properties, colour filter and attributes: path, hdu, seq, kind, key, value, comment."""
    rows = _parsed(files).where("error is null").select("path", F.posexplode("doc.Image").alias("hdu", "i"))
    card = lambda k, v, c: F.struct(k.alias("key"), F.substring(F.coalesce(v, F.lit("")), 1, 1 << 20).alias("value"), F.coalesce(c, F.lit("")).alias("comment"))
    words = F.transform(F.coalesce("i.FITSKeyword", F.array()), lambda x: card(x["_name"], F.trim(F.regexp_replace(x["_value"], "^'|'$", "")), x["_comment"]))
    props = F.transform(F.coalesce("i.Property", F.array()), lambda x: card(x["_id"], F.coalesce(x["_value"], x["content_"]), x["_type"]))
    cfa = F.when(F.col("i.ColorFilterArray._pattern").isNotNull(), F.array(card(F.lit("BAYERPAT"), F.col("i.ColorFilterArray._pattern"), F.lit("")))).otherwise(F.array())
    attrs = F.array(*(card(F.lit(a), F.col(f"i._{a}"), F.lit("")) for a in _ATTRS))
    attrs = F.filter(attrs, lambda x: x["value"] != "")
    return rows.select("path", "hdu", F.posexplode(F.concat(words, props, cfa, attrs)).alias("seq", "c")).select("path", "hdu", "seq", F.lit("v").alias("kind"), "c.key", "c.value", "c.comment")


def frames(image_list: DataFrame) -> DataFrame:
    """The frames that hold the samples of images: subblocks, whose places are running sums, the one compressed block, or pieces.

    Samples within the header come as ``bytes``; others are attached (``bytes`` null, ``at`` in the file).
    """
    own = image_list.where("supported").withColumn("block", F.col("hdu"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\\s", "")
    own = own.withColumn("inner", F.when(F.col("place") != "attachment", F.coalesce(F.when(F.col("encoding") == "hex", F.try_to_binary(text, F.lit("hex"))).otherwise(F.try_to_binary(text, F.lit("base64"))), F.lit(b""))))
    # Places and sizes of a damaged header may be any numbers; those that are used lie in the file, or fail frame by frame.
    size = F.octet_length("content").cast("long")
    bounded = lambda c, most: F.greatest(F.lit(0).cast("long"), F.least(F.coalesce(c, F.lit(0)).cast("long"), most))
    at0 = bounded(F.col("data_off"), size)
    own = own.withColumns({"at0": F.when(F.col("inner").isNull(), at0).otherwise(0), "length": F.when(F.col("inner").isNull(), bounded(F.col("data_len"), size - at0)).otherwise(F.octet_length("inner").cast("long"))})
    columns = ["path", "block", "frame", "pos", "raw", "at", "stored", "comp", "inner"]
    whole = S.even_frames(own.where("codec = ''"), F.col("at0"), F.col("length").cast("long")).select(*columns)
    listed = F.filter(F.split("subblocks", ":"), lambda x: x != "")
    two = F.transform(listed, lambda x: F.struct(F.get(F.split(x, ","), 0).try_cast("bigint").alias("stored"), F.get(F.split(x, ","), 1).try_cast("bigint").alias("raw")))
    packed = own.where("codec <> ''").withColumn("parts", F.when(F.size(listed) > 0, two).otherwise(F.array(F.struct(F.col("length").cast("bigint").alias("stored"), F.col("raw_size").alias("raw")))))
    packed = packed.select("*", F.posexplode("parts").alias("frame", "f")).select("*", bounded(F.col("f.stored"), F.lit(1 << 40)).alias("stored"), bounded(F.col("f.raw"), F.lit(1 << 40)).alias("raw"))
    packed = running(running(packed, ["path", "block"], "frame", "raw", "pos"), ["path", "block"], "frame", "stored", "before")
    # A subblock that did not get smaller is stored as it is.
    packed = packed.withColumns({"at": F.col("at0") + F.col("before"), "comp": F.when(F.col("stored") == F.col("raw"), "").otherwise(F.col("codec"))}).select(*columns)
    return whole.unionByName(packed)


def chunks(image_list: DataFrame, plane: int | None = None) -> DataFrame:
    """What bytes of their samples rows of supported images lie in; see ``stored``."""
    axes = lambda k: F.coalesce(F.get("naxes", k), F.lit(1)).cast("long")
    own = image_list.where("supported").withColumns({"width": axes(0), "height": axes(1), "n": axes(2)})
    # Sizes that no file can have are refused before anything is counted out.
    own = own.where((F.col("width") < 1 << 31) & (F.col("height") < 1 << 31) & (F.col("n") < 1 << 20) & (F.col("width").cast("double") * F.col("height") * F.col("n") < 1 << 40))
    packed = F.col("storage") == "Normal"
    item = F.col("item").cast("long")
    units = own.select(
        "path", F.col("hdu").alias("block"), "hdu", F.concat(F.when(F.col("byte_order") == "big", ">").otherwise("<"), F.when(F.col("dtype").contains("float"), "f").otherwise("u"), F.col("item").cast("string")).alias("kind"),
        item.alias("item"), F.when(F.col("shuffled") & (F.coalesce("shuffle_size", "item") == F.col("item")) & (item > 1), F.col("item")).otherwise(1).alias("parts"), (F.col("width") * F.col("height") * F.col("n")).alias("count"),
        F.lit(0).cast("long").alias("origin"), F.array("n").alias("lead"), F.array(F.when(packed, item).otherwise(F.col("width") * F.col("height") * item)).alias("lead_steps"), "height", "width",
        (F.col("width") * item * F.when(packed, F.col("n")).otherwise(1)).alias("sy"), (item * F.when(packed, F.col("n")).otherwise(1)).alias("sx"), F.lit(plane).cast("long").alias("plane"),
    )
    return S.chunked(units)


def pixels(image_list: DataFrame, plane: int | None = None) -> DataFrame:
    """Rows of pixels of supported images, of all planes or one: path, hdu, plane, y, values, truncated, error.

    Subblocks are decoded apart, each once, and only those that hold a byte of what is asked for; a byte shuffle is undone where rows
    are put together from the pieces of several subblocks.  An image of which the file holds under a thousandth has one row with ``error``.
    """
    own = image_list.where("supported").withColumn("have", F.when(F.col("place") == "attachment", F.octet_length("content")).otherwise(F.octet_length("text")).cast("double"))
    own = own.withColumn("need", F.aggregate("naxes", F.lit(1.0), lambda a, x: a * x) * F.col("item"))
    empty = F.col("need") > 1000 * F.greatest(F.col("have"), F.lit(4096.0))
    held = F.col("place") == "attachment"
    good = own.where(~empty)
    listed = frames(good)
    stored = F.substring("content", (F.col("at") + 1).cast("int"), F.least("stored", F.lit(S.MOST_RAW)).cast("int"))
    rows = good.select("path", F.col("hdu").alias("block"), F.when(held, F.col("content")).alias("content"))
    listed = listed.join(rows, ["path", "block"]).withColumn("bytes", F.when(F.col("content").isNotNull(), stored).otherwise(F.substring("inner", (F.col("at") + 1).cast("int"), F.col("stored").cast("int")))).drop("content", "inner")
    out = S.pixels(chunks(good, plane), listed)
    zero = F.lit(0).cast("long")
    lost = own.where(empty).select("path", "hdu", zero.alias("plane"), zero.alias("y"), F.lit(None).cast("array<double>").alias("values"), F.lit(True).alias("truncated"), F.lit("the file holds next to nothing of the image").alias("error"))
    return out.unionByName(lost)
