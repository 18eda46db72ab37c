"""Files of every kind, written by the fixtures and read back; damaged ones give flags and never fail a job."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from starframe.operators import catalog, headers, images, tables
from starframe.sources import asdf, files, fits, fits_sources, tiles, xisf
from starframe import sinks
from tests import fixtures

RNG = np.random.default_rng(42)


def contents(spark, **named):
    return files.from_content(spark.createDataFrame([(k, v) for k, v in named.items()], "path string, content binary"))


def cube(rows, path=None, hdu=None):
    own = sorted((r for r in rows if path in (None, r.path) and hdu in (None, r.hdu)), key=lambda r: (r.plane, r.y))
    return np.array([r["values"] for r in own])


def test_kinds_by_magic(spark):
    got = {r.path: (r.format, r.error) for r in contents(spark, f=fits.image_bytes(np.zeros((2, 2), "f4")), x=fixtures.xisf([{"values": np.zeros((1, 2, 2), "u1")}]), a=fixtures.asdf({}), g=gzip.compress(b"SIMPLE  =" * 9), n=b"not a picture at all", s=b"tiny").collect()}
    assert {k: v[0] for k, v in got.items()} == {"f": "fits", "x": "xisf", "a": "asdf", "g": "gzip", "n": None, "s": None}
    assert got["n"][1] and got["s"][1] == "too short" and got["f"][1] is None


@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "i8", "f4", "f8"])
def test_image_types(spark, tmp_path, kind):
    data = (RNG.normal(0, 100, (7, 11)) if kind[0] == "f" else RNG.integers(0, 100, (7, 11))).astype(kind)
    (tmp_path / "a.fits").write_bytes(fits.image_bytes(data))
    (tmp_path / "b.fits.gz").write_bytes(gzip.compress(fits.image_bytes(data)))
    rows = fits_sources.read_image(spark, str(tmp_path)).collect()
    for name in ("a.fits", "b.fits.gz"):
        assert (cube(rows, str(tmp_path / name)) == data).all()


def test_image_scaling_blank_planes_and_pushdown(spark, tmp_path):
    data = RNG.integers(-50, 50, (3, 20, 5)).astype("i2")
    path = tmp_path / "c.fits"
    path.write_bytes(fits.image_bytes(data, more=[fits.card("BSCALE", 0.25), fits.card("BZERO", 1000.0), fits.card("BLANK", 7)]))
    want = np.where(data == 7, np.nan, data * 0.25 + 1000)
    df = fits_sources.read_image(spark, str(path))
    assert np.array_equal(cube(df.collect()).reshape(3, 20, 5), want, equal_nan=True)
    part = df.where("plane = 1 AND y >= 4 AND y < 9")
    assert np.array_equal(cube(part.collect()), want[1, 4:9], equal_nan=True)
    assert np.array_equal(cube(images.select_plane(df, planes=3).collect()), want[1], equal_nan=True)


def test_truncated_image_is_flagged(spark, tmp_path):
    data = np.arange(200, dtype="f4").reshape(10, 20)
    raw = fits.image_bytes(data)[: 2880 + 4 * 110]
    (tmp_path / "t.fits").write_bytes(raw)
    rows = sorted(fits_sources.read_image(spark, str(tmp_path / "t.fits")).collect(), key=lambda r: r.y)
    assert len(rows) == 10 and [r.truncated for r in rows] == [False] * 5 + [True] * 5
    assert (np.array(rows[4]["values"]) == data[4]).all() and np.isnan(rows[9]["values"]).all() and rows[5]["values"][9] == 109
    memory = sorted(files.image_rows(contents(spark, t=raw)).collect(), key=lambda r: r.y)
    assert np.array_equal(cube(memory), cube(rows), equal_nan=True)


def mixed():
    heap = np.array([1, 2, 3, 4, 5], ">f4").tobytes()
    return fits.table_bytes(
        [
            ("NAME", "6A", np.array(["ab", "c d", ""], "S6")), ("FLAG", "L", np.frombuffer(b"TF\0", "S1")), ("BITS", "11X", np.array([[1, 2], [3, 4], [5, 6]], "u1")), ("SMALL", "B", np.array([1, 200, 255], "u1")),
            ("SHORT", "I", np.array([-1, 5, 6], "i2")), ("BIG", "K", np.array([1, 2, 2**40], "i8")), ("VEC", "3E", np.arange(9, dtype="f4").reshape(3, 3)), ("Z", "C", np.array([1 + 2j, 0, 3], "c8").view("f4").reshape(3, 2)),
            ("VLA", "PE(3)", np.array([[2, 0], [0, 0], [3, 8]], "i4")), ("RATE", "J", np.array([10, -999, 30], "i4")),
        ],
        [fits.card("TNULL5", -1), fits.card("TSCAL10", 0.001), fits.card("TZERO10", 14.0), fits.card("TNULL10", -999)], "MIXED", heap,
    )


def test_table_cells(spark, tmp_path):
    (tmp_path / "m.fits").write_bytes(mixed())
    got = sorted(fits_sources.read_table(spark, str(tmp_path / "m.fits")).collect(), key=lambda r: r._row)
    assert [r.NAME for r in got] == ["ab", "c d", ""] and [r.FLAG for r in got] == [True, False, None] and [r.SMALL for r in got] == [1, 200, 255]
    assert [r.SHORT for r in got] == [None, 5, 6] and got[2].BIG == 2**40 and got[1].VEC == [3, 4, 5] and (got[0].Z.re, got[0].Z.im) == (1, 2)
    assert [r.VLA for r in got] == [[1, 2], [], [3, 4, 5]] and bytes(got[1].BITS) == b"\3\4"
    assert got[1].RATE is None and [round(r.RATE, 6) for r in (got[0], got[2])] == [14.01, 14.03]
    few = fits_sources.read_table(spark, str(tmp_path / "m.fits"), columns=["BIG"])
    assert few.columns == ["path", "hdu", "_row", "BIG"]
    assert [r.BIG for r in tables.rows_between(few, 1, 5).orderBy("_row").collect()] == [2, 2**40] and tables.head(few, 1).count() == 1


def test_table_partitions_and_windows(spark, tmp_path):
    n = 5000
    (tmp_path / "b.fits").write_bytes(fits.table_bytes([("ID", "K", np.arange(n)), ("RA", "D", RNG.uniform(0, 360, n))]))
    df = spark.read.format("fits_table").option("partitionBytes", 16 * 700).load(str(tmp_path / "b.fits")) if fits_sources.register(spark) is None else None
    assert df.rdd.getNumPartitions() == 8 and df.agg(F.sum("ID")).first()[0] == n * (n - 1) // 2
    assert fits_sources.read_table(spark, str(tmp_path / "b.fits"), windows=True).count() == n


def test_ascii_table(spark, tmp_path):
    lines = ["    12  1.5D+01 first   ", "   -3           second  "]
    unit = [fits.card("XTENSION", "TABLE"), fits.card("BITPIX", 8), fits.card("NAXIS", 2), fits.card("NAXIS1", 24), fits.card("NAXIS2", 2), fits.card("PCOUNT", 0), fits.card("GCOUNT", 1), fits.card("TFIELDS", 3)]
    for k, (name, form, col) in enumerate([("ID", "I6", 1), ("RA", "D9.1", 7), ("NOTE", "A8", 17)], 1):
        unit += [fits.card(f"TTYPE{k}", name), fits.card(f"TFORM{k}", form), fits.card(f"TBCOL{k}", col)]
    raw = fits.header([fits.card("SIMPLE", True), fits.card("BITPIX", 8), fits.card("NAXIS", 0)]) + fits.header(unit) + fits.padded("".join(lines).encode())
    (tmp_path / "a.fits").write_bytes(raw)
    got = sorted(fits_sources.read_table(spark, str(tmp_path / "a.fits")).collect(), key=lambda r: r._row)
    assert [(r.ID, r.RA, r.NOTE) for r in got] == [(12, 15.0, "first"), (-3, None, "second")]
    cols = [{"name": "ID", "type": "I", "byte_offset": 0, "width": 6}, {"name": "RA", "type": "D", "byte_offset": 6, "width": 9}]
    assert [tuple(r) for r in tables.ascii_fields(spark.createDataFrame([(x,) for x in lines], "line string"), cols).collect()] == [(12, 15.0), (-3, None)]


def test_hdus_cards_axes_and_listing(spark):
    image = fits.image_bytes(np.zeros((4, 5), "i2"), more=[fits.card("BZERO", 32768), fits.card("ROWORDER", "TOP-DOWN"), b"HIERARCH ESO DET ID = 'it''s' / note".ljust(80), b"COMMENT   two words".ljust(80)])
    sky = fits.table_bytes([("ra", "D", np.zeros(3)), ("dec", "D", np.zeros(3))], name="SKY")
    df = contents(spark, one=image, two=sky, bad=b"XSIMPLE = nothing here at all")
    units = files.scan_hdus(files.from_content(df.where("path <> 'bad'")))
    cards = files.scan_cards(units)
    assert headers.keyword(cards, "ESO DET ID").first().value == "it's" and headers.search(cards, "TWO words").first().value == "  two words"
    axes = tables.pick_axes(tables.describe_columns(cards)).collect()
    assert [(r.path, r.x, r.y, r.kind, r.sky) for r in axes] == [("two", "ra", "dec", "sky", True)]
    own = units.join(spark.createDataFrame(axes).select("path", "hdu", "kind", "sky"), ["path", "hdu"], "left").withColumn("dtype", F.lit(None).cast("string")).withColumn("preferred", F.lit(False))
    assert {(r.path, r.hdu, r.unit, r.element) for r in catalog.listing(own).collect()} == {("one", 0, "image", "uint16"), ("two", 1, "plot", None)}
    assert {(r.path, r.hdu, r.is_table, r.is_sky) for r in catalog.select_hdu(own).collect()} == {("one", 0, False, False), ("two", 1, True, True)}
    order = catalog.row_order(own.join(headers.keywords(cards, ["ROWORDER"]), ["path", "hdu"])).where("path = 'one'").first()
    assert order.flip is False


@pytest.mark.parametrize(("kind", "dtype", "tile"), [("GZIP_1", "i2", None), ("GZIP_2", "i4", (13, 7)), ("GZIP_2", "f4", None), ("GZIP_1", "f4", (16, 16))])
def test_tiles(spark, tmp_path, kind, dtype, tile):
    data = (RNG.normal(0, 9, (20, 30)) if dtype == "f4" else RNG.integers(-99, 99, (20, 30))).astype(dtype)
    path = tmp_path / "t.fits"
    path.write_bytes(fixtures.gzip_tiles(data, kind, tile))
    listed = spark.createDataFrame([(str(path), "fits")], "path string, format string")
    rows = tiles.assemble(tiles.decode_tiles(files.scan_hdus(listed))).collect()
    assert np.allclose(cube(rows), data) and not any(r.truncated for r in rows)


def test_unsupported_tiles_are_flagged(spark, tmp_path):
    path = tmp_path / "r.fits"
    path.write_bytes(fixtures.gzip_tiles(np.zeros((3, 4), "i4")).replace(b"'GZIP_1  '", b"'RICE_1  '"))
    rows = tiles.decode_tiles(files.scan_hdus(spark.createDataFrame([(str(path), "fits")], "path string, format string"))).collect()
    assert len(rows) == 3 and all("RICE_1" in r.error and np.isnan(r["values"]).all() for r in rows)


def test_dither_follows_the_sequence():
    table = tiles.dither_table()
    for seed in (0, 17, 9999):
        s, at, want = seed, int(table[seed] * 500), []
        for _ in range(25_000):
            want.append(at)
            at += 1
            if at == 10_000:
                s = (s + 1) % 10_000
                at = int(table[s] * 500)
        assert tiles.dither_index(seed, 25_000).tolist() == want
    raw = np.array([5, -2147483646, -9], "i4")
    out = tiles.dequantize(raw, 2.0, 1.0, "SUBTRACTIVE_DITHER_2", blank=-9)
    assert out[1] == 0 and np.isnan(out[2]) and abs(out[0] - 11) <= 1


XISF = [{}, {"codec": "zlib"}, {"codec": "lz4", "shuffled": True}, {"codec": "zstd", "shuffled": True, "blocks": 3}, {"big": True}, {"normal": True}, {"embedded": "base64"}, {"embedded": "hex"}]


@pytest.mark.parametrize("options", XISF)
def test_xisf(spark, options):
    values = RNG.integers(0, 60_000, (3, 8, 10)).astype("u2")
    raw = fixtures.xisf([{"values": values, "more": '<FITSKeyword name="OBJECT" value="\'M 31\'" comment="what"/><Property id="A:b" type="Int32" value="7"/>', **options}, {"values": values[:1].astype("f4"), "id": "second"}])
    df = contents(spark, f=raw)
    listed = xisf.images(df)
    assert [(r.hdu, r.extname, r.naxes, r.error) for r in listed.orderBy("hdu").collect()] == [(0, "main", [10, 8, 3], None), (1, "second", [10, 8, 1], None)]
    rows = xisf.pixels(listed).collect()
    assert (cube(rows, hdu=0).reshape(3, 8, 10) == values).all() and (cube(rows, hdu=1) == values[0]).all()
    words = {r.key: r.value for r in xisf.properties(df).where("hdu = 0").collect()}
    assert words["OBJECT"] == "M 31" and words["A:b"] == "7" and words["geometry"] == "10:8:3"


def test_bad_xisf(spark):
    good = fixtures.xisf([{"values": np.zeros((1, 4, 4), "u1")}])
    df = contents(spark, short=good[:60], dtd=good.replace(b"<xisf", b"<!DOCTYPE x><xisf"), codec=fixtures.xisf([{"values": np.zeros((1, 4, 4), "u1"), "codec": "rle"}]), cut=good[:-5])
    got = {r.path: r.error for r in xisf.images(df).collect()}
    assert got["short"] and got["dtd"] and "rle" in got["codec"] and got["cut"] is None
    assert xisf.pixels(xisf.images(df)).where("path = 'cut'").first().error


@pytest.mark.parametrize("comp", ["", "zlib", "bzp2", "lz4"])
def test_asdf(spark, comp):
    data = RNG.normal(0, 1, (2, 9, 6)).astype("f4")
    raw = fixtures.asdf({"data": {"values": data, "comp": comp, "big": True}, "flipped": {"values": np.arange(20, dtype="i4"), "shape": [5, 4], "strides": [-16, 4], "offset": 64}}, "meta: {telescope: ROMAN, n: [1, 2]}\n")
    df = contents(spark, f=raw)
    listed = asdf.arrays(df)
    got = {r.extname: r for r in listed.collect()}
    assert got["data"].naxes == [6, 9, 2] and got["data"].preferred and not got["flipped"].preferred and got["data"].error is None
    rows = asdf.pixels(df).collect()
    assert (cube(rows, hdu=0).reshape(2, 9, 6) == data).all()
    assert (cube(rows, hdu=1) == np.arange(20).reshape(5, 4)[::-1]).all()
    assert asdf.pixels(df, plane=1).where("hdu = 0").count() == 9
    lines = {r.key_path: (r.value, r.tag) for r in asdf.tree(df).collect()}
    assert lines["meta.telescope"] == ("ROMAN", "") and lines["data"][1] == "ndarray-1.0.0" and lines["data.shape"][0] == "[2, 9, 6]"
    assert [b.comp for b in asdf.blocks(df).orderBy("block").collect()] == [comp, ""]


def test_asdf_streamed_and_damaged(spark):
    data = np.arange(84, dtype="f8").reshape(12, 7)
    raw = fixtures.asdf({"s": {"values": data, "shape": ["'*'", 7], "streamed": True}})
    whole = fixtures.asdf({"s": {"values": data}})
    df = contents(spark, s=raw, cut=whole[:-9], tree=whole[:50], strides=fixtures.asdf({"s": {"values": data, "strides": [56, 80]}}))
    got = {r.path: (r.naxes, r.error) for r in asdf.arrays(df).collect()}
    assert got["s"] == ([7, 12], None) and "block 0 is missing" in got["cut"][1] and "outside its block" in got["strides"][1] and "tree" not in got
    assert (cube(asdf.pixels(df).where("path = 's'").collect()) == data).all()


def test_mutated_files_never_fail_a_job(spark):
    rng = np.random.default_rng(7)
    seeds = [mixed(), fits.image_bytes(np.zeros((4, 5), "i2")), fixtures.xisf([{"values": np.zeros((1, 4, 4), "u1")}]), fixtures.asdf({"data": {"values": np.zeros((3, 3), "f4")}})]
    rows = []
    for n in range(120):
        raw = bytearray(seeds[n % len(seeds)])
        for at in rng.integers(0, min(len(raw), 6000), rng.integers(1, 30)):
            raw[at] = rng.integers(0, 256)
        rows.append((f"f{n}", bytes(raw[: rng.integers(20, len(raw) + 1)])))
    df = files.from_content(spark.createDataFrame(rows, "path string, content binary"))
    assert files.hdus_of(df).count() > 0 and files.scan_cards(files.scan_hdus(df)).count() > 0


def test_thumbnails_and_sinks(spark, tmp_path):
    import struct
    import zlib

    values = RNG.normal(100, 5, (40, 40))
    values[:5, :5] = np.nan
    values[10::9, 10::9] = 3000  # stars
    pixels = spark.createDataFrame([("p", y, values[y].tolist()) for y in range(40)], "path string, y long, values array<double>")
    cells = images.bin2d(pixels, 2, 20, 20, by=["path"])
    look = images.auto_stretch_of(pixels, 40, 40, ["path"])
    png = bytes(sinks.thumbnails(cells, look, 20, 20, ["path"]).first().png)
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", png[16:24]) == (20, 20) and png[25] == 6
    at = png.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]]), np.uint8).reshape(20, 81)[:, 1:].reshape(20, 20, 4)
    assert (raw[-2:, :2, 3] == 0).all() and abs(int(np.median(raw[raw[:, :, 3] > 0][:, 0])) - 64) <= 16
    sinks.write_rows_tsv(spark.createDataFrame([(1, [1.0, 2.0], bytearray(b"\1\xff"))], "a int, b array<double>, c binary"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().asDict() == {"a": "1", "b": "[1.0,2.0]", "c": "01FF"}
    sinks.write_results(cells, str(tmp_path / "r"), ["path"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 400


def test_damaged_files_fail_no_job(spark):
    """Seeded mutation of headers and data: what can't be read is left out or carries an error."""
    from starframe.sources import files

    rng = np.random.default_rng(11)
    image = fits.image_bytes(np.arange(60, dtype="f4").reshape(6, 10))
    table = fits.table_bytes([("a", "J", np.arange(9, dtype="i4")), ("s", "4A", np.array([b"abcd"] * 9, "S4"))], name="T")
    array = fixtures.asdf({"data": {"values": np.arange(54, dtype="f4").reshape(6, 9)}})
    made = {}
    for n in range(40):
        for name, whole in (("i", image), ("t", table), ("a", array)):
            raw = bytearray(whole)
            for _ in range(int(rng.integers(1, 12))):
                raw[int(rng.integers(0, min(len(raw), 6000 if name == "t" else 800)))] = int(rng.choice([48, 57, 45, 32, 0, 255, int(rng.integers(0, 256))]))
            made[f"{name}{n}"] = bytes(raw[: int(rng.integers(len(raw) // 2, len(raw) + 1))])
    df = contents(spark, **made)
    assert files.scan_hdus(df).count() >= 0 and files.scan_cards(files.scan_hdus(df)).count() > 0
    assert files.table_rows(df, "a int, s string").count() > 0
    assert files.image_rows(df).count() > 0
    assert asdf.arrays(df).count() > 0 and asdf.pixels(df).count() >= 0


@pytest.mark.parametrize("cards", [{"NAXIS": 800000}, {"NAXIS1": -2880}, {"BITPIX": 7}, {"PCOUNT": -5}])
def test_impossible_headers_are_told(spark, cards):
    from starframe.sources import files

    kw = {"BITPIX": 8, "NAXIS": 1, "NAXIS1": 10} | cards
    raw = fits.header([fits.card("SIMPLE", True), *(fits.card(k, v) for k, v in kw.items())])
    got = files.scan_hdus(contents(spark, f=raw + raw)).collect()
    assert len(got) == 1 and got[0].error


def test_images_are_packed_and_read_without_an_object_for_each_value():
    """Rows of an image become one array; of a batch of frames only a few are Python objects at once."""
    import tracemalloc

    import pyarrow as pa

    from starframe import sinks
    from starframe.sources import stored

    values = np.arange(64 * 5000, dtype=np.float32)
    column = pa.chunked_array([pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, 64), pa.int32()), pa.array(values))])
    tracemalloc.start()
    got = sinks._matrix(column)
    assert tracemalloc.get_traced_memory()[1] < 3 * values.nbytes and np.array_equal(got, values.reshape(-1, 64))
    batch = pa.RecordBatch.from_pydict({"k": list(range(200)), "bytes": [bytes(100_000)] * 200})
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    assert [r["k"] for r in stored._each(batch)] == list(range(200))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 5_000_000
    nulls = sinks._matrix(pa.chunked_array([pa.array([[1.0, None], [3.0, 4.0]])]))
    assert np.isnan(nulls[0, 1]) and nulls[1, 1] == 4
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            sinks._matrix(pa.chunked_array([pa.array(bad)]))


def test_codecs_pack_and_parse_files_once(spark, sf):
    """What the query of codecs reads pixels from is stored: its plan neither packs files nor parses their headers again."""
    from starframe.plans.queries import QUERIES

    plan = QUERIES["xisf_codecs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "from_xml" not in plan.lower() and "xmltostructs" not in plan.lower()
