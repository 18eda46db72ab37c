"""Joins of ranges, order statistics by digits, planned and pruned reads, and files damaged in every part."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from starframe.operators import ranges, stats
from starframe.sources import asdf, files, fits, planned, stored, tiles, xisf
from tests import fixtures
from tests.test_sources import contents, cube

RNG = np.random.default_rng(21)


def test_overlap_join_equals_all_pairs(spark):
    side = lambda n, most: [(int(k), int(a), int(a + w)) for k, a, w in zip(RNG.integers(0, 3, n), RNG.integers(-500, 500, n), RNG.integers(0, most, n), strict=True)]
    left, right = side(80, 300), side(80, 40)
    l, r = spark.createDataFrame(left, "k int, a long, b long"), spark.createDataFrame([*right, (1, None, 5)], "k int, c long, d long")
    got = sorted(tuple(x) for x in ranges.overlap_join(l, r, ["k"], ("a", "b"), ("c", "d"), 64).collect())
    assert got == sorted((k, a, b, c, d) for k, a, b in left for j, c, d in right if k == j and a < b and c < d and a < d and c < b)


def test_order_key_keeps_the_order(spark):
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.2250738585072009e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 2.0**1023, 2.0**-1022]
    values += [float(s * 2.0**e * m) for s in (1, -1) for e in range(-1070, 1020, 37) for m in (1, np.nextafter(2, 0), 1.5)]
    keys = [r.k for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(stats.order_key(F.col("v")).alias("k")).collect()]
    bits = np.array(values).view(np.int64)
    assert keys == [int(b) if b >= 0 else -int(b & 0x7FFFFFFFFFFFFFFF) for b in bits]


def test_order_statistics_of_heavy_tails(spark):
    """Values over 300 orders of magnitude, one far outlier, ties and few values: no window sees the values themselves."""
    groups = {"log": 10 ** RNG.uniform(-150, 150, 4000), "far": np.append(RNG.normal(0, 1, 3000), 1e300), "ties": RNG.integers(-2, 3, 3000).astype(float), "one": np.array([-7.5]), "signs": RNG.normal(0, 1, 2001) * 10 ** RNG.uniform(-30, 30, 2001)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("log", None), ("far", float("nan")), ("ties", float("inf")), (None, 4.0)]
    ranks = {"p1": stats.nearest_rank(0.01), "med": stats.middle, "last": lambda n: n - 1}
    got = {r.g: r for r in stats.order_stats(spark.createDataFrame(rows, "g string, v double"), "v", ranks, ["g"], sort_up_to=0).collect()}
    for g, vs in groups.items():
        own, n = np.sort(vs), len(vs)
        assert (got[g].n, got[g].vmin, got[g].p1, got[g].med, got[g]["last"]) == (n, own[0], own[int(np.floor(0.01 * (n - 1) + 0.5))], own[n // 2], own[-1])
    assert got[None].med == 4.0


def test_only_the_frames_of_a_plane_are_wanted(spark):
    data = RNG.normal(0, 1, (5, 20, 30)).astype("f4")
    df = contents(spark, f=fixtures.asdf({"a": {"values": data, "comp": "lz4"}}))
    chunks, frames = asdf.chunks(asdf.arrays(df), plane=3), asdf.frames(df)
    assert [r.pos for r in frames.orderBy("frame").collect()] == list(range(0, 12_000, 1000))
    got = stored.wanted(chunks, frames).collect()
    assert sorted(r.frame for r in got) == [7, 8, 9]  # plane 3 has the bytes 7200 to 9599
    assert (cube(stored.pixels(chunks, frames, df).collect()) == data[3]).all()


def test_asdf_by_path_and_transposed(spark, tmp_path):
    """Without ``content`` tasks read ranges of the file; strides in any order, and two arrays of one block."""
    data = np.arange(600, dtype="i4")
    whole = fixtures.asdf({"a": {"values": data, "shape": [3, 20, 10], "strides": [800, 4, 80]}, "b": {"values": data, "shape": [30, 20], "strides": [-80, 4], "offset": 2320, "comp": "zlib"}})
    path = tmp_path / "a.asdf"
    path.write_bytes(whole)
    rows = asdf.pixels(spark.createDataFrame([(str(path), "asdf")], "path string, format string")).collect()
    assert (cube(rows, hdu=0).reshape(3, 20, 10) == data.reshape(3, 10, 20).transpose(0, 2, 1)).all()
    assert (cube(rows, hdu=1) == data.reshape(30, 20)[::-1]).all()


def test_xisf_subblocks_of_one_plane(spark):
    values = RNG.normal(0, 1, (2, 9, 7)).astype("f4")
    df = contents(spark, f=fixtures.xisf([{"values": values, "codec": "zstd", "shuffled": True, "blocks": 5}]), n=fixtures.xisf([{"values": values, "codec": "zlib", "shuffled": True, "normal": True, "big": True}]))
    rows = xisf.pixels(xisf.images(df), plane=1).collect()
    for name in "fn":
        assert (cube([r for r in rows if r.path == name]) == values[1]).all()


def damaged(whole: bytes, n: int, first: int = 0) -> list[bytes]:
    """Copies with bytes changed from a place on, and cut now and then."""
    out = []
    for _ in range(n):
        raw = bytearray(whole)
        for at in RNG.integers(first, len(raw), RNG.integers(1, 12)):
            raw[at] = RNG.integers(0, 256)
        out.append(bytes(raw[: int(RNG.integers(max(first, len(raw) // 2), len(raw) + 1))] if RNG.random() < 0.3 else raw))
    return out


def test_damage_in_data_of_asdf_and_xisf_fails_no_job(spark):
    a = np.arange(540, dtype="f4").reshape(2, 27, 10)
    made, zeros = {}, np.zeros((1, 24, 16), "u2")
    for comp in ("lz4", "zlib", "bzp2", ""):
        whole = fixtures.asdf({"a": {"values": a, "comp": comp}})
        made |= {f"a{comp}{k}": x for k, x in enumerate(damaged(whole, 12) + damaged(whole, 12, whole.index(b"\xd3BLK")))}
    for codec in ("zlib", "lz4", "zstd", None):
        whole = fixtures.xisf([{"values": zeros + RNG.integers(0, 9, (1, 24, 16)).astype("u2"), "codec": codec, "shuffled": bool(codec), "blocks": 3 if codec else 1}])
        made |= {f"x{codec}{k}": x for k, x in enumerate(damaged(whole, 12, 16) + damaged(whole, 12, 4096))}
    made["x_huge"] = fixtures.xisf([{"values": zeros}]).replace(b'geometry="16:24:1"', b'geometry="99999:9999999:9"').ljust(5000, b"\0")
    df = contents(spark, **made)
    got = asdf.pixels(df).groupBy("path").agg(F.count("*").alias("n"), F.max("error").alias("error")).collect()
    assert len(got) > 30 and sum(r.error is not None for r in got) > 5 and all(r.n == 54 for r in got if r.error is None)
    seen = {r.path: r for r in xisf.pixels(xisf.images(df)).groupBy("path").agg(F.count("*").alias("n"), F.max("error").alias("error")).collect()}
    assert len(seen) > 30 and sum(r.error is not None for r in seen.values()) > 5
    assert "x_huge" not in seen or seen["x_huge"].error


def test_damage_in_tiles_fails_no_job(spark, tmp_path):
    image = RNG.integers(-99, 99, (20, 30)).astype("i4")
    whole = fixtures.gzip_tiles(image, "GZIP_2", (13, 7))
    paths = []
    for k, raw in enumerate([*damaged(whole, 40, 2880), *damaged(whole, 30, whole.rindex(b"END ") + 2000), whole.replace(b"ZTILE1  =                   13", b"ZTILE1  =                    0"), whole.replace(b"ZTILE1  =                   13", b"ZTILE1  =           9999999999")]):
        paths.append(tmp_path / f"{k}.fits")
        paths[-1].write_bytes(raw)
    listed = files.scan_hdus(spark.createDataFrame([(str(p), "fits") for p in paths], "path string, format string"))
    rows = tiles.decode_tiles(listed).groupBy("path").agg(F.max("error").alias("error"), F.count("*").alias("n")).collect()
    by = {r.path: r for r in rows}
    assert len(by) > 30 and sum(r.error is not None for r in rows) > 10
    assert "sizes of tiles" in by[str(paths[-2])].error
    gone = listed.where("hdu = 1").limit(3).withColumn("hdu", F.lit(7))
    assert {r.error for r in tiles.decode_tiles(gone).collect()} == {"the file has no unit 7 any more"}


@pytest.mark.parametrize("shape", [(2, 3, 20, 30), (5, 9)])
def test_tiles_chosen_by_the_grid(spark, tmp_path, shape):
    """Tiles are chosen before decoding, and the lines are those that a filter after decoding leaves."""
    h, w = shape[-2:]
    planes = int(np.prod(shape[:-2]))
    size = [8, 6, 2, 1][: len(shape)]
    axes = list(reversed(shape))
    counts = [-(-a // s) for a, s in zip(axes, size, strict=True)]
    n = int(np.prod(counts))
    keys = [("ZIMAGE", True), ("ZCMPTYPE", "NOCOMPRESS"), ("ZBITPIX", 16), ("ZNAXIS", len(axes)), *((f"ZNAXIS{k + 1}", a) for k, a in enumerate(axes)), *((f"ZTILE{k + 1}", s) for k, s in enumerate(size))]
    path = tmp_path / "t.fits"
    path.write_bytes(fits.table_bytes([("UNCOMPRESSED_DATA", "1PI", np.zeros((n, 2), np.int32))], [fits.card(k, v) for k, v in keys], "COMPRESSED"))
    units = files.scan_hdus(spark.createDataFrame([(str(path), "fits")], "path string, format string"))
    every = tiles.decode_tiles(units).select("tile", "plane", "y", "x0").collect()
    assert len({(r.plane, r.y, r.x0) for r in every}) == planes * h * counts[0] == len(every)
    wanted = [0, planes - 1]
    got = tiles.decode_tiles(units, planes=wanted, y=(4, 7), x=(7, 9)).select("tile", "plane", "y", "x0").collect()
    assert sorted(got) == sorted(r for r in every if r.plane in wanted and 4 <= r.y < 7 and r.x0 < 9 and r.x0 + 8 > 7)


def test_planned_reads(spark, tmp_path):
    image = RNG.normal(0, 1, (3, 40, 25)).astype("f4")
    table = fits.table_bytes([("a", "J", np.arange(900, dtype="i4")), ("s", "4A", np.array([b"abcd"] * 900, "S4"))], name="T")
    for name, raw in (("i", fits.image_bytes(image)), ("cut", fits.image_bytes(image)[:8000]), ("t", table), ("short", table[:9000])):
        (tmp_path / f"{name}.fits").write_bytes(raw)
    index = str(tmp_path / "index")
    files.scan_hdus(spark.createDataFrame([(str(p), "fits") for p in sorted(tmp_path.glob("*.fits"))], "path string, format string")).write.parquet(index)
    units = spark.read.parquet(index)
    (tmp_path / "gone.fits").write_bytes(b"")
    own = units.where(F.col("path").endswith("/i.fits"))
    rows = planned.image_rows(own, planes=[0, 2, 9], y=(5, 33), every=7, offset=3, range_bytes=300).collect()
    assert {(r.plane, r.y): list(r["values"]) for r in rows} == {(p, y): [float(v) for v in image[p, y]] for p in (0, 2) for y in (10, 17, 24, 31)}
    whole = planned.image_rows(units.where("hdu = 0 and size(naxes) > 0"), range_bytes=2000).collect()
    assert (cube([r for r in whole if r.path.endswith("/i.fits")]).reshape(image.shape) == image).all()
    cut = [r for r in whole if r.path.endswith("cut.fits")]
    assert len(cut) == 120 and any(r.truncated for r in cut) and np.isnan(cut[-1]["values"]).sum() >= 0
    got = planned.table_rows(units.where("hdu = 1"), "a int, s string", first=100, last=700, range_bytes=700).collect()
    assert sorted(r.a for r in got if r.path.endswith("/t.fits")) == list(range(100, 700)) and {r.s for r in got if r.error is None} == {"abcd"}
    assert "the file ends before its rows" in {r.error for r in got if r.path.endswith("short.fits")}
    wrong = planned.table_rows(units.where("hdu = 1"), "a double").collect()
    assert wrong and all(r.error == "no column a of that type" for r in wrong)
    lost = planned.table_rows(own.withColumns({"path": F.lit(str(tmp_path / "nowhere.fits")), "tfields": F.lit(2).cast("bigint"), "rowlen": F.lit(8).cast("bigint"), "n_rows": F.lit(9).cast("bigint")}), "a int").collect()
    assert [bool(r.error) for r in lost] == [True]


def test_gzipped_files_of_every_format(spark):
    values = RNG.normal(0, 1, (1, 9, 7)).astype("f4")
    x, a = fixtures.xisf([{"values": values}]), fixtures.asdf({"a": {"values": values[0]}})
    made = {"x": gzip.compress(x), "a": gzip.compress(a), "plain": a, "cut": gzip.compress(a)[:-30], "bomb": gzip.compress(b"#ASDF" + b"\0" * 10_000_000)}
    df = files.unzipped(contents(spark, **made), most=100_000)
    got = {r.path: (r.format, r.error) for r in df.collect()}
    assert got["x"] == ("xisf", None) and got["a"] == ("asdf", None) and got["plain"] == ("asdf", None) and got["cut"][1] and got["bomb"][1]
    assert (cube(xisf.pixels(xisf.images(df.where("path = 'x'"))).collect()) == values[0]).all()
    assert (cube(asdf.pixels(df.where("path = 'a'")).collect()) == values[0]).all()


def test_images_of_which_nothing_is_there_are_flagged(spark):
    raw = fits.image_bytes(np.zeros((4, 5), "i2")).replace(b"NAXIS1  =                    5", b"NAXIS1  =           2000000000")
    rows = files.image_rows(contents(spark, f=raw)).collect()
    assert len(rows) == 1 and rows[0]["values"] is None and rows[0].truncated


def test_cells_that_say_too_much_are_null(monkeypatch):
    monkeypatch.setattr(fits, "MOST_CELL", 4)
    raw = np.frombuffer(np.array([[3, 0], [5, 0], [2, -1], [0, 0]], ">i4").tobytes(), np.uint8).reshape(4, 8)
    c = {"ascii": False, "type": "P", "element": "B", "byte_offset": 0, "width": 8, "repeat": 1}
    assert fits.cells(raw, c, lambda at, n: bytes(range(at, at + n))) == [[0, 1, 2], None, None, []]
