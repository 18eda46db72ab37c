"""Operators beyond the registered queries: metamorphic and small exact tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starframe.functions import scalar as S
from starframe.operators import catalog, headers, images, points, sampling, stats, tables
from starframe.sources import fits

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(g, float(v)) for g in (None, "a", "b") for v in (RNG.normal(0, 1, 2001) if g == "a" else RNG.integers(0, 5, 700))]
    rows += [("a", float("nan")), ("a", float("inf")), ("a", None), ("c", 7.0)]
    return spark.createDataFrame(rows, "g string, v double"), rows


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_order_statistics_are_exact(numbers, monkeypatch, most):
    df, rows = numbers
    monkeypatch.setattr(stats, "SORTED", most)
    got = {r.g: r for r in stats.order_stats(df, "v", {"low": lambda n: F.lit(0), "mid": stats.middle, "p": stats.nearest_rank(0.3)}, ["g"]).collect()}
    for g in (None, "a", "b", "c"):
        v = sorted(x for k, x in rows if k == g and x is not None and np.isfinite(x))
        r = got[g]
        assert (r.n, r.low, r.mid, r.p) == (len(v), v[0], v[len(v) // 2], v[int(0.3 * (len(v) - 1) + 0.5)])


def test_stretch_of_quiet_and_constant_values(spark):
    rows = [("flat", 3.0)] * 50 + [("quiet", 0.0)] * 100 + [("quiet", float(x)) for x in RNG.normal(50, 3, 40)]
    got = {r.g: r for r in stats.auto_stretch(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert (got["flat"].c0, got["flat"].inv, got["flat"].m) == (2.0, 0.5, 0.5)
    assert 45 < got["quiet"].median < 55 and got["quiet"].sigma > 0


def test_envelope_of_wrapped_sky_and_logarithms(spark):
    ra = np.concatenate([RNG.uniform(350, 360, 500), RNG.uniform(0, 10, 500)])
    df = spark.createDataFrame([(float(a), float(d)) for a, d in zip(ra, RNG.uniform(-5, 5, 1000), strict=True)] + [(-999.0, 1.0), (5.0, 99.0)], "ra double, dec double")
    ranges = points.columns_of(points.sky_wrap(points.axis_ranges(df, "ra", "dec", sky=True)), 100)
    r = ranges.first()
    assert r.n == 1000 and r.wrap and -10 <= r.x_min < 0 < r.x_max <= 10
    assert points.envelope(df, "ra", "dec", 100, sky=True).agg(F.sum("n"), F.max("c")).first() == (1000, 99)
    meta = points.plot_axes(ranges, "loglam", "MAG_R", xlog=True).first()
    assert (meta.x_label, meta.x_unit, meta.y_flip) == ("wavelength", "Angstrom", True)
    logs = spark.createDataFrame([(2.0, 1.0), (3.0, 2.0), (400.0, 3.0)], "x double, y double")
    assert points.axis_ranges(logs, "x", "y", xlog=True).first().x_max == pytest.approx(1000)


@pytest.mark.parametrize(("factor", "samples"), [(1, 0), (3, 0), (7, 4), (20, 4)])
def test_bins_equal_numpy(spark, factor, samples):
    a = RNG.normal(0, 1, (45, 61))
    a[RNG.random((45, 61)) < 0.1] = np.nan
    df = spark.createDataFrame([(y, a[y].tolist()) for y in range(45)], "y int, values array<double>")
    h, w = 45 // factor, 61 // factor
    got = np.full((h, w), np.nan)
    for r in images.bin2d(df, factor, w, h, samples).collect():
        got[r.oy, r.ox] = np.nan if r.value is None else r.value
    o = images.offsets(factor, min(samples or factor, factor))
    cells = a[: h * factor, : w * factor].reshape(h, factor, w, factor)[:, o][:, :, :, o]
    with np.errstate(invalid="ignore"):
        want = np.nansum(cells, (1, 3)) / np.isfinite(cells).sum((1, 3))
    assert np.allclose(got, want, equal_nan=True)


def test_part_of_an_image_keeps_its_look(spark):
    a = RNG.normal(100, 9, (40, 40))
    df = spark.createDataFrame([("p", y, a[y].tolist()) for y in range(40)], "path string, y int, values array<double>")
    look = images.auto_stretch_of(df, 40, 40, ["path"])
    whole = {(r.oy, r.ox): r.level for r in images.stretched(images.bin2d(df, 2, 20, 20, by=["path"]), look, ["path"]).collect()}
    x, y, w, h = images.crop_plan(10, 20, 12, 8, 40, 40)
    part = images.crop(df, x, y, w, h).withColumn("y", F.col("y") - y)
    zoomed = images.stretched(images.bin2d(part, 2, w // 2, h // 2, by=["path"]), look, ["path"]).collect()
    assert len(zoomed) == 24 and all(r.level == whole[r.oy + y // 2, r.ox + x // 2] for r in zoomed)
    assert images.crop_plan(-5, 99, 1, 1, 40, 40) == (0, 39, 1, 1) and images.crop_plan(3, 3, 4, 4, 41, 41, True) == (2, 2, 6, 6)


def test_reference_sample_is_bounded(spark):
    a = RNG.normal(0, 1, (300, 900))
    df = spark.createDataFrame([(y, a[y].tolist()) for y in range(300)], "y int, values array<double>")
    n = images.reference_sample(df, 900, 300).count()
    assert 150_000 < n <= 200_000
    assert images.samples_within(100_000, 100_000, 8, 40, 4, 2 << 30) == 1 and images.bin_plan(4096, 4096, 512, 512) == {"factor": 8, "width": 512, "height": 512, "samples": 4}


def test_windows_of_big_tables():
    ranges = sampling.window_sample(2880, 16, 1 << 27)
    assert len(ranges) == 16384 and all(b - a <= 1024 for a, b in ranges) and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:], strict=False))
    assert sampling.window_sample(2880, 16, 1 << 27) == ranges and sampling.window_sample(0, 8, 100) == [(0, 100)]
    assert sum((b - a) * 16 for a, b in ranges) <= 256 << 20 and sampling.stride_of(50_000_000) == 5


def test_blocks_and_middle_rows(spark):
    df = spark.range(10_000).withColumn("w", F.floor(F.col("id") / 10))
    got = sampling.stratified_block_sample(df, "id", 20, 25, 0, 9999)
    assert got.count() == 500 and got.selectExpr("id div 500 AS part").distinct().count() == 20
    assert sampling.middle_rows(df.where("id < 40"), "w", "id").select("id").orderBy("id").collect() == [(5,), (15,), (25,), (35,)]


def test_cards(spark):
    cards = [b"TEXT    = 'it''s & more  ' / a quote", b"NUM     =               1.5D3 / number", b"LOGIC   =                    T", b"HIERARCH LONG key.name = 12 / long", b"COMMENT   indented", b"        blank", b"LS      = 'one&'   / c1", b"CONTINUE  'two&'   / c2", b"CONTINUE  'three'  / c3", b"CONTINUE  'orphan'", b"BIG     = 12345678901", b"END", b"AFTER   = 1"]
    text = b"".join(c.ljust(80) for c in cards).decode()
    rows = headers.parse_cards(headers.split_cards(spark.createDataFrame([("p", 0, text)], "path string, hdu int, header string")))
    got = headers.join_continued(rows).orderBy("seq").collect()
    assert [(r.kind, r.key, r.value, r.comment) for r in got] == [
        ("v", "TEXT", "it's & more", "a quote"), ("v", "NUM", "1.5D3", "number"), ("v", "LOGIC", "T", ""), ("v", "LONG key.name", "12", "long"), ("c", "COMMENT", "  indented", ""),
        ("c", "", "blank", ""), ("v", "LS", "onetwothree", "c1 c2 c3"), ("c", "CONTINUE", "orphan", ""), ("v", "BIG", "12345678901", ""), ("e", "END", "", ""),
    ]
    assert headers.keyword(rows, "NUM", "double").first().value == 1500 and headers.keyword(rows, "BIG", "int").first().value == 12345678901
    assert headers.keywords(rows, ["NUM", "LOGIC", "NONE"]).first()[2:] == ("1.5D3", "T", None)


def test_scalars(spark):
    row = spark.range(1).select(
        S.is_finite(F.lit(float("nan"))).alias("nan"), S.is_finite(F.lit(None).cast("double")).alias("null"), S.wrap180(F.lit(359.0)).alias("w"), S.label360(F.lit(-1.0)).alias("l"),
        S.stretch8(F.lit(0.25), F.lit(0.0), F.lit(1.0), F.lit(0.25)).alias("mid"), S.stretch8(F.lit(9.0), F.lit(0.0), F.lit(1.0), F.lit(0.3)).alias("top"), S.to_int(F.lit("1.9D2")).alias("i"), S.to_int(F.lit("x")).alias("bad"),
        S.type_name(F.lit(16), F.lit(1.0), F.lit(32768.0)).alias("t"), S.wcs_linear(F.lit(3), F.lit(10.0), F.lit(2.0)).alias("x"), S.scaled(F.lit(5), 2.0, 1.0, 5).alias("s"), S.printable(F.lit("a\tbé")).alias("p"),
    ).first()
    assert tuple(row) == (False, False, -1.0, 359.0, 128, 255, 190, None, "uint16", 14.0, None, "a?b?")


def test_colours(spark):
    rows = [("cube", [4, 4, 3], None, None, 3), ("freq", [4, 4, 3], "FREQ", None, 3), ("mosaic", [4, 4], None, "rggb", 1), ("odd", [4, 4], None, "RGXB", 1)]
    df = spark.createDataFrame(rows, "path string, naxes array<long>, CTYPE3 string, BAYERPAT string, planes int").withColumns({"format": F.lit("fits"), "unit": F.lit("image"), "COLORTYP": F.lit(None).cast("string")})
    assert {r.path: (r.color, r.pattern) for r in catalog.classify_color(df).collect()} == {"cube": ("rgb", None), "freq": ("mono", None), "mosaic": ("bayer", "RGGB"), "odd": ("mono", None)}


def test_bayer_bottom_up_and_tforms(spark):
    a = np.arange(36.0).reshape(6, 6)
    df = spark.createDataFrame([(y, a[y].tolist()) for y in range(6)], "y int, values array<double>")
    got = {(r.oy, r.ox, r.channel): r.value for r in images.bin_bayer(df, "RGGB", 6, 6, bottom_up=True).collect()}
    assert got[0, 0, "R"] == 6 and got[0, 0, "B"] == 1 and got[2, 2, "G"] == (28 + 35) / 2
    forms = spark.createDataFrame([("11X",), ("3E",), ("PE(9)",), ("0QJ",), ("A",), ("2M",)], "f string")
    parts = S.tform(F.col("f"))
    assert [tuple(r) for r in forms.select(parts["repeat"], parts["type"], parts["width"]).collect()] == [(11, "X", 2), (3, "E", 12), (1, "P", 8), (0, "Q", 0), (1, "A", 1), (2, "M", 32)]
    assert [c["width"] for c in fits.columns({"TFIELDS": "2", "TFORM1": "11X", "TFORM2": "1PE(9)"})] == [2, 8] and fits.columns({"TFIELDS": "1", "TFORM1": "9?"}) == []


def test_arriving_files(spark, tmp_path):
    from starframe.streaming.files import arriving

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fits").write_bytes(fits.image_bytes(np.zeros((2, 3), "i2")))
    q = arriving(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("units").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r.hdu, r.bitpix) for r in spark.sql("SELECT * FROM units").collect()] == [(0, 16)]


def test_axis_choice(spark):
    rows = [("a", "Time", "D", 1), ("a", "sap_flux", "E", 1), ("b", "loglam", "E", 1), ("b", "flux", "E", 1), ("c", "RA", "D", 1), ("c", "DEC", "3D", 3), ("d", "FLUX", "E", 1)]
    df = spark.createDataFrame([(p, 1, n, name, "", form[-1], rep) for n, (p, name, form, rep) in enumerate(rows)], "path string, hdu int, n int, name string, unit string, type string, repeat int")
    assert {(r.path, r.x, r.y, r.kind, r.x_label) for r in tables.pick_axes(df).collect()} == {("a", "Time", "sap_flux", "light", "Time"), ("b", "loglam", "flux", "spectrum", "wavelength")}


def test_cards_end_with_their_header_whatever_its_keys(spark):
    """Each header ends at its own END, keys null or not, and cards are not shuffled or joined to find it."""
    text = "".join(c.ljust(80) for c in ("A       = 1", "END", "B       = 2"))
    rows = headers.split_cards(spark.createDataFrame([("p", 0, text), (None, 0, text), ("q", 0, text[:80]), ("r", 0, None)], "path string, hdu int, header string"))
    assert sorted((r.path or "", r.seq, r.card.strip()) for r in rows.collect()) == [("", 0, "A       = 1"), ("", 1, "END"), ("p", 0, "A       = 1"), ("p", 1, "END"), ("q", 0, "A       = 1")]
    plan = headers.parse_cards(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_continued_strings_are_joined_where_their_cards_lie(spark):
    """Headers are dealt once: neither windows nor grouping move a card again."""
    rows = headers.join_continued(headers.parse_cards(headers.split_cards(spark.createDataFrame([("p", 0, "A       = 'x&'".ljust(80) + "CONTINUE  'y'".ljust(80) + "END".ljust(80))], "path string, hdu int, header string"))))
    assert sorted((r.seq, r.key, r.value) for r in rows.collect()) == [(0, "A", "xy"), (2, "END", "")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.find("Initial Plan") if "Initial Plan" in plan else None].count("Exchange") == 1, plan
