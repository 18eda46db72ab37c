"""Listings by first bytes, bounded walks, plans of sampled rows, and views of stored lists of units."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from starframe import sinks
from starframe.operators import images, sampling
from starframe.sources import files, fits, maps, planned

RNG = np.random.default_rng(33)
TABLE = fits.table_bytes([("a", "D", np.arange(5.0))])


def listed(spark, folder):
    return files.scan_hdus(files.scan_files(spark, str(folder)))


def test_files_of_any_size_are_listed_by_their_first_bytes(spark, tmp_path):
    image = fits.image_bytes(RNG.normal(0, 1, (4, 5)).astype("f4"))
    (tmp_path / "deep").mkdir()
    for name, raw in (("a.fits", image), ("deep/b.gz", gzip.compress(image)), ("c.dat", b"#ASDF 1.0.0\n" + bytes(20)), ("d.gz", gzip.compress(b"no picture " * 9)), ("e.gz", b"\x1f\x8b" + bytes(30)), ("f", b"tiny"), ("g", b""), ("h.xisf", b"XISF0100" + bytes(8)), ("i.bin", bytes(99))):
        (tmp_path / name).write_bytes(raw)
    with (tmp_path / "big.fits").open("wb") as f:  # sparse, 5 GiB
        f.write(fits.header([fits.card("SIMPLE", True), fits.card("BITPIX", 8), fits.card("NAXIS", 1), fits.card("NAXIS1", 5 << 30)]))
        f.truncate(2880 + (5 << 30))
    found = {r.path.rsplit("/", 1)[1]: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert {k: (r.format, r.gz) for k, r in found.items() if r.error is None} == {"a.fits": ("fits", False), "b.gz": ("fits", True), "c.dat": ("asdf", False), "h.xisf": ("xisf", False), "big.fits": ("fits", False)}
    assert {k: r.error for k, r in found.items() if r.error} == {"d.gz": "unknown kind of file", "e.gz": "too short", "f": "too short", "i.bin": "unknown kind of file"}
    assert found["big.fits"].length == 2880 + (5 << 30)
    units = {r.path.rsplit("/", 1)[1]: r for r in listed(spark, tmp_path).collect()}
    assert set(units) == {"a.fits", "b.gz", "big.fits"} and units["big.fits"].data_len == 5 << 30 and not units["big.fits"].truncated
    assert list(units["b.gz"].naxes) == [5, 4]
    assert files.scan_files(spark, str(tmp_path), "*.xisf").count() == 1


def test_files_that_are_gone_are_told(spark):
    gone = spark.sql("SELECT 'file:/nowhere/a.fits' AS path, 99L AS length, now() AS modificationTime")
    row = files._classified(gone).first()
    assert row.format is None and row.error.startswith("can't be opened")


def test_walks_end_after_the_units_asked_for(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(TABLE + TABLE[2880:] * 6)
    found = files.scan_files(spark, str(tmp_path))
    assert [files.scan_hdus(found, most).count() for most in (1, 3, 100)] == [1, 3, 8]


def test_a_plan_reads_within_its_limit(spark):
    shapes = [(300, 200, -32), (17, 4000, 16), (5, 3, 8), (4000, 1, -64)]
    rows = [(f"f{k}", 0, None, [w, h], False, False, 0, bitpix) for k, (w, h, bitpix) in enumerate(shapes)]
    units = spark.createDataFrame(rows, "path string, hdu int, error string, naxes array<bigint>, groups boolean, zimage boolean, tfields bigint, bitpix int")
    for samples, limit in ((4, 2 << 30), (4, 20_000), (0, 2 << 30), (9, 5000)):
        got = {r.path: r for r in planned.bin_plans(units, 20, 30, samples, limit).collect()}
        for k, (w, h, bitpix) in enumerate(shapes):
            plan, row = images.bin_plan(w, h, 20, 30, samples), got[f"f{k}"]
            kept = images.samples_within(w, h, abs(bitpix) // 8, plan["factor"], plan["samples"], limit)
            assert (row.factor, row.samples, row.out_width, row.out_height) == (plan["factor"], kept, plan["width"], plan["height"])
            offsets = spark.range(1).select(planned.offsets_of(F.lit(row.factor).cast("long"), F.lit(row.samples).cast("long"))).first()[0]
            assert offsets == images.offsets(row.factor, row.samples)


@pytest.mark.parametrize("samples", [0, 2, 5])
def test_views_of_images_of_different_sizes(spark, tmp_path, samples):
    cubes = {"a": RNG.normal(0, 1, (2, 41, 67)).astype("f4"), "b": RNG.normal(0, 1, (1, 9, 8)).astype("f4"), "c": RNG.normal(0, 1, (1, 200, 3)).astype("f4")}
    cubes["a"][0, :12, :30] = np.nan
    for name, cube in cubes.items():
        (tmp_path / f"{name}.fits").write_bytes(fits.image_bytes(cube))
    units = listed(spark, tmp_path)
    plans = planned.bin_plans(units, 11, 13, samples)
    cells = maps.binned_images(units, 11, 13, samples).collect()
    seen = planned.sampled_rows(units, plans).groupBy("path").count().collect()
    for name, cube in cubes.items():
        planes, h, w = cube.shape
        plan = images.bin_plan(w, h, 11, 13, samples)
        f, at, across = plan["factor"], *(images.offsets(min(plan["factor"], side), plan["samples"]) for side in (h, w))
        assert [r["count"] for r in seen if r.path.endswith(f"{name}.fits")] == [planes * plan["height"] * len(at)]
        own = {(r.plane, r.oy, r.ox): (r.value, r.n) for r in cells if r.path.endswith(f"{name}.fits")}
        assert len(own) == planes * plan["height"] * plan["width"]
        for (p, oy, ox), (value, n) in own.items():
            v = cube[p][np.ix_([oy * f + o for o in at], [ox * f + o for o in across])].astype(float)
            v = v[np.isfinite(v)]
            assert n == len(v) and (value is None if not n else value == pytest.approx(v.mean(), rel=1e-9))


def tables_of(folder):
    """A sorted table, a shuffled one, a small one, and one without the columns."""
    x = np.sort(RNG.random(40_000)) * 1000
    for name, a in (("sorted", x), ("loose", RNG.permutation(x)), ("small", x[:50])):
        (folder / f"{name}.fits").write_bytes(fits.table_bytes([("x", "D", a), ("y", "D", RNG.normal(0, 1, len(a))), ("n", "J", np.arange(len(a), dtype="i4"))]))
    (folder / "other.fits").write_bytes(TABLE)


def test_rows_that_stand_for_big_tables(spark, tmp_path):
    tables_of(tmp_path)
    units = listed(spark, tmp_path).where("hdu = 1")
    how = {"windows": 50, "window_bytes": 400, "read_all": 100_000}
    ranges = planned.table_windows(units, **how).collect()
    at = {r.path.rsplit("/", 1)[1]: r for r in units.collect()}
    for name in ("sorted.fits", "loose.fits"):
        want = sampling.window_sample(at[name].data_off, 20, 40_000, 50, 400, 100_000)
        assert sorted((r.low, r.high) for r in ranges if r.path.endswith(name)) == want and len(want) == 50
    rows = maps.sampled_points(units, "x", "y", **how).collect()
    own = {n: sorted(r["_row"] for r in rows if r.path.endswith(n)) for n in ("sorted.fits", "loose.fits", "small.fits", "other.fits")}
    want = sampling.window_sample(at["sorted.fits"].data_off, 20, 40_000, 50, 400, 100_000)
    assert own["sorted.fits"] == [a + (b - a) // 2 for a, b in want]  # sorted by x: a row of each window
    assert own["loose.fits"] == sorted(k for a, b in sampling.window_sample(at["loose.fits"].data_off, 20, 40_000, 50, 400, 100_000) for k in range(a, b))
    assert own["small.fits"] == list(range(50)) and own["other.fits"] == []
    assert {r.path.rsplit("/", 1)[1]: r.sampled for r in rows} == {"sorted.fits": True, "loose.fits": True, "small.fits": False}
    assert maps.density_map(units, "x", "y", 64, **how).groupBy("path").agg(F.sum("n").alias("n")).count() == 3
    assert maps.envelope_map(units.where("path is null"), "x", "y", **how).count() == 0


def test_rows_of_text_are_the_first_in_order(spark, tmp_path):
    sinks.write_rows_tsv(spark.range(1000, numPartitions=7).select((999 - F.col("id")).alias("_row"), F.array("id").alias("v")), str(tmp_path / "t"), 5)
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()
    assert [(r["_row"], r.v) for r in got] == [(str(k), f"[{999 - k}]") for k in range(5)]
