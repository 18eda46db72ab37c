"""The registered queries of the archive operators, and the DuckDB SQL that gives the same rows.

All run over whole tables.  Light curves are ``events`` (seconds of ts, value), images are ``embeddings`` (row vec_id of 64 pixels),
positions on the sky are derived from the keys of ``orders``, and header cards are written from ``part`` and ``supplier``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starframe.functions import scalar as S
from starframe.functions.shared import cut
from starframe.operators import headers, images, points, sampling, stats, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.expr("unix_micros(to_utc_timestamp(CAST(ts AS TIMESTAMP), 'UTC')) / 1e6")
    return read(spark, sf_dir, "events").select("event_type", "event_id", seconds.alias("x"), F.col("value").alias("y"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field around RA 0, with placeholders: right ascension and declination from the keys."""
    k = F.col("o_orderkey")
    ra = F.pmod(F.lit(340) + F.pmod(k * 37, F.lit(4000)) / 100.0, F.lit(360.0))
    dec = F.when(F.pmod(k, F.lit(97)) == 0, -999.0).otherwise(F.pmod(k * 53, F.lit(3000)) / 100.0 - 15)
    return read(spark, sf_dir, "orders").select("o_orderstatus", ra.alias("ra"), dec.alias("dec"))


POSITIONS = """p AS (SELECT o_orderstatus, (340 + ((o_orderkey * 37) % 4000) / 100.0::DOUBLE) - CASE WHEN 340 + ((o_orderkey * 37) % 4000) / 100.0::DOUBLE >= 360 THEN 360 ELSE 0 END AS ra,
  CASE WHEN o_orderkey % 97 = 0 THEN -999.0 ELSE ((o_orderkey * 53) % 3000) / 100.0::DOUBLE - 15 END AS dec FROM orders)"""
CURVES = "e AS (SELECT event_type, event_id, epoch_us(ts) / 1e6 AS x, value AS y FROM events)"
#: nearest rank of p among n
NEAREST = "CAST(floor({p} * (n - 1) + 0.5) AS BIGINT)"


def _rank_sql(source: str, group: str, value: str, ranks: dict[str, str]) -> str:
    picks = ", ".join(f"max(CASE WHEN i = {k} THEN v END) AS {name}" for name, k in ranks.items())
    return f"SELECT {group} AS g, any_value(n) AS n, min(v) AS vmin, max(v) AS vmax, {picks} FROM (SELECT {group}, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {source}) GROUP BY 1"


@query(f"WITH {CURVES} SELECT event_type, count(*) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM e GROUP BY 1")
def axis_ranges_events(spark, sf_dir):
    return points.axis_ranges(light_curves(spark, sf_dir), "x", "y", ["event_type"]).drop("w_min", "w_max")


@query(f"""WITH {CURVES}, r AS (SELECT event_type, min(x) AS a, max(x) - min(x) AS span, least(300, count(*)) AS k FROM e GROUP BY 1)
SELECT event_type, c, min(y::FLOAT)::DOUBLE AS lo, max(y::FLOAT)::DOUBLE AS hi, count(*) AS n FROM
(SELECT e.event_type, greatest(0, least(k - 1, CAST(trunc((x - a) * (k / span)) AS INT)))::INT AS c, y FROM e JOIN r USING (event_type)) GROUP BY 1, 2""")
def envelope_events(spark, sf_dir):
    out = points.envelope(light_curves(spark, sf_dir), "x", "y", 300, ["event_type"])
    return out.select("event_type", "c", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "n")


_RANGE = f"""SELECT g, n, CASE WHEN p1 - p0 < 0.2 * (vmax - vmin) THEN p0 ELSE vmin END AS lo, CASE WHEN p1 - p0 < 0.2 * (vmax - vmin) THEN p1 ELSE vmax END AS hi FROM s"""
_PADDED = "SELECT g, n, lo - pad AS y_min, hi + pad AS y_max FROM (SELECT *, CASE WHEN (hi - lo) * 0.05 > 0 THEN (hi - lo) * 0.05 WHEN abs(hi) > 0 THEN abs(hi) * 0.1 ELSE 1.0 END AS pad FROM q)"
_TAILS = {"p0": NEAREST.format(p="0.001"), "p1": NEAREST.format(p="0.999")}


@query(f"""WITH {CURVES}, s AS ({_rank_sql("e", "event_type", "y", _TAILS)}), q AS ({_RANGE}), y AS ({_PADDED}),
r AS (SELECT event_type, min(x) AS a, max(x) - min(x) AS span, least(200, count(*)) AS k FROM e GROUP BY 1),
t AS (SELECT event_type, a, span, k, y_min, y_max, greatest(16, least(1024, floor(k * 3 / 4)))::INT AS m FROM r JOIN y ON event_type = g),
d AS (SELECT event_type, greatest(0, least(k - 1, CAST(trunc((x - a) * (k / span)) AS INT)))::INT AS c, (y - y_min) * (m / (y_max - y_min)) AS r, m FROM e JOIN t USING (event_type))
SELECT event_type, c, CAST(trunc(r) AS INT) AS r, count(*) AS n, least(count(*), 255)::INT AS dots FROM d WHERE r >= 0 AND r < m GROUP BY 1, 2, 3""")
def density_events(spark, sf_dir):
    return points.density_grid(light_curves(spark, sf_dir), "x", "y", 200, ["event_type"])


@query("""SELECT label, c, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, count(*) AS n FROM (SELECT label, CAST(floor(((i + 1) * 20 - 1) / 64) AS INT) AS c, v::FLOAT AS v FROM
(SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)) WHERE isfinite(v) GROUP BY 1, 2""")
def envelope_arrays(spark, sf_dir):
    out = images.envelope_row(read(spark, sf_dir, "embeddings"), 20, ["label"], "embedding")
    return out.select("label", "c", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "n")


@query(f"""WITH {POSITIONS}, v AS (SELECT *, CASE WHEN ra > 180 THEN ra - 360 ELSE ra END AS w FROM p WHERE ra BETWEEN -360 AND 360 AND dec BETWEEN -90 AND 90),
r AS (SELECT o_orderstatus, count(*) AS n, min(ra) AS x0, max(ra) AS x1, min(dec) AS y_min, max(dec) AS y_max, min(w) AS w_min, max(w) AS w_max FROM v GROUP BY 1)
SELECT o_orderstatus, n, w_max - w_min < x1 - x0 - 1 AS wrap, CASE WHEN w_max - w_min < x1 - x0 - 1 THEN w_min ELSE x0 END AS x_min, CASE WHEN w_max - w_min < x1 - x0 - 1 THEN w_max ELSE x1 END AS x_max, y_min, y_max, w_min, w_max FROM r""")
def sky_filter_wrap(spark, sf_dir):
    return points.sky_wrap(points.axis_ranges(positions(spark, sf_dir), "ra", "dec", ["o_orderstatus"], sky=True))


@query(f"""WITH {POSITIONS}, v AS (SELECT CASE WHEN ra > 180 THEN ra - 360 ELSE ra END AS x, dec AS y FROM p WHERE ra BETWEEN -360 AND 360 AND dec BETWEEN -90 AND 90),
s AS ({_rank_sql("(SELECT 0 AS g, * FROM v)", "g", "y", _TAILS)}), q AS ({_RANGE}), y AS ({_PADDED}),
r AS (SELECT min(x) AS a, max(x) - min(x) AS span, least(64, count(*)) AS k FROM v), t AS (SELECT a, span, k, y_min, y_max, greatest(16, least(1024, floor(k * 3 / 4)))::INT AS m FROM r, y),
d AS (SELECT greatest(0, least(k - 1, CAST(trunc((x - a) * (k / span)) AS INT)))::INT AS c, (y.y - y_min) * (m / (y_max - y_min)) AS r, m FROM v AS y, t),
g AS (SELECT c, CAST(trunc(r) AS INT) AS r, count(*) AS n, least(count(*), 255)::INT AS dots FROM d WHERE r >= 0 AND r < m GROUP BY 1, 2), z AS (SELECT max(dots) AS peak, count(*) AS used FROM g)
SELECT c, r, n, dots, round(CASE WHEN used * 8 > 64 * 48 AND peak > 1 THEN 60 + 195 * ln(dots) / ln(peak) ELSE 255.0 END, 6) AS shade FROM g, z""")
def sky_density(spark, sf_dir):
    grid = points.density_grid(positions(spark, sf_dir), "ra", "dec", 64, sky=True)
    return points.density_shades(grid, 64 * 48).withColumn("shade", F.round("shade", 6))


@query(f"WITH s AS ({_rank_sql('lineitem', 'l_returnflag', 'l_extendedprice', _TAILS)}), q AS ({_RANGE}) SELECT g AS l_returnflag, n, y_min, y_max FROM ({_PADDED})")
def plot_range_lineitem(spark, sf_dir):
    return stats.plot_range(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


_MEDIAN = f"m AS ({_rank_sql('lineitem', 'l_returnflag', 'l_extendedprice', {'med': 'n // 2'})})"
_OFF = "o AS (SELECT l_returnflag, abs(l_extendedprice - med) AS off FROM lineitem JOIN m ON l_returnflag = g)"
_MAD = f"a AS ({_rank_sql('o', 'l_returnflag', 'off', {'mad': 'n // 2'})})"


@query(f"WITH {_MEDIAN}, {_OFF}, {_MAD} SELECT m.g AS l_returnflag, m.n, m.vmin, m.vmax, med, mad FROM m JOIN a USING (g)")
def kth_median_mad(spark, sf_dir):
    return stats._mad(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


_AUTO = f"""WITH {_MEDIAN}, {_OFF}, {_MAD}, t AS (SELECT m.g, m.n, m.vmin, m.vmax, med, mad, greatest(m.vmin, med - 2.8 * (1.4826 * mad)) AS lo FROM m JOIN a USING (g)), u AS (SELECT *, (med - lo) / (vmax - lo) AS x0 FROM t),
st AS (SELECT g AS l_returnflag, n, vmin, vmax, med AS median, 1.4826 * mad AS sigma, lo AS black, vmax AS white, lo AS c0, 1 / (vmax - lo) AS inv, CASE WHEN x0 < 0.25 THEN greatest(3 * x0 / (2 * x0 + 1), 1e-12) ELSE 0.5 END AS m FROM u)"""


@query(f"{_AUTO} SELECT l_returnflag, n, vmin, vmax, median, sigma, round(black, 6) AS black, white, round(c0, 6) AS c0, round(inv, 12) AS inv, round(m, 9) AS m FROM st")
def auto_stretch_price(spark, sf_dir):
    out = stats.auto_stretch(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.withColumns({"black": F.round("black", 6), "c0": F.round("c0", 6), "inv": F.round("inv", 12), "m": F.round("m", 9)})


@query(f"""WITH s AS ({_rank_sql("lineitem", "l_returnflag", "l_extendedprice", {"med": NEAREST.format(p="0.5"), "p0": NEAREST.format(p="0.005"), "p1": NEAREST.format(p="0.995")})})
SELECT g AS l_returnflag, n, vmin, vmax, med AS median, 0.0::DOUBLE AS sigma, p0 AS black, p1 AS white, p0 AS c0, 1 / (p1 - p0) AS inv, 0.5::DOUBLE AS m FROM s""")
def linear_stretch_price(spark, sf_dir):
    return stats.linear_stretch(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query(f"""WITH s AS ({_rank_sql("lineitem", "l_returnflag", "l_extendedprice", {"med": NEAREST.format(p="0.5")})})
SELECT g AS l_returnflag, n, vmin, vmax, med AS median, 0.0::DOUBLE AS sigma, vmin AS black, vmax AS white, vmin AS c0, 1 / (vmax - vmin) AS inv, 0.5::DOUBLE AS m FROM s""")
def minmax_stretch_price(spark, sf_dir):
    return stats.minmax_stretch(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


_LEVELS = f"""{_AUTO}, x AS (SELECT l.l_returnflag, CAST(floor(255 * ((m - 1) * t / ((2 * m - 1) * t - m)) + 0.5) AS INT) AS level FROM
(SELECT l_returnflag, m, greatest(least((l_extendedprice - c0) * inv, 1.0), 0.0) AS t FROM lineitem JOIN st USING (l_returnflag)) AS l)"""


def levels(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("value"))
    return images.stretched(items, stats.auto_stretch(items, "value", ["l_returnflag"]), ["l_returnflag"])


@query(f"{_LEVELS} SELECT l_returnflag, level, count(*) AS n FROM x GROUP BY 1, 2")
def stretch8_histogram(spark, sf_dir):
    return levels(spark, sf_dir).groupBy("l_returnflag", "level").agg(F.count("*").alias("n"))


@query(f"""{_LEVELS}, h AS (SELECT l_returnflag, level, count(*) AS k FROM x GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY l_returnflag ORDER BY level) AS run, sum(k) OVER (PARTITION BY l_returnflag) AS n FROM h)
SELECT l_returnflag, 0.0::DOUBLE AS transparent, min(level) AS median_level, any_value(n)::BIGINT AS opaque FROM r WHERE run * 2 >= n GROUP BY 1""")
def render_stats_price(spark, sf_dir):
    return stats.render_stats(levels(spark, sf_dir), "level", ["l_returnflag"])


_PIXELS = "x AS (SELECT vec_id AS y, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS x, label FROM embeddings)"


def pixel_rows(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").alias("values"), "label")


def _height(spark, sf_dir) -> int:
    return read(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]


_H = "(SELECT max(vec_id) + 1 FROM embeddings)"


@query(f"WITH {_PIXELS} SELECT (y // 3)::INT AS oy, (x // 3)::INT AS ox, round(avg(v), 9) AS value, count(*) AS n FROM x WHERE y < {_H} // 3 * 3 AND x < 63 GROUP BY 1, 2")
def bin2d_embeddings_full(spark, sf_dir):
    return images.bin2d(pixel_rows(spark, sf_dir), 3, 21, _height(spark, sf_dir) // 3).withColumn("value", F.round("value", 9))


@query(f"WITH {_PIXELS} SELECT (y // 10)::INT AS oy, (x // 10)::INT AS ox, round(avg(v), 9) AS value, count(*) AS n FROM x WHERE y < {_H} // 10 * 10 AND x < 60 AND y % 10 IN (1, 3, 6, 8) AND x % 10 IN (1, 3, 6, 8) GROUP BY 1, 2")
def bin2d_embeddings_sampled(spark, sf_dir):
    return images.bin2d(pixel_rows(spark, sf_dir), 10, 6, _height(spark, sf_dir) // 10, 4).withColumn("value", F.round("value", 9))


@query("SELECT floor(l_suppkey / 5)::BIGINT AS oy, floor(l_quantity / 5)::BIGINT AS ox, round(avg(l_extendedprice), 6) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2")
def bin2d_points_lineitem(spark, sf_dir):
    return images.bin2d_points(read(spark, sf_dir, "lineitem"), "l_quantity", "l_suppkey", "l_extendedprice", 5).withColumn("value", F.round("value", 6))


@query(f"""WITH {_PIXELS} SELECT (y // 4)::INT AS oy, (x // 4)::INT AS ox, substr('RGGB', ((y % 2) * 2 + x % 2 + 1)::INT, 1) AS channel, round(avg(v), 9) AS value, count(*) AS n FROM x
WHERE y < {_H} // 2 // 2 * 4 GROUP BY 1, 2, 3""")
def bayer_bin_embeddings(spark, sf_dir):
    return images.bin_bayer(pixel_rows(spark, sf_dir), "RGGB", 64, _height(spark, sf_dir), 2).withColumn("value", F.round("value", 9))


@query(f"""WITH {_PIXELS}, b AS (SELECT label % 3 AS label, (y // 50)::INT AS oy, (x // 8)::INT AS ox, round(avg(v), 9) AS value FROM x WHERE y < {_H} // 50 * 50 GROUP BY 1, 2, 3)
SELECT oy, ox, max(CASE WHEN label = 0 THEN value END) AS red, max(CASE WHEN label = 1 THEN value END) AS green, max(CASE WHEN label = 2 THEN value END) AS blue, count(*) = 3 AS opaque FROM b GROUP BY 1, 2""")
def rgb_pivot(spark, sf_dir):
    planes = pixel_rows(spark, sf_dir).withColumn("channel", F.pmod("label", F.lit(3)))
    wide = planes.select("channel", "y", F.posexplode("values").alias("x", "v")).where(F.col("y") < _height(spark, sf_dir) // 50 * 50)
    cells = images.bin2d_points(wide, "x", "y", "v", 8, 50, ["channel"])
    return images.rgb(cells.select("channel", F.col("oy").cast("int").alias("oy"), F.col("ox").cast("int").alias("ox"), F.round("value", 9).alias("value")))


@query("SELECT vec_id AS y, round(list_sum(list_transform(embedding[11:30], lambda x: x::DOUBLE)), 6) AS total, 20 AS width FROM embeddings WHERE vec_id >= 100 AND vec_id < 350")
def crop_region(spark, sf_dir):
    x, y, w, h = images.crop_plan(10, 100, 20, 250, 64, 10**9)
    part = images.crop(pixel_rows(spark, sf_dir), x, y, w, h)
    return part.select("y", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"), F.size("values").alias("width"))


@query("""SELECT vec_id AS y, label AS plane, CASE label WHEN 5 THEN 'middle' WHEN 9 THEN 'last' ELSE 'listed' END AS asked,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""")
def plane_slice(spark, sf_dir):
    """The middle plane of ten, the last for one beyond, and a list of the others."""
    rows = pixel_rows(spark, sf_dir).withColumnRenamed("label", "plane")
    picked = {"middle": None, "last": 99, "listed": [0, 1, 2, 3, 4, 6, 7, 8]}
    out = [images.select_plane(rows, plane, planes=10).withColumn("asked", F.lit(name)) for name, plane in picked.items()]
    total = F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double")), 6)
    return out[0].unionByName(out[1]).unionByName(out[2]).select("y", "plane", "asked", total.alias("total"))


@query(f"""WITH {CURVES}, r AS (SELECT event_type, min(x) AS a, max(x) - min(x) AS span, least(1000, count(*)) AS k FROM e GROUP BY 1),
c AS (SELECT DISTINCT event_type, greatest(0, least(k - 1, CAST(trunc((x - a) * (k / span)) AS INT)))::INT AS c FROM e JOIN r USING (event_type)),
b AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY event_type ORDER BY c) > 3 THEN 1 ELSE 0 END AS broken FROM c)
SELECT event_type, c, (sum(broken) OVER (PARTITION BY event_type ORDER BY c))::INT AS segment FROM b""")
def line_segments_events(spark, sf_dir):
    cols = points.envelope(light_curves(spark, sf_dir), "x", "y", 1000, ["event_type"])
    return points.line_segments(cols, 100, ["event_type"]).select("event_type", "c", "segment")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey % 7 = 0")
def stride_sample_lineitem(spark, sf_dir):
    return sampling.stride_sample(read(spark, sf_dir, "lineitem"), 7, "l_orderkey").select("l_orderkey", "l_linenumber", "l_extendedprice")


_EACH = """w AS (SELECT l_returnflag AS g, l_orderkey // 100 AS w, l_extendedprice AS x, l_quantity AS y FROM lineitem), k AS (SELECT g, w, max(x) - min(x) AS dx, max(y) - min(y) AS dy FROM w GROUP BY 1, 2 HAVING count(*) > 1), a AS (SELECT g, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM w GROUP BY 1)"""


@query(f"""WITH {_EACH}, mx AS ({_rank_sql("k", "g", "dx", {"m": NEAREST.format(p="0.5")})}), my AS ({_rank_sql("k", "g", "dy", {"m": NEAREST.format(p="0.5")})})
SELECT a.g AS l_returnflag, mx.m / sx AS spread_x, my.m / sy AS spread_y, mx.m / sx < 0.25 OR my.m / sy < 0.25 AS sorted FROM a JOIN mx ON a.g = mx.g JOIN my ON a.g = my.g""")
def block_sample_spread(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").withColumn("w", F.floor(F.col("l_orderkey") / 100))
    return sampling.window_spread(items, "l_extendedprice", "l_quantity", "w", ["l_returnflag"])


@query("SELECT l_returnflag, count(*) AS total, count(*) FILTER (l_quantity <> 13) AS valid, bool_or(l_quantity = 13) AS has_missing, false AS empty FROM lineitem GROUP BY 1")
def data_quality_lineitem(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_quantity") != 13, F.col("l_quantity")).otherwise(F.lit(float("nan"))))
    return stats.data_quality(items, "v", ["l_returnflag"])


def part_cards(spark, sf_dir):
    """Four cards for each part: a name, a price with a comment, a long string that is continued, and a comment card."""
    part = read(spark, sf_dir, "part")
    card = lambda text: F.rpad(text, 80, " ")
    cards = F.array(
        card(F.concat(F.lit("OBJECT  = '"), F.rpad(F.replace("p_name", F.lit("'"), F.lit("''")), 20, " "), F.lit("' / name"))),
        card(F.concat(F.lit("PRICE   = "), F.lpad(F.col("p_retailprice").cast("decimal(20,2)").cast("string"), 20, " "), F.lit(" / [unit] price"))),
        card(F.concat(F.lit("LONGSTR = '"), F.col("p_brand"), F.lit("&' / first"))),
        card(F.concat(F.lit("CONTINUE  '"), F.col("p_type"), F.lit("' / second"))),
        card(F.concat(F.lit("COMMENT   size "), F.col("p_size").cast("string"))),
        card(F.lit("END")),
    )
    return part.select(F.col("p_partkey").alias("path"), F.lit(0).alias("hdu"), F.array_join(cards, "").alias("header"))


def parsed_cards(spark, sf_dir):
    return headers.parse_cards(headers.split_cards(part_cards(spark, sf_dir)))


@query("""SELECT p_partkey AS path, 0 AS seq, 'v' AS kind, 'OBJECT' AS key, rtrim(left(rpad(p_name, 20, ' '), 20)) AS value, true AS is_string, 'name' AS comment FROM part
UNION ALL SELECT p_partkey, 1, 'v', 'PRICE', p_retailprice::DECIMAL(20,2)::VARCHAR, false, '[unit] price' FROM part
UNION ALL SELECT p_partkey, 2, 'v', 'LONGSTR', p_brand || '&', true, 'first' FROM part
UNION ALL SELECT p_partkey, 3, 'c', 'CONTINUE', p_type, true, 'second' FROM part
UNION ALL SELECT p_partkey, 4, 'c', 'COMMENT', '  size ' || p_size, false, '' FROM part
UNION ALL SELECT p_partkey, 5, 'e', 'END', '', false, '' FROM part""")
def cards_parse(spark, sf_dir):
    return parsed_cards(spark, sf_dir).select("path", "seq", "kind", "key", "value", "is_string", "comment")


@query("SELECT p_partkey AS path, 2 AS seq, p_brand || p_type AS value, 'first second' AS comment FROM part")
def cards_continue(spark, sf_dir):
    return headers.join_continued(parsed_cards(spark, sf_dir)).where("key = 'LONGSTR'").select("path", "seq", "value", "comment")


@query("SELECT p_partkey AS path, p_retailprice::DECIMAL(20,2)::DOUBLE AS value, trunc(p_retailprice)::BIGINT AS whole FROM part")
def keyword_lookup(spark, sf_dir):
    cards = parsed_cards(spark, sf_dir)
    price = headers.keyword(cards, "PRICE", "double").select("path", "value")
    return price.join(headers.keyword(cards, "PRICE", "int").select("path", F.col("value").alias("whole")), "path")


@query("""SELECT p_partkey AS path, 'OBJECT' AS key FROM part WHERE left(rpad(p_name, 20, ' '), 20) ILIKE '%an%' UNION ALL SELECT p_partkey, 'LONGSTR' FROM part WHERE p_brand || '&' ILIKE '%an%'
UNION ALL SELECT p_partkey, 'CONTINUE' FROM part WHERE p_type ILIKE '%an%'""")
def header_search(spark, sf_dir):
    return headers.search(parsed_cards(spark, sf_dir), "an").select("path", "key")


def table_headers(spark, sf_dir):
    """A binary table's header for each supplier: five columns whose forms and names follow from its key."""
    k = F.col("s_suppkey")
    pick = lambda options, by: F.element_at(F.array(*(F.lit(x) for x in options)), (F.pmod(F.floor(by), F.lit(len(options))) + 1).cast("int"))
    names = [pick(["TIME", "wavelength", "RA", "LOGLAM"], k), pick(["FLUX", "DEC", "MAG"], k / 4), F.lit("ID"), F.lit("NAME"), F.lit("BITS")]
    forms = [pick(["D", "E", "3E", "J"], k / 2), pick(["E", "D", "3E"], k / 3), F.lit("K"), pick(["8A", "12A"], k), pick(["11X", "PE(7)", "0PJ", "2M"], k / 5)]
    cards = [F.struct(F.lit(2 * i).alias("seq"), F.lit(f"T{w}{i + 1}").alias("key"), v.alias("value")) for i in range(5) for w, v in (("TYPE", names[i]), ("FORM", forms[i]))]
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), F.lit(1).alias("hdu"), F.inline(F.array(*cards))).withColumn("kind", F.lit("v"))


_TABLES = """o AS (SELECT s_suppkey AS path, ['TIME','wavelength','RA','LOGLAM'][(s_suppkey % 4 + 1)::INT] AS n1, ['FLUX','DEC','MAG'][(s_suppkey // 4 % 3 + 1)::INT] AS n2,
 ['D','E','3E','J'][(s_suppkey // 2 % 4 + 1)::INT] AS f1, ['E','D','3E'][(s_suppkey // 3 % 3 + 1)::INT] AS f2, [8, 12][(s_suppkey % 2 + 1)::INT] AS w4, [2, 8, 0, 32][(s_suppkey // 5 % 4 + 1)::INT] AS w5 FROM supplier),
 w AS (SELECT *, CASE f1 WHEN 'D' THEN 8 WHEN '3E' THEN 12 ELSE 4 END AS w1, CASE f2 WHEN 'D' THEN 8 WHEN '3E' THEN 12 ELSE 4 END AS w2 FROM o)"""


@query(f"""WITH {_TABLES}, c AS (SELECT path, unnest([1, 2, 3, 4, 5]) AS n, unnest([0, w1, w1 + w2, w1 + w2 + 8, w1 + w2 + 8 + w4]) AS byte_offset, unnest([w1, w2, 8, w4, w5]) AS width, unnest([n1, n2, 'ID', 'NAME', 'BITS']) AS name FROM w)
SELECT path, n::INT AS n, name, byte_offset::BIGINT AS byte_offset, width::BIGINT AS width FROM c""")
def column_offsets(spark, sf_dir):
    return tables.describe_columns(table_headers(spark, sf_dir)).select("path", "n", "name", "byte_offset", "width")


@query(f"""WITH {_TABLES} SELECT path, n1 AS x, n2 AS y, CASE WHEN n1 = 'TIME' THEN 'light' WHEN n1 = 'RA' THEN 'sky' ELSE 'spectrum' END AS kind, n1 = 'LOGLAM' AS xlog, n2 = 'MAG' AS y_flip, CASE WHEN n1 = 'LOGLAM' THEN 'WAVELENGTH' ELSE n1 END AS x_label
FROM w WHERE (f1 = '3E') = (f2 = '3E') AND ((n1 = 'TIME' AND n2 IN ('FLUX', 'MAG')) OR (n1 IN ('wavelength', 'LOGLAM') AND n2 = 'FLUX') OR (n1 = 'RA' AND n2 = 'DEC'))""")
def pick_axes(spark, sf_dir):
    return tables.pick_axes(tables.describe_columns(table_headers(spark, sf_dir))).select("path", "x", "y", "kind", "xlog", "y_flip", "x_label")


def order_files(spark, sf_dir):
    """``orders`` as FITS files in a column, 16 of them (more with more rows)."""
    from starframe import sinks

    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.pmod("o_custkey", F.lit(100)).cast("int").alias("cust"), F.floor(F.col("o_orderkey") / 4000).alias("file"))
    return sinks.fits_tables(orders, {"o_orderkey": "K", "o_totalprice": "D", "o_orderstatus": "1A", "cust": "J"}, "file", {"TSCAL4": 0.5, "TZERO4": 10.0, "TNULL4": 13})


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_custkey % 100 = 13 THEN NULL ELSE (o_custkey % 100) * 0.5::DOUBLE + 10 END AS cust FROM orders")
def fits_table_roundtrip(spark, sf_dir):
    from starframe.sources import files

    rows = files.table_rows(order_files(spark, sf_dir), "o_orderkey bigint, o_totalprice double, o_orderstatus string, cust int")
    return tables.scaled_columns(rows, [{"name": "cust", "type": "J", "scale": 0.5, "zero": 10.0, "null": 13}]).drop("path", "_row")


@query("""SELECT (o_orderkey // 4000)::VARCHAR AS path, 1 AS hdu, count(*)::BIGINT AS n_rows, 4 AS tfields, 'BINTABLE' AS xtension, false AS truncated FROM orders GROUP BY o_orderkey // 4000""")
def fits_hdu_list(spark, sf_dir):
    from starframe.sources import files

    units = files.scan_hdus(files.from_content(order_files(spark, sf_dir)))
    return units.where("hdu = 1").select("path", "hdu", "n_rows", F.col("tfields").cast("int").alias("tfields"), "xtension", "truncated")


@query("""SELECT f.path, c.n, c.name, c.byte_offset FROM (SELECT DISTINCT (o_orderkey // 4000)::VARCHAR AS path FROM orders) AS f,
(VALUES (1, 'o_orderkey', 0::BIGINT), (2, 'o_totalprice', 8), (3, 'o_orderstatus', 16), (4, 'cust', 17)) AS c(n, name, byte_offset)""")
def fits_columns(spark, sf_dir):
    from starframe.sources import files

    units = files.scan_hdus(files.from_content(order_files(spark, sf_dir))).where("hdu = 1")
    return tables.describe_columns(files.scan_cards(units)).select("path", "n", "name", "byte_offset")


@query("""SELECT path, oy::INT AS oy, ox::INT AS ox, round(avg(v), 9) AS value, count(*) AS n FROM (SELECT path, (row_number() OVER (PARTITION BY path, x ORDER BY y) - 1) // 4 AS oy, x // 4 AS ox, v FROM
(SELECT vec_id AS y, label || '-' || (vec_id // 400) AS path, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings)) GROUP BY 1, 2, 3""")
def fits_image_roundtrip_bin(spark, sf_dir):
    """Images of a label and 400 numbers of vectors each, so of 400 rows at most, written as FITS and binned whole."""
    from starframe import sinks
    from starframe.sources import files

    path = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / 400).cast("string"))
    made = sinks.fits_images(read(spark, sf_dir, "embeddings").select(path.alias("name"), F.col("vec_id").alias("y"), F.col("embedding").alias("values")), "name")
    return images.bin2d(files.image_rows(made), 4, 16, 100, by=["path"]).withColumn("value", F.round("value", 9))


@query("""SELECT (o_orderkey // 4000)::VARCHAR AS path, 1 AS hdu, 'table' AS unit, count(*)::BIGINT AS n_rows, 4::BIGINT AS n_columns FROM orders GROUP BY o_orderkey // 4000""")
def hdu_classes(spark, sf_dir):
    """What each unit of the files of orders is; empty primary units are not listed."""
    from starframe.operators import catalog
    from starframe.sources import files

    none = F.lit(None).cast("string")
    units = files.scan_hdus(files.from_content(order_files(spark, sf_dir))).withColumns({"kind": none, "dtype": none})
    return catalog.classify_hdus(units).where("unit is not null").select("path", "hdu", "unit", "n_rows", "n_columns")


@query("""SELECT path, _row, o_orderkey FROM (SELECT (o_orderkey // 4000)::VARCHAR AS path, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) - 1 AS _row, o_orderkey FROM orders) WHERE _row BETWEEN 100 AND 199""")
def fits_rows_between(spark, sf_dir):
    """The second hundred rows of every file's table: a range of rows is the feature."""
    from starframe.sources import files

    rows = files.table_rows(order_files(spark, sf_dir), "o_orderkey bigint")
    return tables.rows_between(rows, 100, 100).select("path", "_row", "o_orderkey")


def _folder(spark, name: str) -> str:
    import uuid

    from starframe.functions.shared import folder

    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _vector_rows(spark, sf_dir):
    """Vectors as rows of images: one image for each label and 400 numbers."""
    path = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / 400).cast("string"))
    return read(spark, sf_dir, "embeddings").select(path.alias("name"), F.col("vec_id").alias("y"), F.col("embedding").alias("values"))


#: Images of vectors, in SQL: path, y, place in the row, value.
VECTORS = "SELECT label || '-' || (vec_id // 400) AS path, row_number() OVER (PARTITION BY label, vec_id // 400 ORDER BY vec_id) - 1 AS y, embedding FROM embeddings"
ROW_SUMS = f"SELECT path, y, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM ({VECTORS})"


def _row_sums(rows):
    name = F.regexp_replace("path", "^.*/|\\.fits$", "")
    return rows.select(name.alias("path"), "y", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_custkey % 100 = 13 THEN NULL ELSE (o_custkey % 100) * 0.5::DOUBLE + 10 END AS cust FROM orders")
def fits_scaled_nulls(spark, sf_dir):
    """``orders`` written as files and read by the data source ``fits_table``, scaled."""
    from starframe import sinks
    from starframe.sources import fits_sources

    at = _folder(spark, "tables")
    sinks.write_files(order_files(spark, sf_dir), at).count()
    return fits_sources.read_table(spark, at).select("o_orderkey", "o_totalprice", "o_orderstatus", "cust")


@query(ROW_SUMS)
def fits_image_rows(spark, sf_dir):
    """Images written as files and read by the data source ``fits_image``."""
    from starframe import sinks
    from starframe.sources import fits_sources

    at = _folder(spark, "images")
    sinks.write_files(sinks.fits_images(_vector_rows(spark, sf_dir), "name"), at).count()
    return _row_sums(fits_sources.read_image(spark, at))


@query(f"{ROW_SUMS} WHERE y % 3 = 1")
def planned_sampled_rows(spark, sf_dir):
    """Every third row of images, planned from the stored list of their units: the sample is the feature."""
    from starframe import sinks
    from starframe.sources import files, planned

    listed = sinks.write_files(sinks.fits_images(_vector_rows(spark, sf_dir), "name"), _folder(spark, "images"))
    index = _folder(spark, "units")
    files.scan_hdus(listed).write.parquet(index)
    return _row_sums(planned.image_rows(spark.read.parquet(index), every=3, offset=1))


@query("SELECT (o_orderkey // 4000)::VARCHAR AS path, o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) - 1 AS _row FROM orders")
def planned_table_rows(spark, sf_dir):
    """Rows of tables, planned from the stored list of their units."""
    from starframe import sinks
    from starframe.sources import files, planned

    listed = sinks.write_files(order_files(spark, sf_dir), _folder(spark, "tables"))
    index = _folder(spark, "units")
    files.scan_hdus(listed).write.parquet(index)
    rows = planned.table_rows(spark.read.parquet(index).where("hdu = 1"), "o_orderkey bigint", range_bytes=20_000)
    return rows.where("error is null").select(F.regexp_replace("path", "^.*/|\\.fits$", "").alias("path"), "o_orderkey", "_row")


@query(ROW_SUMS)
def tile_gzip_roundtrip(spark, sf_dir):
    """Images in gzipped tiles, decoded tile by tile and put together."""
    from starframe import sinks
    from starframe.sources import files, tiles

    listed = sinks.write_files(sinks.tiled_images(_vector_rows(spark, sf_dir), "name"), _folder(spark, "tiles"))
    return _row_sums(tiles.assemble(tiles.decode_tiles(files.scan_hdus(listed))))


@query(f"""SELECT path, tile, min(y) AS y0, count(DISTINCT y) AS n_rows, round(sum(v), 6) AS total FROM (SELECT path, y, y // 16 * 2 + x // 32 AS tile, x, v FROM
(SELECT path, y, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM ({VECTORS}))) WHERE tile >= 2 AND tile < 4 AND x >= 32 GROUP BY 1, 2""")
def tile_grid_pruned(spark, sf_dir):
    """The tiles of all images that meet rows 16 to 31 and columns 32 on, chosen by their place in the grid before any is read."""
    from starframe import sinks
    from starframe.sources import files, tiles

    listed = sinks.write_files(sinks.tiled_images(_vector_rows(spark, sf_dir), "name"), _folder(spark, "tiles"))
    lines = tiles.decode_tiles(files.scan_hdus(listed), y=(16, 32), x=(32, 64))
    name = F.regexp_replace("path", "^.*/|\\.fits$", "")
    return lines.groupBy(name.alias("path"), "tile").agg(F.min("y").alias("y0"), F.count("*").alias("n_rows"), F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda a, v: a + v)), 6).alias("total"))


@query(ROW_SUMS)
def xisf_roundtrip(spark, sf_dir):
    """Images as XISF: shuffled, in three zlib subblocks, each decoded apart."""
    from starframe import sinks
    from starframe.sources import files, xisf

    made = sinks.xisf_images(_vector_rows(spark, sf_dir), "name")
    return _row_sums(xisf.pixels(xisf.images(files.from_content(made))))


@query("""SELECT path, plane, (plane * 256 + 255) // 1000 - plane * 256 // 1000 + 1 AS n_frames, total FROM (SELECT label::VARCHAR AS path, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS plane,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings)""")
def asdf_lz4_planes(spark, sf_dir):
    """Vectors as planes (8 by 8) of ASDF cubes, in LZ4 frames of 1000 bytes: which frames hold each plane, and its sum."""
    from starframe import sinks
    from starframe.sources import asdf, files, stored

    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.col("embedding").alias("values"))
    made = cut(files.from_content(sinks.asdf_cubes(rows, "label", (8, 8), frame=1000)))
    arrays = cut(asdf.arrays(made))
    held = stored.wanted(asdf.chunks(arrays), asdf.frames(made)).groupBy("path", "plane").agg(F.count("*").alias("n_frames"))
    sums = asdf.pixels(made, arrays).groupBy("path", "plane").agg(F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda a, v: a + v)), 6).alias("total"))
    return held.join(sums, ["path", "plane"])


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, list_sort(list(l_extendedprice * pow(10, l_linenumber * 40 - 160)))[1 + (count(*) // 2)] AS med FROM lineitem GROUP BY 1, 2""")
def digit_median_spread(spark, sf_dir):
    """Medians of values that spread over 280 orders of magnitude, found by digits whatever the size of a group."""
    spread = read(spark, sf_dir, "lineitem").withColumn("v", F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("l_linenumber") * 40 - 160))
    return stats.order_stats(spread, "v", {"med": stats.middle}, ["l_returnflag", "l_linestatus"], sort_up_to=0).select("l_returnflag", "l_linestatus", "n", "med")


def _listed_orders(spark, sf_dir):
    """``orders`` written as files and listed by their first bytes."""
    from starframe import sinks
    from starframe.sources import files

    at = _folder(spark, "tables")
    sinks.write_files(order_files(spark, sf_dir), at).count()
    return files.scan_files(spark, at)


_NAME = "regexp_replace(path, '^.*/|\\\\.fits$', '')"


@query("SELECT (o_orderkey // 4000)::VARCHAR AS path, 'fits' AS format, false AS gz, (5760 + (count(*) * 21 + 2879) // 2880 * 2880)::BIGINT AS length FROM orders GROUP BY o_orderkey // 4000")
def scan_files_kinds(spark, sf_dir):
    return _listed_orders(spark, sf_dir).where("error is null").select(F.expr(_NAME).alias("path"), "format", "gz", "length")


@query("SELECT DISTINCT (o_orderkey // 4000)::VARCHAR AS path, 0 AS hdu, 0::BIGINT AS data_len, 2880::BIGINT AS next_off FROM orders")
def scan_hdus_bounded(spark, sf_dir):
    """The first unit of each file: the walks end there, which is the feature."""
    from starframe.sources import files

    return files.scan_hdus(_listed_orders(spark, sf_dir), most=1).select(F.expr(_NAME).alias("path"), "hdu", "data_len", "next_off")


@query("SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS status, (o_custkey + 0.5)::DOUBLE * 10 AS cust FROM orders")
def fits_ascii_roundtrip(spark, sf_dir):
    """``orders`` as lines of an ASCII table, with an exponent written by D."""
    parts = [F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.lpad(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), 16, " "), F.rpad("o_orderstatus", 4, " "), F.lpad(F.concat(F.col("o_custkey").cast("string"), F.lit(".5D+1")), 20, " ")]
    columns = [{"name": n, "type": t, "byte_offset": a, "width": w} for n, t, a, w in (("id", "I", 0, 12), ("price", "F", 12, 16), ("status", "A", 28, 4), ("cust", "D", 32, 20))]
    return tables.ascii_fields(read(spark, sf_dir, "orders").select(F.concat(*parts).alias("line")), columns)


@query("SELECT path, o_orderkey, _row FROM (SELECT (o_orderkey // 4000)::VARCHAR AS path, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) - 1 AS _row, o_orderkey FROM orders) WHERE _row < 25")
def table_head(spark, sf_dir):
    """The first 25 rows of every file's table, which is the feature."""
    from starframe.sources import files

    return tables.head(files.table_rows(order_files(spark, sf_dir), "o_orderkey bigint"), 25).select("path", "o_orderkey", "_row")


def _unit_lists(spark, sf_dir):
    """A file of three units for each supplier: an empty one, an image, a row of pixels or a table, and a second image or table."""
    k = F.col("s_suppkey")
    axes = lambda *n: F.array(*(F.lit(x).cast("bigint") for x in n))
    kind, again = F.pmod(k, F.lit(4)), F.pmod(k, F.lit(3)) == 0
    unit = lambda hdu, xtension, naxes, plot: F.struct(F.lit(hdu).alias("hdu"), xtension.alias("xtension"), naxes.alias("naxes"), plot.alias("kind"))
    none = F.lit(None).cast("string")
    first = unit(0, none, F.array().cast("array<bigint>"), none)
    second = unit(1, F.when(kind < 2, "IMAGE").otherwise("BINTABLE"), F.when(kind == 0, axes(64, 64)).when(kind == 1, axes(500)).otherwise(axes(16, 100)), F.when(kind == 2, "sky"))
    third = unit(2, F.when(again, "IMAGE").otherwise("BINTABLE"), F.when(again, axes(32, 32)).otherwise(axes(8, 10)), none)
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.inline(F.array(first, second, third)))
    return rows.withColumns({"format": F.lit("fits"), "bitpix": F.lit(-32), "bscale": F.lit(1.0), "bzero": F.lit(0.0), "supported": F.lit(True), "error": none, "zimage": F.lit(False), "groups": F.lit(False), "cmptype": none, "tfields": F.lit(4).cast("bigint"), "dtype": none, "sky": F.col("kind") == "sky", "preferred": F.lit(False)})


@query("""SELECT 'f' || s_suppkey AS path, (CASE WHEN s_suppkey % 4 IN (0, 2) THEN 1 WHEN s_suppkey % 3 = 0 THEN 2 WHEN s_suppkey % 4 = 1 THEN 1 END)::INT AS hdu, s_suppkey % 4 = 2 AS is_table, s_suppkey % 4 = 2 AS is_sky,
CASE WHEN s_suppkey % 4 = 3 AND s_suppkey % 3 <> 0 THEN 'tables only, and none has axes' END AS reason FROM supplier""")
def default_view(spark, sf_dir):
    from starframe.operators import catalog

    return catalog.select_hdu(_unit_lists(spark, sf_dir))


@query("""SELECT 'f' || s_suppkey AS path, hdu::INT AS hdu, CASE WHEN hdu = 1 THEN CASE s_suppkey % 4 WHEN 0 THEN 'image' WHEN 3 THEN 'table' ELSE 'plot' END ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'image' ELSE 'table' END END AS unit,
CASE WHEN (hdu = 1 AND s_suppkey % 4 < 2) OR (hdu = 2 AND s_suppkey % 3 = 0) THEN 'float32' END AS element FROM supplier, (VALUES (1), (2)) AS h(hdu)""")
def unit_listing(spark, sf_dir):
    from starframe.operators import catalog

    return catalog.listing(_unit_lists(spark, sf_dir)).select("path", "hdu", "unit", "element")


@query("""WITH p AS (SELECT p_partkey AS path, [3, 2, 4][(p_partkey % 3 + 1)::INT] AS k, [NULL, 'RGB', 'WAVE', 'color'][(p_partkey % 4 + 1)::INT] AS t, ['RGGB', 'rggb', NULL, 'XYZW', 'GB'][(p_partkey % 5 + 1)::INT] AS b, p_partkey % 7 = 0 AS x, p_partkey % 2 = 0 AS top FROM part),
c AS (SELECT *, CASE WHEN k = 3 AND (t IS NULL OR t <> 'WAVE') THEN 'rgb' WHEN k = 2 AND upper(b) = 'RGGB' THEN 'bayer' ELSE 'mono' END AS color FROM p)
SELECT path, color, CASE WHEN color = 'bayer' THEN 'RGGB' END AS pattern, NOT (top OR x) AS flip FROM c""")
def color_and_row_order(spark, sf_dir):
    from starframe.operators import catalog

    k = F.col("p_partkey")
    pick = lambda n, *options: F.element_at(F.array(*options), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    axes = lambda *n: F.array(*(F.lit(x).cast("bigint") for x in n))
    text = lambda *options: [F.lit(x).cast("string") for x in options]
    units = read(spark, sf_dir, "part").select(
        k.alias("path"), pick(3, axes(10, 20, 3), axes(10, 20), axes(10, 20, 4)).alias("naxes"), pick(4, *text(None, "RGB", "WAVE", "color")).alias("CTYPE3"), pick(5, *text("RGGB", "rggb", None, "XYZW", "GB")).alias("BAYERPAT"), F.lit(None).cast("string").alias("COLORTYP"),
        F.when(F.pmod(k, F.lit(7)) == 0, "xisf").otherwise("fits").alias("format"), F.when(F.pmod(k, F.lit(2)) == 0, "top-down").alias("ROWORDER"), F.lit("image").alias("unit"), pick(3, F.lit(3), F.lit(1), F.lit(4)).alias("planes"),
    )
    return catalog.row_order(catalog.classify_color(units)).select("path", "color", "pattern", "flip")


@query(f"""WITH {_PIXELS}, h AS (SELECT {_H} AS h), r AS (SELECT h, least(128, h) AS r, greatest(2000 // least(128, h), 1) AS c FROM h), g AS (SELECT least(c, 64) AS c, r, h FROM r)
SELECT y::BIGINT AS oy, x::BIGINT AS ox, round(v, 6) AS value FROM x, g WHERE y IN (SELECT ((2 * i + 1) * h) // (2 * r) FROM g, range(128) AS t(i) WHERE i < r) AND x IN (SELECT ((2 * i + 1) * 64) // (2 * c) FROM g, range(64) AS t(i) WHERE i < c)""")
def reference_sample_embeddings(spark, sf_dir):
    """The pixels that a stretch is made from: rows and columns spread over the whole image, which is the feature."""
    height = _height(spark, sf_dir)
    out = images.reference_sample(pixel_rows(spark, sf_dir), 64, height, side=max(height, 64), most=2000)
    return out.select(F.col("oy").cast("bigint").alias("oy"), F.col("ox").cast("bigint").alias("ox"), F.round("value", 6).alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(pow(10, 3 + l_discount), 6) AS wavelength, round(l_quantity + (l_linenumber - 2) * l_tax, 6) AS world FROM lineitem")
def spectral_axes(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", F.round(S.from_loglam(3 + F.col("l_discount")), 6).alias("wavelength"), F.round(S.wcs_linear(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_tax"), 2), 6).alias("world"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 5 = 1 THEN 'int8' ELSE 'uint8' END WHEN 1 THEN CASE WHEN p_partkey % 5 = 2 THEN 'uint16' ELSE 'int16' END WHEN 2 THEN CASE WHEN p_partkey % 5 = 3 THEN 'uint32' ELSE 'int32' END WHEN 3 THEN 'int64' WHEN 4 THEN 'float32' ELSE 'float64' END AS element FROM part""")
def element_types(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda n, *options: F.element_at(F.array(*(F.lit(x) for x in options)), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", S.type_name(pick(6, 8, 16, 32, 64, -32, -64), F.lit(1.0), pick(5, 0.0, -128.0, 32768.0, 2147483648.0, 1.0)).alias("element"))


def _cubes(spark, sf_dir):
    from starframe import sinks
    from starframe.sources import files

    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.col("embedding").alias("values"))
    return files.from_content(sinks.asdf_cubes(rows, "label", (8, 8), frame=1000))


@query("""WITH n AS (SELECT label::VARCHAR AS path, count(*) AS n FROM embeddings GROUP BY 1)
SELECT path, t.seq::INT AS seq, t.key, CASE WHEN t.seq = 4 THEN '[' || n || ', 8, 8]' ELSE t.value END AS value, t.tag FROM n, (VALUES (0, 'data', '', 'ndarray-1.0.0'), (1, 'source', '0', ''), (2, 'datatype', 'float32', ''), (3, 'byteorder', 'little', ''), (4, 'shape', '', '')) AS t(seq, key, value, tag)""")
def asdf_tree_lines(spark, sf_dir):
    from starframe.sources import asdf

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return asdf.tree(_cubes(spark, sf_dir)).select("path", "seq", "key", text("value"), text("tag"))


@query("SELECT label::VARCHAR AS path, 'data' AS extname, 'float32' AS dtype, 8::BIGINT AS width, 8::BIGINT AS height, count(*)::BIGINT AS planes, count(*)::BIGINT * 256 AS size, 'lz4' AS comp, true AS preferred FROM embeddings GROUP BY 1")
def asdf_arrays_and_blocks(spark, sf_dir):
    """Arrays of ASDF files with the sizes of their frames, as a running list of the block that each lies in."""
    from starframe.sources import asdf

    made = _cubes(spark, sf_dir)
    raw = asdf.frames(made).groupBy("path", "block").agg(F.sum("raw").alias("size"))
    stored = asdf.blocks(made).select("path", "block", "comp")
    arrays = asdf.arrays(made).where("supported").select("path", F.col("source").cast("int").alias("block"), "extname", "dtype", F.col("naxes")[0].alias("width"), F.col("naxes")[1].alias("height"), F.col("naxes")[2].alias("planes"), "preferred")
    return arrays.join(stored, ["path", "block"]).join(raw, ["path", "block"]).drop("block")


@query(f"""WITH n AS (SELECT path, count(*) AS n FROM ({VECTORS}) GROUP BY 1)
SELECT path, 'float32' AS dtype, 64::BIGINT AS width, n::BIGINT AS height, 'zlib' AS codec, true AS shuffled, (n * 256)::BIGINT AS raw_size, '64:' || n || ':1' AS geometry, 'Float32' AS kind FROM n""")
def xisf_images_and_properties(spark, sf_dir):
    from starframe import sinks
    from starframe.sources import files, xisf

    made = files.from_content(sinks.xisf_images(_vector_rows(spark, sf_dir), "name"))
    cards = xisf.properties(made).groupBy("path", "hdu").agg(F.max(F.when(F.col("key") == "geometry", F.col("value"))).alias("geometry"), F.max(F.when(F.col("key") == "sampleFormat", F.col("value"))).alias("kind"))
    shown = xisf.images(made).select("path", "hdu", "dtype", F.col("naxes")[0].alias("width"), F.col("naxes")[1].alias("height"), "codec", "shuffled", "raw_size")
    return shown.join(cards, ["path", "hdu"]).drop("hdu")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100000")
def tsv_first_rows(spark, sf_dir):
    """The first 100,000 orders by key, written as tab-separated text and read back: the limit is the feature."""
    from starframe import sinks

    at = _folder(spark, "rows")
    sinks.write_rows_tsv(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), at, order=["o_orderkey"])
    return spark.read.option("sep", "\t").option("header", True).schema("o_orderkey bigint, o_totalprice double, o_orderstatus string").csv(at)


@query(ORACLE_SQL["density_events"])
def stored_density(spark, sf_dir):
    """Cells of a plot written as Parquet, in folders by curve, and read back."""
    from starframe import sinks

    at = _folder(spark, "cells")
    made = QUERIES["density_events"](spark, sf_dir)
    sinks.write_results(made, at, ["event_type"])
    return spark.read.parquet(at).select(*(F.col(c).cast(made.schema[c].dataType).alias(c) for c in made.columns))


@query(f"""WITH n AS (SELECT path, count(*) AS n FROM ({VECTORS}) GROUP BY 1) SELECT path, 16::BIGINT AS width, 100::BIGINT AS height, true AS whole FROM n""")
def thumbnail_pictures(spark, sf_dir):
    """A PNG of each image, binned and stretched by itself: its sides, and whether its last chunk is the end mark."""
    from starframe import sinks
    from starframe.sources import files

    cells = images.bin2d(files.image_rows(sinks.fits_images(_vector_rows(spark, sf_dir), "name")), 4, 16, 100, by=["path"])
    made = sinks.thumbnails(cells, stats.auto_stretch(cells, "value", ["path"]), 16, 100, ["path"])
    side = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("bigint")
    return made.select("path", side(17).alias("width"), side(21).alias("height"), F.hex("png").endswith("49454E44AE426082").alias("whole"))


@query(f"""WITH v AS ({VECTORS}), n AS (SELECT path, greatest(4, ceil(count(*) / 16.0))::BIGINT AS f, count(*) AS h FROM v GROUP BY 1),
x AS (SELECT path, y, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM v)
SELECT path, (y // f)::BIGINT AS oy, (x // f)::BIGINT AS ox, round(avg(v), 9) AS value, count(*)::BIGINT AS n FROM x JOIN n USING (path)
WHERE y < h // f * f AND x < 64 // f * f AND y % f IN (f // 4, 3 * f // 4) AND x % f IN (f // 4, 3 * f // 4) GROUP BY 1, 2, 3""")
def preview_of_images(spark, sf_dir):
    """Images of any height, each binned to 16 a side at most from two by two samples of a bin: rows between are not read."""
    from starframe import sinks
    from starframe.sources import files, maps

    listed = sinks.write_files(sinks.fits_images(_vector_rows(spark, sf_dir), "name"), _folder(spark, "images"))
    index = _folder(spark, "units")
    files.scan_hdus(listed).write.parquet(index)
    cells = maps.binned_images(spark.read.parquet(index), 16, 16, 2)
    return cells.select(F.expr(_NAME).alias("path"), "oy", "ox", F.round("value", 9).alias("value"), "n")


@query("""WITH o AS (SELECT (o_orderkey // 4000)::VARCHAR AS path, o_orderkey::DOUBLE AS x, o_totalprice AS y FROM orders), r AS (SELECT path, min(x) AS a, max(x) - min(x) AS span, least(200, count(*)) AS k FROM o GROUP BY 1)
SELECT path, c, min(y::FLOAT)::DOUBLE AS lo, max(y::FLOAT)::DOUBLE AS hi, count(*) AS n FROM (SELECT o.path, greatest(0, least(k - 1, CAST(trunc((x - a) * (k / span)) AS INT)))::INT AS c, y FROM o JOIN r USING (path) WHERE span > 0) GROUP BY 1, 2""")
def catalog_envelope(spark, sf_dir):
    """Curves of stored tables from their list of units in one call; these are small, so all rows are read."""
    from starframe import sinks
    from starframe.sources import files, maps

    listed = sinks.write_files(order_files(spark, sf_dir), _folder(spark, "tables"))
    index = _folder(spark, "units")
    files.scan_hdus(listed).write.parquet(index)
    out = maps.envelope_map(spark.read.parquet(index).where("hdu = 1"), "o_orderkey", "o_totalprice", 200, ("bigint", "double"))
    return out.select(F.expr(_NAME).alias("path"), "c", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "n")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def gzip_table_rows(spark, sf_dir):
    """Tables in gzipped files of two members each, classified and read by what is in them."""
    from starframe import sinks
    from starframe.sources import files

    packed = files.from_content(sinks.gzipped(order_files(spark, sf_dir)))
    return files.table_rows(files.unzipped(packed).where("gz AND format = 'fits' AND error IS NULL"), "o_orderkey bigint, o_totalprice double, o_orderstatus string").drop("path", "_row")


@query("""SELECT (o_orderkey // 4000)::VARCHAR AS path, (count(*) * 2 // 3)::BIGINT AS n_rows, true AS truncated, sum(o_orderkey) FILTER (k < n * 2 // 3)::BIGINT AS keys
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderkey // 4000) AS n FROM orders) GROUP BY o_orderkey // 4000 HAVING count(*) > 1""")
def truncated_tables(spark, sf_dir):
    """Files cut off within a row: the rows before it are read, the unit says that it is truncated, and no job fails."""
    from starframe.sources import files

    rows = read(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 4000).cast("string").alias("path")).agg(F.count("*").alias("n"))
    cut = order_files(spark, sf_dir).join(rows, "path").withColumn("content", F.expr("substring(content, 1, cast(5760 + 21 * (n * 2 DIV 3) + 20 as int))"))
    made = files.from_content(cut)
    sums = files.table_rows(made, "o_orderkey bigint").groupBy("path").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"))
    return files.scan_hdus(made).where("hdu = 1").select("path", "truncated").join(sums, "path")


@query(f"""WITH n AS (SELECT path, count(*) AS n FROM ({VECTORS}) GROUP BY 1), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT 'fits ' || path AS path, 'fits' AS format, 0 AS hdu, 64::BIGINT AS width, n::BIGINT AS pixels FROM n UNION ALL SELECT 'xisf ' || path, 'xisf', 0, 64, n FROM n UNION ALL SELECT 'asdf ' || label, 'asdf', 0, 8, 8 * n FROM c""")
def units_of_all_formats(spark, sf_dir):
    """Files of three formats in one table, told by their first bytes, and their units in one list."""
    from starframe import sinks
    from starframe.sources import files

    rows = _vector_rows(spark, sf_dir)
    cubes = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.col("embedding").alias("values"))
    named = lambda df, kind: df.withColumn("path", F.concat(F.lit(f"{kind} "), "path"))
    made = named(sinks.fits_images(rows, "name"), "fits").unionByName(named(sinks.xisf_images(rows, "name"), "xisf")).unionByName(named(sinks.asdf_cubes(cubes, "label", (8, 8)), "asdf"))
    units = files.hdus_of(cut(files.from_content(made))).where("error is null")
    return units.select("path", "format", "hdu", F.col("naxes")[0].cast("bigint").alias("width"), F.aggregate(F.slice("naxes", 2, 9), F.lit(1).cast("bigint"), lambda a, n: a * n).alias("pixels"))


#: The uniform numbers that dithering uses, and the place that each starts from, in SQL.
DITHER = """g AS (SELECT 0 AS k, 16807::BIGINT AS s UNION ALL SELECT k + 1, s * 16807 % 2147483647 FROM g WHERE k < 9999), u AS (SELECT k, (s / 2147483647.0::DOUBLE)::FLOAT::DOUBLE AS u FROM g)"""


@query(f"""WITH RECURSIVE {DITHER}, v AS (SELECT path, y, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM ({VECTORS})),
t AS (SELECT path, y, v, y // 16 * 2 + x // 32 AS tile, y % 16 * 32 + x % 32 AS place FROM v), f AS (SELECT path, y, v, trunc(b.u * 500)::BIGINT + place AS k FROM t JOIN u AS b ON b.k = tile)
SELECT path, y, round(sum((floor(v * 1024 + u.u) - u.u + 0.5) / 1024), 6) AS total FROM f JOIN u USING (k) GROUP BY 1, 2""")
def quantised_tiles_roundtrip(spark, sf_dir):
    """Images as dithered whole numbers in tiles of byte planes: the same numbers are taken off again."""
    from starframe import sinks
    from starframe.sources import files, tiles

    listed = sinks.write_files(sinks.quantised_images(_vector_rows(spark, sf_dir), "name", 1 / 1024), _folder(spark, "tiles"))
    return _row_sums(tiles.assemble(tiles.decode_tiles(files.scan_hdus(listed))))


@query(f"SELECT * FROM ({ROW_SUMS}), (VALUES ('lz4'), ('zstd'), ('base64'), ('hex')) AS c(stored)")
def xisf_codecs(spark, sf_dir):
    """Images as XISF: shuffled subblocks of two codecs, and samples as text in the header."""
    from starframe import sinks
    from starframe.sources import files, xisf

    rows = _vector_rows(spark, sf_dir)
    made = {c: sinks.xisf_images(rows, "name", codec=c) for c in ("lz4", "zstd")} | {e: sinks.xisf_embedded(rows, "name", e) for e in ("base64", "hex")}
    out = None
    for kind, made_files in made.items():
        own = _row_sums(xisf.pixels(cut(xisf.images(cut(files.from_content(made_files)))))).withColumn("stored", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT label::VARCHAR AS path, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS plane, list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 100))) AS total FROM embeddings""")
def asdf_half_floats(spark, sf_dir):
    """Whole numbers below 2,048 are exact in half precision."""
    from starframe import sinks
    from starframe.sources import asdf, files

    rows = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("float")).alias("values"))
    made = cut(files.from_content(sinks.asdf_cubes(rows, "label", (8, 8), frame=1 << 16, kind="float16")))
    return asdf.pixels(made, cut(asdf.arrays(made))).groupBy("path", "plane").agg(F.sum(F.aggregate("values", F.lit(0.0), lambda a, v: a + v)).alias("total"))


#: Windows of a table, in SQL: number, mixed number; arithmetic of 64 bits is done in 128.
_MIXED = """a AS (SELECT k, (k::UHUGEINT * 11400714819323198485) % 18446744073709551616::UHUGEINT AS z FROM range(16) AS r(k)),
b AS (SELECT k, (xor(z, z // 1073741824) * 13787848793156543929) % 18446744073709551616::UHUGEINT AS z FROM a),
c AS (SELECT k, (xor(z, z // 134217728) * 10723151780598845931) % 18446744073709551616::UHUGEINT AS z FROM b), m AS (SELECT k, xor(z, z // 2147483648) AS z FROM c)"""


@query(f"""WITH {_MIXED}, t AS (SELECT (o_orderkey // 4000)::VARCHAR AS path, count(*) AS n, count(*) * 21 // 16 AS part FROM orders GROUP BY o_orderkey // 4000),
p AS (SELECT path, n, greatest(5760, (5760 + part * k + (z % (part - 63)::UHUGEINT)::BIGINT) // 64 * 64) AS o FROM t, m WHERE n >= 16),
w AS (SELECT path, n, (o - 5760 + 20) // 21 AS a, (o + 64 - 5760) // 21 AS b FROM p)
SELECT path, least(a, n)::BIGINT AS low, least(greatest(b, a + 1), n)::BIGINT AS high, true AS sampled FROM w WHERE least(greatest(b, a + 1), n) > least(a, n) UNION ALL SELECT path, 0, n, false FROM t WHERE n < 16""")
def sampled_windows(spark, sf_dir):
    """The windows that stand for each table, chosen from the stored list of units: here sixteen of 64 bytes for each, whatever its size."""
    from starframe import sinks
    from starframe.sources import files, planned

    listed = sinks.write_files(order_files(spark, sf_dir), _folder(spark, "tables"))
    index = _folder(spark, "units")
    files.scan_hdus(listed).write.parquet(index)
    out = planned.table_windows(spark.read.parquet(index).where("hdu = 1"), windows=16, window_bytes=64, read_all=0)
    return out.select(F.expr(_NAME).alias("path"), "low", "high", "sampled")
