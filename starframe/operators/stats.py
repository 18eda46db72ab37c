"""Order statistics, stretches, plot ranges and data quality, each a distributed aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starframe.functions.scalar import is_finite
from starframe.functions.shared import cut
from starframe.operators import _groups as G

#: Groups of so many values at most are sorted, each in a task; larger ones are counted by digits.
SORTED = 1 << 20
#: Bits of a digit: a group has 65,536 counters in a pass.
DIGIT = 16


def order_key(v: Column) -> Column:
    """A whole number (64 bits) for each finite double, in the same order; the two zeros are one.

    Exponent and fraction are taken apart by exact arithmetic: powers of two and what they divide have no rounding.
    """
    a = F.abs(v)
    two = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(a)).cast("int")
    exponent = near + F.when(a >= 2 * two(near), 1).otherwise(0) - F.when(a < two(near), 1).otherwise(0)
    normal = (exponent + 1023).cast("long") * (1 << 52) + ((a / two(exponent) - 1) * float(1 << 52)).cast("long")
    bits = F.when(a == 0, 0).when(a < 2.0**-1022, (a * 2.0**537 * 2.0**537).cast("long")).otherwise(normal)
    return F.when(v < 0, -bits).otherwise(bits).cast("long")


def nearest_rank(p: float):
    """Rank (from 0) of a percentile: p * (n - 1) rounded, without interpolation."""
    return lambda n: F.floor(F.lit(float(p)) * (n - 1) + 0.5).cast("bigint")


def middle(n: Column) -> Column:
    """The median's rank in automatic stretches: n / 2, cut."""
    return F.floor(n / 2).cast("bigint")


def order_stats(df: DataFrame, value: str, ranks: dict, by: list[str] = (), sort_up_to: int | None = None) -> DataFrame:
    """Per group: n, vmin, vmax and the values at some ranks (name: function of n), over finite values.

    Exact.  Where all groups have ``sort_up_to`` values (SORTED) at most, which is counted first, values are ranked by a window.  Else no group is sorted: values
    become 64-bit numbers in the same order, and four passes find 16 bits each of the numbers at the ranks, by counting the digits that
    follow what is known.  So whatever the distribution, a group of any size costs four map-side aggregates of 65,536 counters.
    """
    df, by = G.keys(df, list(by))
    base = df.where(is_finite(F.col(value))).select(*by, F.col(value).cast("double").alias("_v"))
    # What is kept between the passes has a row or a few for each group.
    whole = cut(base.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("vmin"), F.max("_v").alias("vmax")))
    names = list(ranks)
    ranked = {k: F.greatest(F.lit(0).cast("bigint"), F.least(r(F.col("n")), F.col("n") - 1)) for k, r in ranks.items()}
    if (whole.agg(F.max("n")).first()[0] or 0) <= (SORTED if sort_up_to is None else sort_up_to):
        at = F.row_number().over(Window.partitionBy(*by).orderBy("_v")) - 1
        rows = base.withColumns({"_at": at, "n": F.count("*").over(Window.partitionBy(*by))})
        found = rows.groupBy(*by).agg(F.max("n").alias("n"), F.min("_v").alias("vmin"), F.max("_v").alias("vmax"), *(F.max(F.when(F.col("_at") == k, F.col("_v"))).alias(name) for name, k in ranked.items()))
        return cut(G.tidy(found))
    wanted = F.array(*(F.struct(F.lit(k).alias("_rank"), ranked[k].alias("_k")) for k in names))
    zero = F.lit(0).cast("long")
    # _p: what is known of the number at a rank, its leading digits; _k: the rank among the numbers that begin so.
    target = cut(whole.select(*by, F.inline(wanted)).withColumn("_p", zero))
    keyed = base.withColumn("_key", order_key(F.col("_v")))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        known = F.shiftright("_key", shift + DIGIT) if shift + DIGIT < 64 else zero
        own = keyed.withColumns({"_p": known, "_q": F.shiftright("_key", shift)})
        inside = G.attach(own, target.select(*by, "_p").distinct(), [*by, "_p"])
        counts = inside.groupBy(*by, "_p", "_q").agg(F.count("*").alias("_c"), F.min("_v").alias("_value"))
        order = Window.partitionBy(*by, "_p").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_from", F.col("_to") - F.col("_c"))
        at = G.same("t", "c", [*by, "_p"]) & (F.col("t._k") >= F.col("c._from")) & (F.col("t._k") < F.col("c._to"))
        found = target.alias("t").join(counts.alias("c"), at).select(*(F.col(f"t.{b}") for b in by), "t._rank", (F.col("t._k") - F.col("c._from")).alias("_k"), F.col("c._q").alias("_p"), "c._value")
        target = cut(found)
    wide = target.groupBy(*by).agg(*(F.max(F.when(F.col("_rank") == k, F.col("_value"))).alias(k) for k in names))
    return cut(G.tidy(G.attach(whole, wide, by)))


def kth(df: DataFrame, value: str, k: int, by: list[str] = ()) -> DataFrame:
    """The value of rank k (from 0, at most the last) among finite values, by group."""
    return order_stats(df, value, {"kth": lambda n: F.lit(k).cast("bigint")}, by)


def percentile(df: DataFrame, value: str, p: float, by: list[str] = ()) -> DataFrame:
    return order_stats(df, value, {"percentile": nearest_rank(p)}, by)


def _mad(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: n, vmin, vmax, med, mad."""
    med = order_stats(df, value, {"med": middle}, by)
    off = G.attach(df.where(is_finite(F.col(value))), med.select(*by, "med"), by)
    mad = order_stats(off.withColumn("_off", F.abs(F.col(value).cast("double") - F.col("med"))), "_off", {"mad": middle}, by).select(*by, "mad")
    return cut(G.attach(med, mad, by))


def _map(lo: Column, hi: Column) -> tuple[Column, Column]:
    """c0 and inv of a linear map from lo..hi to 0..1."""
    inv = 1 / F.nullif(hi - lo, F.lit(0.0))
    bad = inv.isNull() | ~is_finite(inv) | (inv == 0)
    return F.when(bad, lo - 1).otherwise(lo), F.when(bad, 0.5).otherwise(inv)


def _finish(df: DataFrame, by: list[str], lo: Column, hi: Column, m: Column, sigma: Column) -> DataFrame:
    flat = ~(F.col("vmax") > F.col("vmin"))
    c0, inv = _map(lo, hi)
    return df.select(
        *by, "n", "vmin", "vmax",
        F.when(flat, F.col("vmin")).otherwise(F.col("med")).alias("median"), F.when(flat, 0.0).otherwise(sigma).alias("sigma"),
        F.when(flat, F.col("vmin")).otherwise(lo).alias("black"), F.when(flat, F.col("vmax")).otherwise(hi).alias("white"),
        F.when(flat, F.col("vmin") - 1).otherwise(c0).alias("c0"), F.when(flat, 0.5).otherwise(inv).alias("inv"), F.when(flat, 0.5).otherwise(m).alias("m"),
    )


def auto_stretch(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """The automatic stretch by group: black at 2.8 sigma below the median (sigma from the MAD), and the midtones balance that puts
    the median at a quarter.  Where over half the values are equal, they are left out if 16 others remain."""
    by = list(by)
    first = _mad(df, value, by)
    quiet = first.where(F.col("mad") == 0).select(*by, F.col("med").alias("_med"))
    rest = G.attach(df, quiet, by).where(is_finite(F.col(value)) & (F.col(value) != F.col("_med")))
    # Most often no group is so: then the second look has nothing to read.
    again = first.limit(0) if quiet.isEmpty() else _mad(rest.drop("_med"), value, by).where("n >= 16")
    again = again.select(*by, F.col("med").alias("med2"), F.col("mad").alias("mad2"))
    if by:
        joined = first.alias("l").join(again.alias("r"), G.same("l", "r", by), "left").select("l.*", "r.med2", "r.mad2")
    else:
        row = again.first()
        joined = first.withColumns({c: F.lit(row[c] if row else None).cast("double") for c in ("med2", "mad2")})
    joined = joined.withColumn("med", F.coalesce("med2", "med")).withColumn("mad", F.coalesce("mad2", "mad")).drop("med2", "mad2")
    sigma = 1.4826 * F.col("mad")
    some = F.col("mad") > 0
    lo = F.when(some, F.greatest(F.col("vmin"), F.col("med") - 2.8 * sigma)).otherwise(F.col("vmin"))
    x0 = (F.col("med") - lo) / F.nullif(F.col("vmax") - lo, F.lit(0.0))
    m = F.when(some & (x0 < 0.25), F.greatest(3 * x0 / (2 * x0 + 1), F.lit(1e-12))).otherwise(0.5)
    return _finish(joined, by, lo, F.col("vmax"), m, sigma)


def linear_stretch(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Between the 0.5 and 99.5 percentiles, or the extremes if these are equal."""
    s = order_stats(df, value, {"med": nearest_rank(0.5), "p0": nearest_rank(0.005), "p1": nearest_rank(0.995)}, by)
    ok = F.col("p1") > F.col("p0")
    return _finish(s, list(by), F.when(ok, F.col("p0")).otherwise(F.col("vmin")), F.when(ok, F.col("p1")).otherwise(F.col("vmax")), F.lit(0.5), F.lit(0.0))


def minmax_stretch(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    s = order_stats(df, value, {"med": nearest_rank(0.5)}, by)
    return _finish(s, list(by), F.col("vmin"), F.col("vmax"), F.lit(0.5), F.lit(0.0))


def plot_range(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Range of a y axis: the extremes, or the 0.1 and 99.9 percentiles where these span under a fifth of that; padded."""
    s = order_stats(df, value, {"p0": nearest_rank(0.001), "p1": nearest_rank(0.999)}, by)
    tight = F.col("p1") - F.col("p0") < 0.2 * (F.col("vmax") - F.col("vmin"))
    s = s.withColumn("_lo", F.when(tight, F.col("p0")).otherwise(F.col("vmin"))).withColumn("_hi", F.when(tight, F.col("p1")).otherwise(F.col("vmax")))
    pad = (F.col("_hi") - F.col("_lo")) * 0.05
    pad = F.when(pad > 0, pad).when(F.abs("_hi") > 0, F.abs("_hi") * 0.1).otherwise(1.0)
    return s.select(*by, "n", (F.col("_lo") - pad).alias("y_min"), (F.col("_hi") + pad).alias("y_max"))


def data_quality(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Per group: rows, valid (finite) ones, whether some are missing, whether all are."""
    ok = is_finite(F.col(value))
    df, by = G.keys(df, list(by))
    return G.tidy(df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.bool_or(~ok).alias("has_missing"), (F.count_if(ok) == 0).alias("empty")))


def render_stats(df: DataFrame, level: str, by: list[str] = (), transparent: str | None = None) -> DataFrame:
    """Per group of 8-bit levels: median level (the first at which twice the running count reaches the number of opaque cells)
    and the share of transparent cells (null levels, or those marked)."""
    gone = F.col(level).isNull() if transparent is None else F.coalesce(F.col(transparent), F.lit(False)) | F.col(level).isNull()
    df, by = G.keys(df, list(by))
    share = df.groupBy(*by).agg((F.count_if(gone) / F.count("*")).alias("transparent"))
    counts = df.where(~gone).groupBy(*by, level).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    run = whole.orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_run", F.sum("_c").over(run)).withColumn("_n", F.sum("_c").over(whole))
    median = ranked.where(F.col("_run") * 2 >= F.col("_n")).groupBy(*by).agg(F.min(level).alias("median_level"), F.max("_n").alias("opaque"))
    return G.tidy(share.alias("l").join(median.alias("r"), G.same("l", "r", by), "left").select("l.*", "r.median_level", F.coalesce("r.opaque", F.lit(0)).alias("opaque")))
