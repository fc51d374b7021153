"""Curves over a swept parameter K: aggregation, normalisation, cost, minima and zero crossings.

All functions work on many sweeps at once: `by` names a sweep (it may be
empty), k is the parameter's column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import ranks, robust
from sensorloom.operators.series import HERE, PAST, over
from sensorloom.sources.shared import materialise

#: Weights of the composite cost in use by default.
DEFAULT_WEIGHTS = {"rise_error_area": 1.0, "overshoot": 2.0, "undershoot": 2.0, "tail_area": 1.0, "plateau_slope": 0.5, "rise_delay": 1.0, "fall_delay": 1.0, "settling_time": 0.5}
#: Metrics that count from zero up in the cost.
CLIPPED = ("overshoot", "undershoot")


def per_k(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, k, metric): n, median, mad, iqr of long-form values."""
    return robust.mad(long, [*by, "k", "metric"], value)


def normalise(medians: DataFrame, by: list[str], scale: str = "p90") -> DataFrame:
    """Adds `normalised`: the median over the metric's scale across K, which is the 90th percentile of magnitudes, or
    their maximum where that percentile is at most a twentieth of it (or always, with scale='max'); null if zero."""
    size = F.abs("median")
    scales = medians.groupBy(*by, "metric").agg(F.percentile(size, 0.9).alias("_p90"), F.max(size).alias("_max"))
    chosen = F.col("_max") if scale == "max" else F.when(F.col("_p90") <= 0.05 * F.col("_max"), F.col("_max")).otherwise(F.col("_p90"))
    scales = scales.select(*by, "metric", F.when(chosen > 0, chosen).alias("_scale"))
    return medians.join(scales, [*by, "metric"]).withColumn("normalised", F.col("median") / F.col("_scale")).drop("_scale")


def cost(normalised: DataFrame, by: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(by, k, cost): the weighted sum; null unless every metric with a weight has a value."""
    weights = {m: w for m, w in (weights or DEFAULT_WEIGHTS).items() if w}
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    value = F.when(F.col("metric").isin(*CLIPPED), F.greatest(F.col("normalised"), F.lit(0.0))).otherwise(F.col("normalised"))
    used = normalised.withColumn("_w", F.try_element_at(given, F.col("metric"))).where("_w is not null")
    # greatest() skips nulls, so a null has to be kept by hand
    used = used.withColumn("_v", F.when(F.col("normalised").isNotNull(), value))
    return used.groupBy(*by, "k").agg(F.when(F.count("_v") == len(weights), F.sum(F.col("_w") * F.col("_v"))).alias("cost"))


def argmin_parabolic(curve: DataFrame, by: list[str], y: str, out: str = "k_opt") -> DataFrame:
    """K at the least value, the first among equals, refined by the parabola through its neighbours and held between
    them; as it stands at an end or where the parabola doesn't open upwards.  Sweeps without a value give no row."""
    valid = curve.where(F.col(y).isNotNull() & ~F.isnan(F.col(y)))
    w = over(by, "k")
    around = valid.select(*by, "k", F.col(y).alias("_y1"), F.lag("k").over(w).alias("_x0"), F.lag(y).over(w).alias("_y0"), F.lead("k").over(w).alias("_x2"), F.lead(y).over(w).alias("_y2"))
    at = around.groupBy(*by).agg(F.min_by(F.struct("_x0", "_y0", F.col("k").alias("_x1"), "_y1", "_x2", "_y2"), F.struct("_y1", "k")).alias("_m")).select(*by, "_m.*")
    d1, d2 = (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0")), (F.col("_y2") - F.col("_y1")) / (F.col("_x2") - F.col("_x1"))
    a = (d2 - d1) / (F.col("_x2") - F.col("_x0"))
    vertex = (F.col("_x0") + F.col("_x1")) / 2 - F.try_divide(d1, 2 * a)
    k = F.when(F.col("_x0").isNull() | F.col("_x2").isNull() | (a <= 0), F.col("_x1")).otherwise(F.greatest(F.col("_x0"), F.least(F.col("_x2"), vertex)))
    return at.select(*by, k.alias(out))


def linear_zero(curve: DataFrame, by: list[str], y: str) -> DataFrame:
    """k_opt, slope, intercept, r2 of a straight line; no row below two points, for one K only, or for a level line."""
    valid = curve.where(F.col(y).isNotNull() & ~F.isnan(F.col(y)))
    x, v = F.col("k").cast("double"), F.col(y).cast("double")
    fit = valid.groupBy(*by).agg(F.regr_slope(v, x).alias("slope"), F.regr_intercept(v, x).alias("intercept"), F.regr_r2(v, x).alias("_r2"), F.count(v).alias("n"), F.var_pop(v).alias("_var"))
    fit = fit.where("n >= 2 and slope is not null and slope <> 0")
    return fit.select(*by, F.try_divide(-F.col("intercept"), F.col("slope")).alias("k_opt"), "slope", "intercept", F.when(F.col("_var") == 0, 1.0).otherwise(F.col("_r2")).alias("r2"))


def quadratic_zero(curve: DataFrame, by: list[str], y: str) -> DataFrame:
    """k_opt where a parabola descends through zero, with quad, slope, intercept, r2 and method.

    Falls back to linear_zero() below four points or three K, for a parabola
    that is flat, has no roots, or none that descends within the range and a
    fifth of it on either side.
    """
    valid = curve.where(F.col(y).isNotNull() & ~F.isnan(F.col(y))).select(*by, F.col("k").cast("double").alias("_k"), F.col(y).cast("double").alias("_y"))
    centre = valid.groupBy(*by).agg(F.avg("_k").alias("_c"), F.count("_k").alias("_n"), F.countDistinct("_k").alias("_nk"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.max(F.abs("_y")).alias("_top"))
    x = F.col("_k") - F.col("_c")
    keys = by or ["_one"]
    if not by:
        valid, centre = valid.withColumn("_one", F.lit(1)), centre.withColumn("_one", F.lit(1))
    joined = valid.join(centre, keys)
    sums = joined.groupBy(*keys, "_c", "_n", "_nk", "_lo", "_hi", "_top").agg(*[F.sum(x**p).alias(f"_s{p}") for p in (1, 2, 3, 4)], *[F.sum(x**p * F.col("_y")).alias(f"_t{p}") for p in (0, 1, 2)], F.sum(F.col("_y") ** 2).alias("_yy"))
    s0, (s1, s2, s3, s4), (t0, t1, t2) = F.col("_n"), (F.col(f"_s{p}") for p in (1, 2, 3, 4)), (F.col(f"_t{p}") for p in (0, 1, 2))
    det = s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = F.try_divide(t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0), det)
    b = F.try_divide(s4 * (t1 * s0 - t0 * s1) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2), det)
    c = F.try_divide(s4 * (s2 * t0 - s1 * t1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2), det)
    fit = sums.withColumns({"_a": a, "_b": b, "_cc": c})
    # back from the centred variable
    fit = fit.withColumns({"quad": F.col("_a"), "slope": F.col("_b") - 2 * F.col("_a") * F.col("_c"), "intercept": F.col("_cc") - F.col("_b") * F.col("_c") + F.col("_a") * F.col("_c") ** 2})
    disc = F.col("_b") ** 2 - 4 * F.col("_a") * F.col("_cc")
    # of a parabola's roots the descending one is (-b - sqrt(disc)) / 2a, whichever way it opens
    root = F.col("_c") + F.try_divide(-F.col("_b") - F.sqrt(F.greatest(disc, F.lit(0.0))), 2 * F.col("_a"))
    span = F.col("_hi") - F.col("_lo")
    size = F.greatest(F.abs("slope") * span, F.abs("intercept"), F.col("_top"))
    sse = F.col("_yy") - F.col("_a") * t2 - F.col("_b") * t1 - F.col("_cc") * t0
    sst = F.col("_yy") - t0 * t0 / s0
    good = (F.col("_n") >= 4) & (F.col("_nk") >= 3) & (F.abs("_a") * span * span > 1e-10 * size) & (disc > 0) & (root >= F.col("_lo") - 0.2 * span) & (root <= F.col("_hi") + 0.2 * span)
    quad = fit.where(good).select(*keys, root.alias("k_opt"), "quad", "slope", "intercept", F.when(sst > 0, 1 - sse / sst).otherwise(1.0).alias("r2"), F.lit("quadratic").alias("method"))
    line = linear_zero(curve, by, y)
    if not by:
        line = line.withColumn("_one", F.lit(1))
    line = line.join(quad, keys, "left_anti").select(*keys, "k_opt", F.lit(None).cast("double").alias("quad"), "slope", "intercept", "r2", F.lit("linear").alias("method"))
    return quad.unionByName(line).drop("_one")


def theil_sen_zero(curve: DataFrame, by: list[str], y: str, half_window: int = 5) -> DataFrame:
    """k_opt of a robust line around the sign change: the median of pairwise slopes over the half_window points on
    either side of the fall through zero nearest the median of them all; linear_zero() where there is none."""
    keys = by or ["_one"]
    curve = curve if by else curve.withColumn("_one", F.lit(1))
    w = over(keys, "k")
    valid = curve.where(F.col(y).isNotNull() & ~F.isnan(F.col(y))).select(*keys, F.col("k").cast("double").alias("k"), F.col(y).cast("double").alias("_y")).withColumn("_i", F.row_number().over(w) - 1)
    flips = valid.withColumn("_next", F.lead("_y").over(w)).where("_y > 0 and _next <= 0")
    mid = flips.groupBy(*keys).agg(F.median("k").alias("_mid"))
    cross = flips.join(mid, keys).groupBy(*keys).agg(F.min_by("_i", F.struct(F.abs(F.col("k") - F.col("_mid")), F.col("_i"))).alias("_cross"))
    local = valid.join(cross, keys).where((F.col("_i") > F.col("_cross") - half_window) & (F.col("_i") <= F.col("_cross") + half_window))
    other = local.select(*keys, F.col("_i").alias("_j"), F.col("k").alias("_k2"), F.col("_y").alias("_y2"))
    slopes = local.join(other, keys).where("_i < _j and k <> _k2").groupBy(*keys).agg(F.median((F.col("_y2") - F.col("_y")) / (F.col("_k2") - F.col("k"))).alias("slope"))
    line = local.join(slopes, keys).groupBy(*keys, "slope").agg(F.median(F.col("_y") - F.col("slope") * F.col("k")).alias("intercept"), F.min("k").alias("_lo"), F.max("k").alias("_hi"), F.count("k").alias("_n"))
    line = line.where("_n >= 3 and slope <> 0")
    found = line.select(*keys, F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.try_divide(-F.col("intercept"), F.col("slope")))).alias("k_opt"), "slope", "intercept", F.lit("theil_sen_local").alias("method"))
    rest = linear_zero(curve, keys, y).join(found, keys, "left_anti").select(*keys, "k_opt", "slope", "intercept", F.lit("linear").alias("method"))
    return found.unionByName(rest).drop("_one")


def first_zero(curve: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Where the sign first differs from that of the first value, linearly interpolated; no row if it never does."""
    w = over(by, x)
    valid = curve.where(F.col(y).isNotNull() & ~F.isnan(F.col(y))).withColumn("_s0", F.signum(F.first(y).over(w.rowsBetween(PAST, HERE)))).withColumn("_x0", F.lag(x).over(w)).withColumn("_y0", F.lag(y).over(w))
    crossed = valid.where((F.signum(y) != F.col("_s0")) & F.col("_x0").isNotNull())
    at = F.col("_x0") + (F.col(x) - F.col("_x0")) * F.try_divide(-F.col("_y0"), F.col(y) - F.col("_y0"))
    return crossed.withColumn("_at", at).groupBy(*by).agg(F.min_by("_at", x).alias("k_zero"))


def per_metric_minima(normalised: DataFrame, by: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """argmin_parabolic() of each metric that has a weight."""
    used = [m for m, w in (weights or DEFAULT_WEIGHTS).items() if w]
    return argmin_parabolic(normalised.where(F.col("metric").isin(*used)), [*by, "metric"], "normalised")


def histogram(df: DataFrame, by: list[str], col: str, bins: int = 30) -> DataFrame:
    """(by, bin, n): counts of equal bins between a group's least and largest value; the last bin holds its upper edge."""
    ends = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.lit(True))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.join(ends, same).withColumn("bin", at).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_minima(values: DataFrame, by: list[str], draws: int, index: Column, weights: dict[str, float], value: str = "value", rescale: str | None = None) -> DataFrame:
    """k_opt per draw: in each draw every K's i-th value (of n, both from 0) is replaced by its index-th, where `index`
    is an expression over draw, i and n; medians, their scale, cost and minimum follow.  The scale is that of the undrawn
    medians' maximum for all draws, or each draw's own by normalise()'s rule `rescale`."""
    place = [*by, "k", "n"]  # metrics of as many values share their picks
    packed = materialise(values.groupBy(*place, "i").agg(F.collect_list(F.struct("metric", F.col(value).alias("value"))).alias("_values")), "values")
    picks = packed.select(*place, "i", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select(*place, index.alias("i"), "draw").where("i is not null")
    # a place's draws are gathered where they meet: one row for each place, whatever the number of draws
    taken = picks.repartition(*place, "i").groupBy(*place, "i").agg(F.collect_list("draw").alias("_draws"))
    picked = materialise(ranks.joined(packed, taken, [*place, "i"]).drop("i", "n"), "picked")
    each = picked.select(*by, "k", F.explode("_values").alias("_v"), "_draws").select(*by, "k", "_v.*", F.explode("_draws").alias("draw"))
    medians = materialise(ranks.median(each, [*by, "draw", "k", "metric"], "value"), "draws")
    if rescale:
        medians = normalise(medians, [*by, "draw"], rescale)
    else:
        undrawn = ranks.median(packed.select(*by, "k", F.explode("_values").alias("_v")).select(*by, "k", "_v.*"), [*by, "k", "metric"], "value", "_m").groupBy(*by, "metric").agg(F.max(F.abs("_m")).alias("_scale"))
        medians = medians.join(undrawn, [*by, "metric"]).withColumn("normalised", F.when(F.col("_scale") > 0, F.col("median") / F.col("_scale")))
    return argmin_parabolic(cost(medians, [*by, "draw"], weights), [*by, "draw"], "cost")


def spread(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, median, sample deviation, least, most, 5th and 95th percentile, and interquartile range."""
    return df.agg(
        F.avg(col).alias("mean"), F.median(col).alias("median"), F.stddev_samp(col).alias("std"), F.min(col).alias("least"), F.max(col).alias("most"),
        F.percentile(col, 0.05).alias("p05"), F.percentile(col, 0.95).alias("p95"), (F.percentile(col, 0.75) - F.percentile(col, 0.25)).alias("iqr"),
    )
