"""Robust aggregates: medians, deviations, areas, extremes, coverage and dropouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import ranks
from sensorloom.operators.series import interval_join, over
from sensorloom.sources.shared import materialise

#: Makes a median absolute deviation estimate the standard deviation of normal data.
MAD_SCALE = 1.4826


def mad(df: DataFrame, by: list[str], col: str, fall_back: bool = False) -> DataFrame:
    """n, median, scaled mad, iqr (null below two values) per group; with `fall_back` a mad of zero becomes the
    population deviation.  Nulls and NaN count as missing, a null key is a group; groups may be of any size."""
    clean = df.select(*by, F.when(~F.isnan(F.col(col).cast("double")), F.col(col).cast("double")).alias("_v"))
    centre = ranks.percentiles(clean, by, "_v", {"median": 0.5, "_p25": 0.25, "_p75": 0.75}, "n")
    if fall_back:
        centre = ranks.joined(centre, clean.groupBy(*by).agg(F.stddev_pop("_v").alias("_std")), by)
    centre = materialise(centre, "centres")
    away = ranks.joined(clean, centre.select(*by, "median"), by).select(*by, F.abs(F.col("_v") - F.col("median")).alias("_v"))
    scaled = MAD_SCALE * F.col("_mad")
    if fall_back:
        scaled = F.when(scaled > 0, scaled).otherwise(F.coalesce("_std", F.lit(0.0)))
    around = ranks.joined(centre, ranks.median(away, by, "_v", "_mad"), by)
    return around.select(*by, "n", "median", scaled.alias("mad"), F.when(F.col("n") >= 2, F.col("_p75") - F.col("_p25")).alias("iqr"))


def mad_of_sorted(df: DataFrame, held: str) -> DataFrame:
    """mad()'s n, median, mad and iqr of each row's sorted array `held`, in its place."""
    own = [c for c in df.columns if c != held]

    def at(values: Column, p: float) -> Column:
        x = F.lit(p) * (F.size(values) - 1)
        low, high = F.floor(x).cast("int"), F.ceil(x).cast("int")
        return F.when(low == high, F.get(values, low)).otherwise((high - x) * F.get(values, low) + (x - low) * F.get(values, high))

    df = df.withColumn("n", F.size(held).cast("long")).withColumn("median", at(F.col(held), 0.5))
    df = df.withColumn("_away", F.sort_array(F.transform(held, lambda v: F.abs(v - F.col("median")))))
    return df.select(*own, "n", "median", (MAD_SCALE * at(F.col("_away"), 0.5)).alias("mad"), F.when(F.col("n") >= 2, at(F.col(held), 0.75) - at(F.col(held), 0.25)).alias("iqr"))


def trapezoid(df: DataFrame, by: list[str], order: list[str], t: str, v: str, out: str = "area", absolute: bool = False) -> DataFrame:
    """The area under each series; null for a single point."""
    y = F.abs(F.col(v)) if absolute else F.col(v)
    w = over(by, *order)
    step = (y + F.lead(y).over(w)) / 2 * (F.lead(t).over(w) - F.col(t))
    return df.withColumn("_a", step).groupBy(*by).agg(F.sum("_a").alias(out))


def corrected_peak(level: Column, value: Column, sigma: Column) -> Column:
    """The largest value over a level, less what noise alone would add: sigma * sqrt(2 ln n).  An aggregate."""
    n = F.greatest(F.count(value), F.lit(2)).cast("double")
    return F.max(value) - level - sigma * F.sqrt(2 * F.log(n))


def first_extreme(t: str, v: str, largest: bool = True) -> Column:
    """The time of the extreme value, the earliest among equals.  An aggregate."""
    return F.min_by(t, F.struct((-F.col(v) if largest else F.col(v)).alias("v"), F.col(t).alias("t")))


def drift(df: DataFrame, by: list[str], order: list[str], v: str) -> DataFrame:
    """Per group: mean, population std, drift (mean of the later half less that of the earlier), n."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*by)), F.row_number().over(over(by, *order)) - 1
    half = df.withColumn("_late", i >= F.floor(n / 2))
    late, early = F.avg(F.when(F.col("_late"), F.col(v))), F.avg(F.when(~F.col("_late"), F.col(v)))
    return half.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), (late - early).alias("drift"), F.count(F.lit(1)).alias("n"))


def sample_rate(df: DataFrame, by: list[str], order: list[str], t: str) -> DataFrame:
    """Three rates in use: steps over the span, one over the median step, rows over the span."""
    step = df.withColumn("_dt", F.col(t) - F.lag(t).over(over(by, *order)))
    n, span = F.count(F.lit(1)), F.max(t) - F.min(t)
    return step.groupBy(*by).agg(F.try_divide(n - 1, span).alias("rate_steps"), F.try_divide(F.lit(1.0), F.median("_dt")).alias("rate_median"), F.try_divide(n, span).alias("rate_rows"))


def coverage(n: Column, lo: Column, hi: Column, rate: Column) -> Column:
    """The share of a window's expected samples that are there, at most one."""
    expected = F.greatest(F.lit(1.0), (hi - lo) * F.greatest(rate, F.lit(1.0)))
    return F.least(F.lit(1.0), n / expected)


def dropouts(df: DataFrame, by: list[str], order: list[str], t: str, v: str, factor: float = 10.0, least_gap: float = 0.05, jump: float = 0.5, spread: float = 50.0, least_n: int = 10) -> DataFrame:
    """Rows after a gap longer than `factor` median steps and `least_gap` over which the value jumps by more than `jump`
    of the series' 10-90 % spread; series of small spread or few rows have none."""
    w = over(by, *order)
    steps = df.withColumn("_dt", F.col(t) - F.lag(t).over(w)).withColumn("_dv", F.abs(F.col(v) - F.lag(v).over(w)))
    stats = steps.groupBy(*by).agg(F.median("_dt").alias("_mid"), (F.percentile(v, 0.9) - F.percentile(v, 0.1)).alias("_spread"), F.count(F.lit(1)).alias("_n"))
    found = steps.join(stats, by).where((F.col("_n") >= least_n) & (F.col("_spread") > spread) & (F.col("_dt") > F.greatest(factor * F.col("_mid"), F.lit(least_gap))) & (F.col("_dv") > jump * F.col("_spread")))
    return found.withColumnsRenamed({"_dt": "gap", "_dv": "jump"}).drop("_mid", "_spread", "_n")


def finite(df: DataFrame, *cols: str) -> DataFrame:
    """Drops rows with a null, NaN or infinite value in any of the columns."""
    for c in cols:
        x = F.col(c).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df


def plateau_levels(signal: DataFrame, transitions: DataFrame, by: list[str], t: str, v: str, direction: str, within: list[str] | None = None, settle: float = 0.15, least_n: int = 4, least: int = 4, width: float = 1.0) -> DataFrame:
    """(by, slow, fast, n_slow, n_fast): the median of the medians of the legs after falls and after rises.

    A leg reaches from `settle` after a transition to the next one of its series (by, within); legs of fewer than
    `least_n` samples don't count, and a run with fewer than `least` legs of a kind gives no row.
    """
    keys = [*by, *(within or [])]
    legs = transitions.select(*keys, F.col(direction).alias("_dir"), (F.col(t) + settle).alias("_lo"), F.lead(t).over(over(keys, t)).alias("_hi")).where("_lo < _hi")
    inside = interval_join(signal.select(*keys, t, v), legs, keys, t, "_lo", "_hi", width, closed=False)
    each = inside.groupBy(*keys, "_lo", "_dir").agg(F.median(v).alias("_m"), F.count(v).alias("_n")).where(F.col("_n") >= least_n)
    rises, falls = F.col("_dir") > 0, F.col("_dir") <= 0
    levels = each.groupBy(*by).agg(F.median(F.when(falls, F.col("_m"))).alias("slow"), F.median(F.when(rises, F.col("_m"))).alias("fast"), F.count_if(falls).alias("n_slow"), F.count_if(rises).alias("n_fast"))
    return levels.where((F.col("n_slow") >= least) & (F.col("n_fast") >= least))
