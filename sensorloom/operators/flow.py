"""Flow sweeps: where does steady force leave its power law?  All in DataFrame operations, for many runs at once.

Inputs: force (run_id, seq, t, v) and levels (run_id, level_idx, level, dwell_s, n_levels, settle_frac).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import robust, series
from sensorloom.operators.series import over
from sensorloom.sources.shared import materialise

RUN = ["run_id"]


def breakdown(levels: DataFrame, by: list[str], n_sigma: float = 4.0, rel_tol: float = 0.10, var_factor: float = 3.0, collapse: float = 0.15, derate: float = 0.15) -> DataFrame:
    """Markers per run over (level, mean, std, predicted, sigma), predicted and sigma null where there is no fit.

    deviation_level: the first of two levels in a row, above the fitted ones,
    whose mean exceeds the law by max(n_sigma * sigma, rel_tol of it).
    variance_onset: the first whose std exceeds var_factor quiet medians.
    collapse_level: the first after the peak that falls short of it by more than
    `collapse`.  recommended: the earlier of the first two, else the third, less
    the derating (two decimals, ties to even), else the top level.  Fewer than four levels: nulls.
    """
    w = over(by, "level")
    whole = Window.partitionBy(*by)
    valid = levels.where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    num = valid.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(whole))
    num = num.withColumn("_f", fit_count(F.col("_m")))
    clean = F.when(~F.isnan("std"), F.col("std"))
    num = num.withColumn("_quiet", F.median(F.when((F.col("_i") <= F.col("_f")) & (clean > 0), clean)).over(whole))
    num = num.withColumn("_peak", F.max("mean").over(whole)).withColumn("_pi", F.min(F.when(F.col("mean") == F.col("_peak"), F.col("_i"))).over(whole))
    over_fit = F.col("_i") > F.col("_f")
    band = F.greatest(n_sigma * F.col("sigma"), rel_tol * F.abs("predicted"))
    num = num.withColumn("_exceeds", F.coalesce(over_fit & (F.col("mean") - F.col("predicted") > band), F.lit(False)))
    num = num.withColumn("_before", F.lag("_exceeds").over(w)).withColumn("_level0", F.lag("level").over(w))
    found = num.groupBy(*by).agg(
        F.first("_m").alias("n_levels"),
        F.min(F.when(F.col("_exceeds") & F.col("_before"), F.col("_level0"))).alias("deviation_level"),
        F.min(F.when(over_fit & (clean > var_factor * F.col("_quiet")), F.col("level"))).alias("variance_onset"),
        F.min(F.when((F.col("_i") > F.col("_pi")) & (F.col("_peak") > 0) & (F.col("mean") < F.col("_peak") * (1 - collapse)), F.col("level"))).alias("collapse_level"),
        F.max("level").alias("_top"),
    )
    soft = F.least("deviation_level", "variance_onset")
    best = F.coalesce(F.bround(soft * (1 - derate), 2), F.bround(F.col("collapse_level") * (1 - derate), 2), F.col("_top").cast("double"))
    return found.withColumn("recommended", F.when(F.col("n_levels") >= 4, best)).drop("_top")


def fit_count(m):
    """How many of a run's m lowest levels the law is fitted to."""
    return F.least(m, F.greatest(F.lit(5), F.bround(0.45 * m, 0).cast("bigint")))


def detect_sweep(force: DataFrame, levels: DataFrame) -> DataFrame:
    """(run_id, t_start, t_end, fs, anchor): the sweep found by its activity, its end being the anchor.

    The idle level and noise come from the first three seconds or, where the
    active run so found is not followed by quiet, from the last three.
    """
    plan = levels.groupBy("run_id").agg(F.max("dwell_s").alias("dwell"), F.count(F.lit(1)).alias("steps"))
    w = over(RUN, "t", "seq")
    clean = robust.finite(force, "t", "v").withColumn("_dt", F.col("t") - F.lag("t").over(w))
    ends = clean.groupBy("run_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"), (1 / F.median("_dt")).alias("fs")).where("n >= 50 and fs > 0").join(plan, "run_id")
    joined = materialise(clean.join(ends, "run_id"), "force")
    tries = []
    for anchor, idle in (("head", F.col("t") < F.col("t0") + 3.0), ("tail", F.col("t") > F.col("t1") - 3.0)):
        quiet = joined.where(idle)
        few = ends.join(quiet.groupBy("run_id").agg(F.count(F.lit(1)).alias("_q")), "run_id", "left").where("coalesce(_q, 0) <= 5").select("run_id")
        quiet = quiet.select("run_id", "v").unionByName(joined.join(few, "run_id", "left_semi").select("run_id", "v"))
        level = robust.mad(quiet, RUN, "v", True).select("run_id", F.col("median").alias("base"), F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.0).alias("noise"))
        tries.append(joined.join(level, "run_id").withColumn("anchor", F.lit(anchor)))
    keys = ["run_id", "anchor"]
    both = tries[0].unionByName(tries[1]).withColumn("_x", F.abs(F.col("v") - F.col("base")))
    # the frame's width is a run's own, so it is a range of row numbers
    width = F.greatest(F.lit(1), F.bround(0.25 * F.col("fs"), 0).cast("int"))
    both = both.withColumn("_i", F.row_number().over(over(keys, "t", "seq"))).withColumn("_w", width)
    both = both.withColumn("_cum", F.sum("_x").over(over(keys, "_i").rowsBetween(Window.unboundedPreceding, 0)))
    mid = F.col("_i") - F.floor((F.col("_w") - 1) / 2) - 1
    # a held moving average from prefix sums: the frame of row i ends at clamp(i + right), begins w rows before it
    left = F.greatest(F.lit(0), F.least(mid, F.col("n") - F.col("_w")))
    framed = both.withColumn("_lo", left).withColumn("_hi", left + F.col("_w"))
    sums = both.select(*keys, F.col("_i").alias("_k"), F.col("_cum").alias("_c"))
    smooth = framed.join(sums.withColumnsRenamed({"_k": "_hi", "_c": "_ch"}), [*keys, "_hi"], "left").join(sums.withColumnsRenamed({"_k": "_lo", "_c": "_cl"}), [*keys, "_lo"], "left")
    smooth = materialise(smooth.withColumn("_s", (F.col("_ch") - F.coalesce("_cl", F.lit(0.0))) / F.col("_w")), "activity")
    top = smooth.groupBy(*keys).agg(F.percentile("_s", 0.99).alias("_amp"))
    active = smooth.join(top, keys).withColumn("on", F.col("_s") > F.greatest(8 * F.col("noise"), 0.05 * F.col("_amp")))
    active = active.select(*keys, "t", "_i", "_s", "on", "n", "fs", "t0", "dwell", "steps")
    runs = series.bridged_runs(active.withColumn("_gap", F.bround("fs", 0)), keys, ["_i"], "on", "t", F.col("_gap"), rows=True, extra=[F.sum("_s").alias("energy"), F.first("n").alias("n_all"), F.first("fs").alias("fs"), F.first("t0").alias("t0"), (F.first("dwell") * F.first("steps")).alias("expected")])
    runs = runs.withColumn("_long", (F.col("t_end") - F.col("t_start") >= 0.4 * F.col("expected")).cast("int"))
    best = runs.withColumn("_r", F.row_number().over(over(keys, F.desc("_long"), F.desc("energy"), F.col("i_start")))).where("_r = 1")
    after = best.select(*keys, "i_end").join(active, keys).where((F.col("_i") > F.col("i_end")) & (F.col("_i") <= F.col("i_end") + F.bround(5 * F.col("fs"), 0)))
    calm = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("on").cast("double")).alias("_busy"))
    judged = best.join(calm, keys, "left").withColumn("ok", F.coalesce((F.col("_n") >= F.bround("fs", 0)) & (F.col("_busy") < 0.2), F.lit(False)))
    # the head's run if it is followed by quiet, else the tail's if that is, else the head's
    rank = F.when((F.col("anchor") == "head") & F.col("ok"), 0).when((F.col("anchor") == "tail") & F.col("ok"), 1).when(F.col("anchor") == "head", 2).otherwise(3)
    chosen = judged.withColumn("_r", F.row_number().over(over(RUN, rank))).where("_r = 1")
    return chosen.select("run_id", F.greatest(F.col("t_end") - F.col("expected"), F.col("t0")).alias("t_start"), "t_end", "fs", "anchor")


def shift_scores(rises: DataFrame, grids: DataFrame, shifts: int = 121) -> DataFrame:
    """(run_id, shift, delta, score): for each shift of a run's grid of steps, the rise in the measured parts of its steps.

    rises: run_id, t, g.  grids: run_id, t_start, width, settle (share of a
    step), clean (steps looked at).  Shift 0 is half a step early, the last one
    half a step late.  A rise counts for one unbroken stretch of shifts (taken
    over all steps in turn), so it is put down twice, where the stretch begins
    and ends; sums along the shifts then give all scores in one pass, and what
    is sorted is one row for each shift and step, whatever the number of rises.
    Times are whole microseconds and rises decimals of nine places, so scores
    don't depend on the order of the rows.  A run without rises scores 0 throughout;
    rows without a run take no part.
    """
    span, grids = shifts - 1, grids.where("run_id is not null")
    whole = grids.select("run_id", "t_start", "width", "clean", F.round(F.col("width") * 1e6).cast("bigint").alias("_w"), F.round(F.col("settle") * F.col("width") * 1e6).cast("bigint").alias("_s"))
    at = rises.join(whole, "run_id").withColumn("_p", F.round((F.col("t") - F.col("t_start")) * 1e6).cast("bigint"))

    def place(p: str) -> Column:
        """The number of grid places (shifts of all steps) at or before p."""
        return F.expr(f"((2 * ({p}) + _w) * {span} - pmod((2 * ({p}) + _w) * {span}, 2 * _w)) div (2 * _w)")

    g = F.col("g").cast("decimal(28,9)")
    ends = F.array(F.struct((place("_p") - span + 1).alias("m"), g.alias("g")), F.struct((place("_p - _s") + 1).alias("m"), (-g).alias("g")))
    marks = at.select("run_id", F.explode(ends).alias("_e"), "clean").select("run_id", F.greatest("_e.m", F.lit(0)).alias("m"), "_e.g", "clean").where(F.col("m") <= F.col("clean") * span)
    marks = marks.groupBy("run_id", "m").agg(F.sum("g").alias("g"))
    every = grids.select("run_id", "width", "clean", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("clean").cast("bigint") * span)).alias("m"))
    rise = every.join(marks, ["run_id", "m"], "left").withColumn("_e", F.sum(F.coalesce("g", F.lit(0))).over(over(RUN, "m").rowsBetween(Window.unboundedPreceding, 0)))
    # the last shift of a step is the first one of the next
    m = F.col("m")
    used = F.array_compact(F.array(F.when(m < F.col("clean") * span, m % span), F.when((m % span == 0) & (m > 0), F.lit(span))))
    scores = rise.withColumn("shift", F.explode(used)).groupBy("run_id", "shift").agg(F.sum("_e").cast("double").alias("score"), F.first("width").alias("_width"))
    return scores.select("run_id", "shift", (F.col("_width") * (F.col("shift") / span - 0.5)).alias("delta"), "score")


def align_grid(force: DataFrame, sweep: DataFrame, levels: DataFrame, shifts: int = 121) -> DataFrame:
    """(run_id, t_start): the sweep's start moved by up to half a step, so that rises fall into the discarded settling
    part of steps: least rise in the measured parts of the lower steps, the smallest move among near equals."""
    plan = levels.groupBy("run_id").agg(F.max("dwell_s").alias("width"), F.count(F.lit(1)).alias("steps"), F.max("settle_frac").alias("settle"))
    info = sweep.join(plan, "run_id").withColumn("clean", F.greatest(F.lit(3), F.floor(0.6 * F.col("steps")).cast("int")))
    near = robust.finite(force, "t", "v").join(info, "run_id").where((F.col("t") >= F.col("t_start") - F.col("width")) & (F.col("t") <= F.col("t_start") + (F.col("clean") + 1) * F.col("width")))
    # rises over a short centred mean of about 0.08 s, from time-based frames
    ms = F.round(F.col("t") * 1e6).cast("bigint")
    smooth = near.withColumn("_u", ms).withColumn("_s", F.avg("v").over(Window.partitionBy("run_id").orderBy("_u").rangeBetween(-40_000, 40_000)))
    rises = series.gradient(smooth, RUN, ["t", "seq"], "_s", "g").where("g > 0").select("run_id", "t", "g")
    use = (F.col("settle") > 0) & (F.col("settle") < 1) & (F.col("steps") >= 2) & (F.col("width") > 0)
    scores = shift_scores(rises, info.where(use).select("run_id", "t_start", "width", "settle", "clean"), shifts)
    least = scores.withColumn("_min", F.min("score").over(Window.partitionBy("run_id"))).where("score <= _min * 1.05 + 1e-9")
    # moves are compared as whole shifts: as doubles, equal moves to either side differ in their last digits
    picked = least.groupBy("run_id").agg(F.min_by("delta", F.struct(F.abs(2 * F.col("shift") - (shifts - 1)), "shift")).alias("delta"))
    return info.join(picked, "run_id", "left").select("run_id", (F.col("t_start") + F.coalesce("delta", F.lit(0.0))).alias("t_start"))


def level_stats(force: DataFrame, starts: DataFrame, levels: DataFrame) -> DataFrame:
    """(run_id, level_idx, level, n, mean, std, median, tare): the measured part of each step, less the idle level
    before the sweep (the median of its last second but 0.2 s; nothing below eight samples)."""
    clean = robust.finite(force, "t", "v")
    before = clean.join(starts, "run_id").where("t >= t_start - 1.2 and t < t_start - 0.2").groupBy("run_id").agg(F.median("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
    tare = starts.join(before, "run_id", "left").select("run_id", "t_start", F.when(F.col("_n") >= 8, F.col("_m")).otherwise(0.0).alias("tare"))
    windows = levels.join(tare, "run_id").select("run_id", "level_idx", "level", "tare", (F.col("t_start") + (F.col("level_idx") + F.col("settle_frac")) * F.col("dwell_s")).alias("lo"), (F.col("t_start") + (F.col("level_idx") + 1) * F.col("dwell_s")).alias("hi"))
    inside = series.interval_join(clean, windows, RUN, "t", "lo", "hi", 5.0, closed=False).withColumn("_y", F.col("v") - F.col("tare"))
    stats = inside.groupBy("run_id", "level_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.when(F.count(F.lit(1)) >= 3, F.stddev_samp("_y")).alias("std"), F.median("_y").alias("median"))
    return windows.select("run_id", "level_idx", "level", "tare").join(stats, ["run_id", "level_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def power_law(points: DataFrame, by: list[str], q: str, y: str, grid: int = 400) -> DataFrame:
    """(by, a, b, c, sigma, r2) of y = a * q ** b + c with a >= 0 and 0.05 <= b <= 2.

    Given b, a and c come from least squares; b is searched on a grid and then
    on a finer one around the best.
    """

    def solved(df: DataFrame, exponents) -> DataFrame:
        tried = df.withColumn("b", F.explode(exponents)).withColumn("_p", F.pow(F.col(q).cast("double"), F.col("b")))
        sums = tried.groupBy(*by, "b").agg(F.regr_slope(F.col(y), F.col("_p")).alias("_a"), F.avg("_p").alias("_mp"), F.avg(y).alias("_my"), F.regr_sxx(F.col(y), F.col("_p")).alias("_sxx"), F.regr_syy(F.col(y), F.col("_p")).alias("_syy"), F.count(y).alias("_n"))
        a = F.greatest(F.coalesce("_a", F.lit(0.0)), F.lit(0.0))
        return sums.withColumn("a", a).withColumn("c", F.col("_my") - F.col("a") * F.col("_mp")).withColumn("_sse", F.greatest(F.col("_syy") - F.col("a") ** 2 * F.col("_sxx"), F.lit(0.0)))

    step = 1.95 / grid
    valid = points.where(F.col(y).isNotNull() & F.col(q).isNotNull())
    coarse = solved(valid, F.transform(F.sequence(F.lit(0), F.lit(grid)), lambda i: 0.05 + i * step)).groupBy(*by).agg(F.min_by("b", F.struct("_sse", "b")).alias("_b0"))
    fine = F.transform(F.sequence(F.lit(-grid), F.lit(grid)), lambda i: F.least(F.lit(2.0), F.greatest(F.lit(0.05), F.col("_b0") + i * step / grid)))
    best = solved(valid.join(coarse, by), fine).groupBy(*by).agg(F.min_by(F.struct("a", "b", "c", "_sse", "_syy", "_n"), F.struct("_sse", "b")).alias("_m")).select(*by, "_m.*")
    return best.where("_n >= 3").select(*by, "a", "b", "c", F.sqrt(F.col("_sse") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("sigma"), F.when(F.col("_syy") > 0, 1 - F.col("_sse") / F.col("_syy")).otherwise(1.0).alias("r2"))


def analyse_flow(force: DataFrame, levels: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(per level, per run): levels with predicted force; runs with start, anchor, fit, markers and recommendation."""
    sweep = materialise(detect_sweep(force, levels), "sweeps")
    starts = materialise(align_grid(force, sweep, levels), "starts")
    stats = materialise(level_stats(force, starts, levels), "levels")
    m = F.count("mean").over(Window.partitionBy("run_id"))
    ranked = stats.where("mean is not null").withColumn("_i", F.row_number().over(over(RUN, "level"))).withColumn("_m", m)
    fit = materialise(power_law(ranked.where((F.col("_i") <= fit_count(F.col("_m"))) & (F.col("_m") >= 4)), RUN, "level", "mean"), "fits")
    full = stats.join(fit, "run_id", "left").withColumn("predicted", F.col("a") * F.pow(F.col("level").cast("double"), F.col("b")) + F.col("c"))
    marks = breakdown(full, RUN, **limits)
    runs = starts.join(sweep.select("run_id", "t_end", "fs", "anchor"), "run_id").join(fit, "run_id", "left").join(marks, "run_id", "left")
    return full.select("run_id", "level_idx", "level", "n", "mean", "std", "median", "tare", "predicted"), runs
