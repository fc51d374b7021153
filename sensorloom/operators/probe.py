"""Touch probes: is lateral contact detectable and repeatable?

force and position: run_id, seq, t, v (the probed axis).  runs: run_id,
standoff, dir_sign, creep_mm, slow_mm_s, n_touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import robust, series
from sensorloom.operators.series import over
from sensorloom.sources.shared import materialise

RUN = ["run_id"]
TOUCH = ["run_id", "idx"]


def creeps(force: DataFrame, position: DataFrame, runs: DataFrame, cell: float | None = 60.0) -> DataFrame:
    """The force samples of each slow creep: run_id, idx, seq, t, v, progress."""
    clean = robust.finite(force, "t", "v").select("run_id", "seq", "t", "v")
    placed = series.lerp_join(clean, robust.finite(position, "t", "v").select("run_id", "t", F.col("v").alias("x")), RUN, "t", "x", "x", cell).join(runs, "run_id")
    placed = placed.withColumn("progress", (F.col("x") - F.col("standoff")) * F.col("dir_sign"))
    order = ["t", "seq"]
    placed = series.gradient(placed, RUN, order, "progress", "_dp")
    placed = series.gradient(placed, RUN, order, "t", "_dt")
    mid = placed.where("_dt > 0").groupBy("run_id").agg(F.median("_dt").alias("_mid"), F.count(F.lit(1)).alias("_n")).where("_n >= 5")
    moving = placed.join(mid, "run_id").withColumn("_vel", F.col("_dp") / F.when(F.col("_dt") > 0, F.col("_dt")).otherwise(F.col("_mid")))
    # about 0.05 s of smoothing: a frame of time, as its rows differ by run
    smooth = moving.withColumn("_us", F.round(F.col("t") * 1e6).cast("bigint")).withColumn("_v", F.avg("_vel").over(Window.partitionBy("run_id").orderBy("_us").rangeBetween(-25_000, 25_000)))
    slow = F.greatest("slow_mm_s", F.lit(1e-6))
    on = materialise(smooth, "motion").withColumn("on", (F.col("_v") > 0.2 * slow) & (F.col("_v") < F.greatest(4 * slow, slow + 1)))
    ends = [F.min_by("progress", "_i").alias("p0"), F.max_by("progress", "_i").alias("p1"), F.first("creep_mm").alias("creep_mm"), F.first("n_touches").alias("n_touches")]
    found = series.bridged_runs(on, RUN, order, "on", "t", F.greatest(F.lit(1), F.bround(0.3 / F.col("_mid"), 0)), rows=True, extra=ends)
    span = F.abs(F.col("p1") - F.col("p0"))
    good = found.withColumn("span", span).where("span >= 0.4 * creep_mm and n >= 4")
    ranked = good.withColumn("_r", F.row_number().over(over(RUN, F.desc("span"), F.col("t_start")))).where(F.col("_r") <= F.greatest("n_touches", F.lit(1)))
    chosen = ranked.withColumn("idx", F.row_number().over(over(RUN, "t_start")) - 1).select("run_id", "idx", "i_start", "i_end")
    rows = on.withColumn("_i", F.row_number().over(over(RUN, *order)))
    # few creeps a run: by row number, in cells of rows
    inside = series.interval_join(rows, chosen, RUN, "_i", "i_start", "i_end", 1000.0)
    return inside.select("run_id", "idx", "seq", "t", "v", "progress")


def touches(samples: DataFrame, n_sigma: float = 5.0, baseline: float = 0.2) -> DataFrame:
    """(run_id, idx, n_samples, baseline_force, noise, contact_pos, peak_force, monotonic_frac) of creeps' samples.

    Contact is the first of three samples in a row above n_sigma noise, over
    the median of the creep's first part.
    """
    order = ["t", "seq"]
    w = over(TOUCH, *order)
    ends = samples.withColumn("_p0", F.first("progress").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("_p1", F.last("progress").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.withColumn("_in", F.col("progress") <= F.col("_p0") + baseline * (F.col("_p1") - F.col("_p0")))
    few = F.count_if("_in").over(Window.partitionBy(*TOUCH)) < 3
    ends = ends.withColumn("_b", F.when(few | F.col("_in"), F.col("v")))
    level = robust.mad(ends, TOUCH, "_b", True).select(*TOUCH, F.col("median").alias("baseline_force"), F.col("mad").alias("noise"))
    tared = samples.join(level, TOUCH).withColumn("y", F.col("v") - F.col("baseline_force"))
    above = tared.withColumn("_on", (F.col("noise") > 0) & (F.col("y") > n_sigma * F.col("noise")))
    hits = series.consecutive(above, TOUCH, order, "_on", 3, "_hit")
    marked = hits.withColumn("_t0", F.min(F.when(F.col("_hit"), F.col("t"))).over(Window.partitionBy(*TOUCH))).withColumn("_up", F.col("y") - F.lag("y").over(w))
    after = F.col("t") > F.col("_t0")
    return marked.groupBy(*TOUCH, "baseline_force", "noise").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min_by("progress", F.when(F.col("t") >= F.col("_t0"), F.struct("t", "seq"))).alias("contact_pos"),
        F.max("y").alias("peak_force"),
        F.coalesce(F.avg(F.when(after, (F.col("_up") > 0).cast("double"))), F.lit(0.0)).alias("monotonic_frac"),
    )


def verdicts(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, n_touches_found, n_contacts, contact_pos_mean, contact_pos_std, snr, verdict).

    The deviation of a single contact is null: one touch shows no repeatability,
    and isn't held against the run.
    """
    per_run = found.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_touches_found"),
        F.count("contact_pos").alias("n_contacts"),
        F.avg("contact_pos").alias("contact_pos_mean"),
        F.when(F.count("contact_pos") > 1, F.stddev_pop("contact_pos")).alias("contact_pos_std"),
        F.median("peak_force").alias("_peak"),
        F.median(F.when(F.col("noise") > 0, F.col("noise"))).alias("_noise"),
    )
    share = F.col("n_contacts") / F.greatest("n_touches_found", F.lit(1))
    judged = per_run.withColumn("snr", F.coalesce(F.try_divide("_peak", "_noise"), F.lit(0.0)))
    steady = (F.col("n_contacts") > 0) & (F.coalesce("contact_pos_std", F.lit(0.0)) <= 0.1)
    verdict = F.when((F.col("snr") >= 10) & (share >= 0.6) & steady, "usable").when((F.col("snr") >= 4) & (share >= 0.4), "marginal").otherwise("no clear signal")
    every = runs.select("run_id").join(judged.withColumn("verdict", verdict), "run_id", "left")
    return every.select("run_id", F.coalesce("n_touches_found", F.lit(0)).alias("n_touches_found"), F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"), "contact_pos_mean", "contact_pos_std", F.coalesce("snr", F.lit(0.0)).alias("snr"), F.coalesce("verdict", F.lit("no creeps detected")).alias("verdict"))


def analyse_probe(force: DataFrame, position: DataFrame, runs: DataFrame, n_sigma: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(per touch, per run)."""
    found = touches(materialise(creeps(force, position, runs), "creeps"), n_sigma)
    return found, verdicts(found, runs)
