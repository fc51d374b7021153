"""The sweep analysis end to end: from saved signals to seven estimates of the best K, for many runs at once.

signals: run_id, metric, seq, t, v.  plan: plan_segments of plans.tables.
runs: run_id, sweep_t0, slow_half_s, fast_half_s, slow_feed, fast_feed, accel,
coupled_dx, purge_z, lift (nullable but for the first four).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators import detectors, fits, robust, series, steps
from sensorloom.sources.shared import materialise

ANCHORED = "run_id string, kind string, k_idx int, k double, seg_idx int, t_a double, t_b double, source string, sweep_t0 double"
LAGS = "run_id string, k_idx int, k double, phase_lag_ms double, legacy_area double"


def _arrays(signals: pd.DataFrame, metric: str) -> tuple[np.ndarray, np.ndarray]:
    own = signals[(signals.metric == metric) & np.isfinite(signals.t) & np.isfinite(signals.v)].sort_values(["t", "seq"], kind="stable")
    return own.t.to_numpy(), own.v.to_numpy()


def _anchor_run(signals: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    columns = [c.split()[0] for c in ANCHORED.split(", ")]
    if plan.empty or signals.empty:
        return pd.DataFrame(columns=columns)
    plan = plan.sort_values("k_idx")
    run = plan.iloc[0]

    def known(name, default):
        return default if pd.isna(run[name]) else float(run[name])

    own = detectors.Plan(plan.k.to_numpy(), plan.start_offset_s.to_numpy(), plan.duration_s.to_numpy(), plan.cycles.to_numpy().astype(int), float(run.cycle_period_s), float(run.slow_half_s))
    force, x, z = (_arrays(signals, m) for m in ("loadcell_value", "pos_x", "pos_z"))
    if len(force[0]) < 10:
        return pd.DataFrame(columns=columns)
    amplitude = known("coupled_dx", 0.0)
    got = detectors.resolve(own, force, x, z, known("sweep_t0", force[0][0]), bool(run.anchored), known("lift", 2.0), None if pd.isna(run.purge_z) else float(run.purge_z), amplitude)
    idx = plan.k_idx.to_numpy()
    rows = [(run.run_id, "window", int(idx[i]), float(own.k[i]), 0, float(a), float(b), got.source, got.t0) for i, (a, b) in enumerate(got.windows)]
    rows += [(run.run_id, "segment", int(idx[i]), float(own.k[i]), j, a, b, source, got.t0) for i, j, a, b, source in detectors.segments(own, got, force, x, amplitude)]
    return pd.DataFrame(rows, columns=columns)


def anchors(signals: DataFrame, plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of kind 'window' (one per K) and 'segment' (one per rise and fall), absolute times, with what they rest on."""
    used = signals.where(F.col("metric").isin("loadcell_value", "pos_x", "pos_z"))
    own = [c for c in ("anchored", "coupled_dx", "purge_z", "lift", "sweep_t0", "slow_half_s") if c in runs.columns]
    full = plan.join(runs.select("run_id", *own), "run_id")
    for name in ("anchored", "coupled_dx", "purge_z", "lift", "sweep_t0"):
        if name not in full.columns:
            full = full.withColumn(name, F.lit(False) if name == "anchored" else F.lit(None).cast("double"))
    return used.groupBy("run_id").cogroup(full.groupBy("run_id")).applyInPandas(_anchor_run, ANCHORED)


def _lag_k(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["t", "seq"])
    run = pdf.iloc[0]
    t, y, dt = pdf.t.to_numpy(), pdf.v.to_numpy(), 1e-3
    lag = area = float("nan")
    if len(t) >= 8 and t[-1] > t[0]:
        grid = t[0] + np.arange(max(2, int((t[-1] - t[0]) / dt + 1e-9) + 1)) * dt
        if len(grid) >= 8:
            force = np.interp(grid, t, y)
            wave = detectors.command_wave(grid, run.burst, run.cycle_period_s, run.slow_half_s, run.slow_feed, run.fast_feed, run.accel)
            lag = detectors.phase_lag(force, wave, dt)
            area = float(((force[1:] - force.mean()) * np.sign(np.diff(wave))).sum() * dt)
    return pd.DataFrame([(run.run_id, run.k_idx, run.k, lag, area)], columns=["run_id", "k_idx", "k", "phase_lag_ms", "legacy_area"])


def per_k(signals: DataFrame, anchored: DataFrame, plan: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per K: n_samples, mean, std, coverage, dropouts, phase_lag_ms, legacy_area, keep.

    A K with fewer than eight samples stays, excluded, with nulls.
    """
    force = robust.finite(signals.where("metric = 'loadcell_value'"), "t", "v")
    windows = anchored.where("kind = 'window'").select("run_id", "k_idx", "k", F.col("t_a").alias("t_lo"), F.col("t_b").alias("t_hi"))
    info = plan.select("run_id", "k_idx", "cycle_period_s", "cycles", "first_cycle_slow_extension_s").join(runs.select("run_id", "slow_half_s", "slow_feed", "fast_feed", "accel"), "run_id")
    # a window reaches a slow leg further, so that its last fall can settle
    wide = windows.join(info, ["run_id", "k_idx"]).withColumn("t_to", F.col("t_hi") + F.col("slow_half_s"))
    inside = series.interval_join(force, wide, ["run_id"], "t", "t_lo", "t_to", 10.0)
    keys = ["run_id", "k_idx"]
    rate = robust.sample_rate(force, ["run_id"], ["t", "seq"], "t").select("run_id", F.col("rate_steps").alias("rate"))
    stats = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("v").alias("force_mean"), F.stddev_pop("v").alias("force_std"))
    drops = robust.dropouts(inside, keys, ["t", "seq"], "t", "v").groupBy(*keys).agg(F.count(F.lit(1)).alias("dropouts"))
    # the burst's cycles end with the window
    burst = inside.withColumn("burst", F.col("t_hi") - F.col("cycles") * F.col("cycle_period_s")).select("run_id", "k_idx", "k", "seq", "t", "v", "burst", "cycle_period_s", "slow_half_s", "slow_feed", "fast_feed", F.coalesce("accel", F.lit(5000.0)).alias("accel"))
    lags = burst.groupBy("run_id", "k_idx").applyInPandas(_lag_k, LAGS).drop("k")
    out = wide.select("run_id", "k_idx", "k", "t_lo", "t_to").join(rate, "run_id", "left").join(stats, keys, "left").join(drops, keys, "left").join(lags, keys, "left")
    n, dropped = F.coalesce("n_samples", F.lit(0)), F.coalesce("dropouts", F.lit(0))
    covered = robust.coverage(n, F.col("t_lo"), F.col("t_to"), F.coalesce("rate", F.lit(1.0)))
    keep = (n >= 8) & (covered >= 0.5) & (dropped / F.greatest(n, F.lit(1)) <= 0.05)
    clean = {c: F.when((n >= 8) & ~F.isnan(c), F.col(c)) for c in ("phase_lag_ms", "legacy_area")}
    return out.withColumns({"n_samples": n, "dropouts": dropped, "coverage": covered, **clean}).withColumn("keep", keep).drop("t_lo", "t_to", "rate")


def analyse_sweep(signals: DataFrame, plan: DataFrame, runs: DataFrame, weights: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """Tables: anchors, per_k, segments, medians, and estimates (run_id, method, k_opt) by seven methods."""
    signals = signals.select("run_id", "metric", "seq", "t", "v")
    anchored = materialise(anchors(signals, plan, runs), "anchors")
    ks = materialise(per_k(signals, anchored, plan, runs), "per_k")
    force = robust.finite(signals.where("metric = 'loadcell_value'"), "t", "v")
    legs = plan.select("run_id", "k_idx", "cycles").join(runs.select("run_id", F.col("slow_half_s").alias("slow"), F.col("fast_half_s").alias("fast")), "run_id")
    found = anchored.where("kind = 'segment'").join(legs, ["run_id", "k_idx"]).select("run_id", "k", "seg_idx", F.col("t_a").alias("t_rise"), F.col("t_b").alias("t_fall"), "slow", "fast", "cycles")
    dropped = robust.dropouts(force, ["run_id"], ["t", "seq"], "t", "v").select("run_id", "t")
    segments = materialise(steps.step_metrics(force, found, dropped), "segments")
    medians = materialise(fits.normalise(steps.aggregate(segments), ["run_id"]), "medians")
    kept = ks.where("keep").select("run_id", "k")
    good = medians.join(kept, ["run_id", "k"], "left_semi")
    area = materialise(steps.integral_area(force, segments).join(kept, ["run_id", "k"], "left_semi").where("n >= 4"), "areas")

    def named(df: DataFrame, method: str) -> DataFrame:
        return df.select("run_id", F.lit(method).alias("method"), "k_opt")

    by = ["run_id"]
    one = segments.where("not excluded and k_estimate is not null").join(kept, ["run_id", "k"], "left_semi")
    spread = robust.mad(one, by, "k_estimate").where("n >= 4").select("run_id", F.col("median").alias("k_opt"))
    estimates = [
        named(fits.quadratic_zero(ks.where("keep"), by, "phase_lag_ms"), "phase_lag"),
        named(fits.linear_zero(area, by, "area"), "integral"),
        named(fits.linear_zero(ks.where("keep"), by, "legacy_area"), "integral_legacy"),
        named(fits.argmin_parabolic(fits.cost(good, by, weights), by, "cost"), "composite_cost"),
        named(fits.theil_sen_zero(good.where("metric = 'rise_signed_area'"), by, "median"), "rise_signed_area"),
        named(fits.theil_sen_zero(good.where("metric = 'fall_signed_area'"), by, "median"), "fall_signed_area"),
        named(spread, "segment_median"),
    ]
    every = estimates[0]
    for e in estimates[1:]:
        every = every.unionByName(e)
    return {"anchors": anchored, "per_k": ks, "segments": segments, "medians": medians, "estimates": every}
