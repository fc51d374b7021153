"""Plan tables: when each part of a program runs.  Timing only; nothing here moves a machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions import scalar

_PAST = (Window.unboundedPreceding, -1)


def sweep_segments(runs: DataFrame) -> DataFrame:
    """(run_id, k_idx, k, start_offset_s, duration_s, cycle_period_s, cycles, first_cycle_slow_extension_s).

    runs: run_id, k_values (array), slow_half_s, fast_half_s, cycles,
    first_slow_leg_factor, dwell_s.  The first K's slow leg is longer by the
    factor; a dwell lies between K.
    """
    each = runs.select("run_id", "slow_half_s", "fast_half_s", F.col("cycles").cast("int").alias("cycles"), "first_slow_leg_factor", "dwell_s", F.posexplode("k_values").alias("k_idx", "k"))
    period = F.col("slow_half_s") + F.col("fast_half_s")
    extension = F.when(F.col("k_idx") == 0, F.col("slow_half_s") * (F.col("first_slow_leg_factor") - 1)).otherwise(0.0)
    timed = each.withColumn("cycle_period_s", period).withColumn("first_cycle_slow_extension_s", extension).withColumn("duration_s", F.col("cycles") * period + extension)
    before = F.coalesce(F.sum(F.col("duration_s") + F.col("dwell_s")).over(Window.partitionBy("run_id").orderBy("k_idx").rowsBetween(*_PAST)), F.lit(0.0))
    return timed.withColumn("start_offset_s", F.lit(0.5) + before).select("run_id", "k_idx", "k", "start_offset_s", "duration_s", "cycle_period_s", "cycles", "first_cycle_slow_extension_s")


def flow_segments(runs: DataFrame) -> DataFrame:
    """(run_id, level_idx, flow_mm3_s, feed_mm_s, start_offset_s, duration_s) for run_id, min_flow, max_flow, step_flow,
    dwell_s, warmup_s, filament_diameter."""
    levels = scalar.grid(F.col("min_flow"), F.col("max_flow"), F.col("step_flow"))
    each = runs.select("run_id", "dwell_s", "warmup_s", "filament_diameter", F.posexplode(levels).alias("level_idx", "flow_mm3_s"))
    return each.select("run_id", "level_idx", "flow_mm3_s", scalar.feed_of_flow(F.col("flow_mm3_s"), F.col("filament_diameter")).alias("feed_mm_s"), (F.col("warmup_s") + F.col("level_idx") * F.col("dwell_s")).alias("start_offset_s"), F.col("dwell_s").alias("duration_s"))


def probe_touches(runs: DataFrame) -> DataFrame:
    """(run_id, idx, start_offset_s, duration_s, axis_start, axis_end) for run_id, n_touches, start, dir_sign, creep_mm,
    slow_feed_mm_min, travel_feed_mm_min, backoff_mm, settle_ms."""
    creep = F.col("creep_mm") / (F.col("slow_feed_mm_min") / 60)
    travel = (F.col("creep_mm") + F.col("backoff_mm")) / (F.col("travel_feed_mm_min") / 60)
    settle = F.col("settle_ms") / 1000
    each = runs.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("n_touches").cast("int") - 1)))
    cycle = settle + creep + travel
    return each.select("run_id", "idx", (settle + F.col("idx") * cycle).alias("start_offset_s"), creep.alias("duration_s"), F.col("start").alias("axis_start"), (F.col("start") + F.col("dir_sign") * F.col("creep_mm")).alias("axis_end"))


def plan_windows(segments: DataFrame, t0: Column) -> DataFrame:
    """Each segment's planned absolute window from a run's t0."""
    start = t0 + F.col("start_offset_s")
    return segments.withColumn("t_lo", start).withColumn("t_hi", start + F.col("duration_s"))
