"""Ordered-series operators on long-form signals.

Every function takes a DataFrame, the columns `by` that name a series (a run,
or a run and a metric), and an order column that is unique in a series; ties
are the caller's to break, by a second order column.  Where a series may be
long, `cell` cuts its time axis: windows then run over a cell at a time, and
what must cross a cell's edge is carried by a second pass over one row per
cell, so one run never has to fit in one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sensorloom.operators import cells
from sensorloom.operators.ranks import joined
from sensorloom.sources.shared import materialise

PAST, FUTURE, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def over(by: list[str], *order: str | Column):
    return Window.partitionBy(*by).orderBy(*order)


# --- differences and frames (W-01 to W-05, A-29) ---


def difference(df: DataFrame, by: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """The value less the one before it; null on the first row."""
    return df.withColumn(out, F.col(col) - F.lag(col).over(over(by, *order)))


def gradient(df: DataFrame, by: list[str], order: list[str], col: str, out: str, t: str | None = None) -> DataFrame:
    """Central differences, one-sided at the ends: per row, or per second if `t` is given (second order for uneven steps)."""
    w = over(by, *order)
    y0, y1, y2 = F.lag(col).over(w), F.col(col), F.lead(col).over(w)
    if t is None:
        value = F.when(y0.isNull(), y2 - y1).when(y2.isNull(), y1 - y0).otherwise((y2 - y0) / 2)
    else:
        a, b = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
        value = F.when(y0.isNull(), F.try_divide(y2 - y1, b)).when(y2.isNull(), F.try_divide(y1 - y0, a)).otherwise(F.try_divide(a * a * y2 - b * b * y0 + (b * b - a * a) * y1, a * b * (a + b)))
    return df.withColumn(out, value)


def _span(width: int) -> tuple[int, int]:
    """Rows before and after of a centred frame; an even width reaches one further back."""
    return -(width // 2), (width - 1) // 2


def moving_average_zero(df: DataFrame, by: list[str], order: list[str], col: str, width: int, out: str) -> DataFrame:
    """Centred sums over `width`, also where the frame sticks out: as if zeros stood beyond the ends."""
    return df.withColumn(out, F.sum(col).over(over(by, *order).rowsBetween(*_span(width))) / width)


def moving_average_held(df: DataFrame, by: list[str], order: list[str], col: str, width: int, out: str) -> DataFrame:
    """Centred means of whole frames; towards the ends the first or last of them is held."""
    w = over(by, *order)
    frame = w.rowsBetween(*_span(width))
    whole = F.when(F.count(F.lit(1)).over(frame) == width, F.avg(col).over(frame))
    df = df.withColumn(out, whole)
    return df.withColumn(out, F.coalesce(out, F.first(out, True).over(w.rowsBetween(HERE, FUTURE)), F.last(out, True).over(w.rowsBetween(PAST, HERE)), F.avg(col).over(Window.partitionBy(*by))))


def rolling_median(df: DataFrame, by: list[str], order: list[str], col: str, width: int, out: str) -> DataFrame:
    """Centred medians over `width` rows, the end values standing beyond the ends."""
    half = width // 2
    at = materialise(cells.placed(cells.dealt(df, by, order), by, order), "placed")
    ends = at.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min_by(col, "_place").alias("_first"), F.max_by(col, "_place").alias("_last"))
    framed = joined(cells.framed(at, by, half, half, {"_frame": lambda w: F.collect_list(col).over(w)}), ends, by)
    before, after = F.greatest(half - F.col("_place"), F.lit(0)), F.greatest(half + 1 + F.col("_place") - F.col("_n"), F.lit(0))
    padded = F.sort_array(F.concat(F.array_repeat(F.col("_first"), before.cast("int")), F.col("_frame"), F.array_repeat(F.col("_last"), after.cast("int"))))
    return framed.withColumn(out, F.element_at(padded, half + 1)).drop("_frame", "_n", "_first", "_last", "_place", "_cell")


def rolling_std(df: DataFrame, by: list[str], order: list[str], col: str, width: int, out: str) -> DataFrame:
    """Population deviation of the row and the width - 1 before it."""
    return df.withColumn(out, F.stddev_pop(col).over(over(by, *order).rowsBetween(1 - width, 0)))


def detrend(df: DataFrame, by: list[str], order: list[str], col: str, out: str) -> DataFrame:
    """The residual of a straight line over the row number; of the mean below four rows."""
    n = F.row_number().over(over(by, *order)).cast("double")
    df = df.withColumn("_n", n)
    w = Window.partitionBy(*by)
    slope, intercept = F.regr_slope(F.col(col), F.col("_n")).over(w), F.regr_intercept(F.col(col), F.col("_n")).over(w)
    line = F.when(F.count(F.lit(1)).over(w) < 4, F.avg(col).over(w)).otherwise(slope * F.col("_n") + intercept)
    return df.withColumn(out, F.col(col) - line).drop("_n")


# --- runs of true rows (W-06 to W-08) ---


def true_runs(df: DataFrame, by: list[str], order: list[str], flag: str, t: str, extra: list[Column] | None = None) -> DataFrame:
    """One row per run of true rows: run (from 1, in order), t_start, t_end, n and any `extra` aggregates."""
    w = over(by, *order)
    marked = df.withColumn("_on", F.coalesce(F.col(flag), F.lit(False)))
    marked = marked.withColumn("_new", (F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(PAST, HERE))).where("_on")
    return marked.groupBy(*by, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count(F.lit(1)).alias("n"), *(extra or []))


def bridged_runs(df: DataFrame, by: list[str], order: list[str], flag: str, t: str, gap, rows: bool = False, extra: list[Column] | None = None) -> DataFrame:
    """Runs of true rows, merged where at most `gap` (seconds, or false rows) lies between them; extra aggregates are
    over all rows of the merged run, those of its gaps included."""
    w = over(by, *order)
    numbered = df.withColumn("_i", F.row_number().over(w))
    at = F.col("_i") if rows else F.col(t)
    on = F.coalesce(F.col(flag), F.lit(False))
    before = F.last(F.when(on, at), True).over(w.rowsBetween(PAST, -1))
    apart = at - before - (1 if rows else 0)
    numbered = numbered.withColumn("_new", (on & (before.isNull() | (apart > gap))).cast("int"))
    numbered = numbered.withColumn("run", F.sum("_new").over(w.rowsBetween(PAST, HERE))).where("run > 0")
    end = F.max(F.when(on, F.col("_i"))).over(Window.partitionBy(*by, "run"))
    held = numbered.withColumn("_end", end).where("_i <= _end")
    return held.groupBy(*by, "run").agg(F.min(t).alias("t_start"), F.max(t).alias("t_end"), F.count(F.lit(1)).alias("n"), F.min("_i").alias("i_start"), F.max("_i").alias("i_end"), *(extra or []))


def best_run(runs: DataFrame, by: list[str], score: Column, k: int = 1) -> DataFrame:
    """The k runs with the highest score per series, earlier ones first among equals, in order of time."""
    w = over(by, score.desc(), F.col("t_start"))
    return runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def first_sustained(df: DataFrame, by: list[str], order: list[str], flag: str, t: str, n: int) -> DataFrame:
    """The start of the first run of at least n true rows."""
    return true_runs(df, by, order, flag, t).where(F.col("n") >= n).groupBy(*by).agg(F.min("t_start").alias("t_first"))


def consecutive(df: DataFrame, by: list[str], order: list[str], flag: str, n: int, out: str) -> DataFrame:
    """Whether this row and the n - 1 after it are true."""
    frame = over(by, *order).rowsBetween(0, n - 1)
    return df.withColumn(out, (F.count(F.lit(1)).over(frame) == n) & F.coalesce(F.bool_and(F.coalesce(F.col(flag), F.lit(False))).over(frame), F.lit(False)))


# --- alignment (J-01 to J-07, W-22 to W-24) ---


def _brackets(left: DataFrame, right: DataFrame, by: list[str], t: str, v: list[str], cell: float | None, ahead: bool) -> DataFrame:
    """The left rows with the structs _prev (at or before t) and, if `ahead`, _next (after t) of the right side."""
    own = left.columns
    pack = F.struct(F.col(t).alias("t"), *[F.col(c).alias(c) for c in v])
    a = left.select(F.struct(*own).alias("_row"), *by, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(pack.alias("x")).schema["x"].dataType).alias("_b"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *by, F.col(t).alias("_t"), F.lit(0).alias("_side"), pack.alias("_b"))
    both = a.unionByName(b)
    keys = list(by)
    if cell is not None:
        both = both.withColumn("_cell", F.floor(F.col("_t") / cell))
        keys = [*by, "_cell"]
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    found = both.withColumn("_prev", F.last("_b", True).over(w.rowsBetween(PAST, HERE)))
    if ahead:
        found = found.withColumn("_next", F.first("_b", True).over(w.rowsBetween(1, FUTURE)))
    found = found.where("_side = 1")
    if cell is not None:
        # one row per cell carries what lies beyond its edges
        cells = both.groupBy(*keys).agg(F.max_by("_b", F.when(F.col("_b").isNotNull(), F.col("_t"))).alias("_last"), F.min_by("_b", F.when(F.col("_b").isNotNull(), F.col("_t"))).alias("_first"))
        over_cells = Window.partitionBy(*by).orderBy("_cell")
        cells = cells.select(*keys, F.last("_last", True).over(over_cells.rowsBetween(PAST, -1)).alias("_before"), F.first("_first", True).over(over_cells.rowsBetween(1, FUTURE)).alias("_after"))
        found = found.join(cells, keys).withColumn("_prev", F.coalesce("_prev", "_before"))
        if ahead:
            found = found.withColumn("_next", F.coalesce("_next", "_after"))
    return found.select("_row.*", "_prev", *(["_next"] if ahead else []))


def lerp_join(left: DataFrame, right: DataFrame, by: list[str], t: str, v: str, out: str, cell: float | None = None, bracket: bool = False) -> DataFrame:
    """The left rows with the right series' value at their times: linear between its points, held beyond its ends, null
    if it has none.  With `bracket`, also the times of the points around (out + '_t0', out + '_t1')."""
    found = _brackets(left, right, by, t, [v], cell, True)
    t0, v0, t1, v1 = F.col("_prev.t"), F.col(f"_prev.{v}"), F.col("_next.t"), F.col(f"_next.{v}")
    value = F.when(F.col("_prev").isNull(), v1).when(F.col("_next").isNull() | (t0 == F.col(t)), v0).otherwise(v0 + (v1 - v0) * (F.col(t) - t0) / (t1 - t0))
    found = found.withColumn(out, value)
    if bracket:
        found = found.withColumn(f"{out}_t0", t0).withColumn(f"{out}_t1", t1)
    return found.drop("_prev", "_next")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], t: str, v: list[str], cell: float | None = None, prefix: str = "") -> DataFrame:
    """The left rows with the right series' last row at or before their times: t as prefix + 'at', and its v."""
    found = _brackets(left, right, by, t, v, cell, False)
    return found.withColumns({f"{prefix}at": F.col("_prev.t"), **{f"{prefix}{c}": F.col(f"_prev.{c}") for c in v}}).drop("_prev")


def resample(signal: DataFrame, by: list[str], t: str, v: str, dt: float, cell: float | None = None) -> DataFrame:
    """Each series on a uniform grid from its first time: at least two points, none past its last time but for that."""
    ends = signal.groupBy(*by).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    n = F.greatest(F.lit(2), F.floor((F.col("_t1") - F.col("_t0")) / dt + 1e-9).cast("int") + 1)
    grid = ends.select(*by, "_t0", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(*by, "i", (F.col("_t0") + F.col("i") * dt).alias(t))
    return lerp_join(grid, signal, by, t, v, v, cell)


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], t: str, lo: str, hi: str, width: float, closed: bool = True) -> DataFrame:
    """Each point with every interval that holds it; intervals may overlap.  `width` is the cell in which the two sides
    meet, best about as long as an interval, so that the join is by equality and no side need be small."""
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    at = points.withColumn("_cell", F.floor(F.col(t) / width))
    inside = (F.col(t) >= F.col(lo)) & ((F.col(t) <= F.col(hi)) if closed else (F.col(t) < F.col(hi)))
    return at.join(cells, [*by, "_cell"]).where(inside).drop("_cell")


def pair_transitions(transitions: DataFrame, by: list[str], t: str, direction: str) -> DataFrame:
    """The i-th rise with the i-th fall: seg_idx, t_rise, t_fall; pairs that fall before they rise are left out."""
    numbered = transitions.withColumn("seg_idx", F.row_number().over(over([*by, direction], t)) - 1)
    rise = numbered.where(F.col(direction) > 0).select(*by, "seg_idx", F.col(t).alias("t_rise"))
    fall = numbered.where(F.col(direction) < 0).select(*by, "seg_idx", F.col(t).alias("t_fall"))
    return rise.join(fall, [*by, "seg_idx"]).where("t_fall > t_rise")


def square_wave(grid: DataFrame, transitions: DataFrame, by: list[str], t: str, direction: str, low: float, high: float, out: str) -> DataFrame:
    """High after a rise, low after a fall; before the first transition the level opposite to it; low without any."""
    first = transitions.groupBy(*by).agg(F.min_by(direction, t).alias("_first"))
    found = asof_join(grid, transitions, by, t, [direction], prefix="_").join(first, by, "left")
    turned = F.coalesce(F.col(f"_{direction}"), -F.col("_first"))
    return found.withColumn(out, F.when(turned > 0, F.lit(high)).otherwise(F.lit(low))).drop("_at", f"_{direction}", "_first")


def _nearest(points: pa.Table, segments: pa.Table, at: list[str], px: str, py: str, order: str, most: int = 1_000_000) -> pa.Table:
    """The places `at` with their nearest segment's _d2, _o, _sx, _sy and _u; at most so many pairs are held at once."""
    if not (len(points) and len(segments)):
        points = points.slice(0, 0)
    segments = segments.sort_by(order)  # of equally near ones the first
    x, y = (points[c].cast(pa.float64()).to_numpy()[:, None] for c in (px, py))
    x0, y0, x1, y1 = (segments[c].cast(pa.float64()).to_numpy() for c in ("x0", "y0", "x1", "y1"))
    dx, dy = x1 - x0, y1 - y0
    length2 = dx * dx + dy * dy
    rows = max(1, most // max(1, len(segments)))
    found = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in range(0, len(points), rows):
            a, b = x[i : i + rows], y[i : i + rows]
            u = np.where(length2 > 0, np.clip(((a - x0) * dx + (b - y0) * dy) / length2, 0.0, 1.0), 0.0)
            d2 = (a - (x0 + u * dx)) ** 2 + (b - (y0 + u * dy)) ** 2
            k = np.where(np.isnan(d2), np.inf, d2).argmin(axis=1)
            own = np.arange(len(k))
            found.append((d2[own, k], k, u[own, k]))
    d2, k, u = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0), np.zeros(0, int), np.zeros(0))
    columns = [*[points[c] for c in at], pa.array(d2), segments[order].take(pa.array(k)), pa.array(x0[k] + u * dx[k]), pa.array(y0[k] + u * dy[k]), pa.array(u)]
    return pa.table(columns, names=[*at, "_d2", "_o", "_sx", "_sy", "_u"])


def nearest_segment(points: DataFrame, segments: DataFrame, by: list[str], px: str, py: str, order: str, cell: float, reach: int = 2) -> DataFrame:
    """Each point with its nearest segment (columns x0, y0, x1, y1, the first by `order` among equals): seg, snap_x,
    snap_y, frac and dist2.

    Points meet the segments of the cells around them; a point whose best is
    no nearer than the ring of cells searched goes on to one with all of its
    group's segments, so the answer is exact.
    """

    def measured(df: DataFrame) -> DataFrame:
        dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
        length2 = dx * dx + dy * dy
        u = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(px) - F.col("x0")) * dx + (F.col(py) - F.col("y0")) * dy) / length2))).otherwise(0.0)
        df = df.withColumn("_u", u).withColumn("_sx", F.col("x0") + F.col("_u") * dx).withColumn("_sy", F.col("y0") + F.col("_u") * dy)
        return df.withColumn("_d2", (F.col(px) - F.col("_sx")) ** 2 + (F.col(py) - F.col("_sy")) ** 2)

    def best(df: DataFrame) -> DataFrame:
        return df.groupBy(*at).agg(F.min(F.struct("_d2", F.col(order).alias("_o"), F.struct("_sx", "_sy", "_u").alias("_s"))).alias("_b"))

    # each place is measured once, whatever points are there, and only places travel
    at = [*by, px, py]
    tagged = points.select(*at).distinct()
    pieces = segments.withColumn("_n", F.greatest(F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) / cell).cast("int"), F.lit(1)))
    # every cell a segment's bounding pieces touch
    pieces = pieces.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    cells = pieces.withColumn("_cx", F.floor((F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("_k") / F.col("_n")) / cell)).withColumn("_cy", F.floor((F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("_k") / F.col("_n")) / cell))
    cells = cells.dropDuplicates([*by, order, "_cx", "_cy"]).drop("_n", "_k")
    ring = F.sequence(F.lit(-reach), F.lit(reach))
    around = tagged.withColumn("_ix", F.explode(ring)).withColumn("_iy", F.explode(ring)).withColumn("_cx", F.floor(F.col(px) / cell) + F.col("_ix")).withColumn("_cy", F.floor(F.col(py) / cell) + F.col("_iy"))
    # a cell's pairs are measured where they meet: what goes on is a row for each place and cell, not for each pair
    met = [*by, "_cx", "_cy"]
    known = " and ".join(f"`{c}` is not null" for c in met)
    kinds = {f.name: f.dataType for f in (*tagged.schema.fields, *segments.schema.fields)}
    schema = StructType([*[StructField(c, kinds[c]) for c in at], StructField("_d2", DoubleType()), StructField("_o", kinds[order]), *[StructField(c, DoubleType()) for c in ("_sx", "_sy", "_u")]])
    there = around.where(known).groupBy(*met).cogroup(cells.where(known).select(*met, order, "x0", "y0", "x1", "y1").groupBy(*met))
    near = there.applyInArrow(lambda points, segments: _nearest(points, segments, at, px, py, order), schema)
    near = near.groupBy(*at).agg(F.min(F.struct("_d2", "_o", F.struct("_sx", "_sy", "_u").alias("_s"))).alias("_b"))
    # sample points on a segment are at most a cell apart: within (reach - 1) cells nothing nearer can have been missed
    sure = near.where(F.col("_b._d2") <= ((reach - 1) * cell) ** 2)
    rest = tagged.join(sure, at, "left_anti")
    far = best(measured(rest.join(segments, by)))
    found = sure.unionByName(far).withColumnsRenamed({c: f"_at_{c}" for c in at})
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in at]
    return points.join(found, reduce(Column.__and__, same)).select(*points.columns, F.col("_b._o").alias("seg"), F.col("_b._s._sx").alias("snap_x"), F.col("_b._s._sy").alias("snap_y"), F.col("_b._s._u").alias("frac"), F.col("_b._d2").alias("dist2"))


def arc_length(df: DataFrame, by: list[str], order: list[str], x: str, y: str, out: str) -> DataFrame:
    """The length of the path up to each point."""
    df = cells.scan(cells.dealt(df, by, order), by, order, lags={"_before": F.struct(F.col(x).alias("x"), F.col(y).alias("y"))})
    step = F.coalesce(F.hypot(F.col(x) - F.col("_before.x"), F.col(y) - F.col("_before.y")), F.lit(0.0))
    return cells.scan(df, by, order, sums={out: step}).drop("_before", "_cell")


def stroke_ids(df: DataFrame, by: list[str], order: list[str], is_break: Column, out: str = "stroke") -> DataFrame:
    """Numbers strokes from 0; a row that is a break begins one."""
    w = over(by, *order)
    first = F.row_number().over(w) == 1
    df = df.withColumn("_brk", (F.coalesce(is_break, F.lit(False)) & ~first).cast("long"))
    return df.withColumn(out, F.sum("_brk").over(w.rowsBetween(PAST, HERE))).drop("_brk")


def decimate(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Every k-th row of a series, with the least k that leaves at most `most`."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(over(by, *order)) - 1
    return df.withColumn("_n", n).withColumn("_i", i).where(F.col("_i") % F.greatest(F.ceil(F.col("_n") / most), F.lit(1)) == 0).drop("_n", "_i")


def heads(df: DataFrame, by: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first n rows of each series."""
    return df.withColumn("_i", F.row_number().over(over(by, *order))).where(F.col("_i") <= n).drop("_i")


def evenly_spaced(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of a series whose numbers are evenly spaced, both ends included."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    i = F.row_number().over(over(by, *order)) - 1
    df = df.withColumn("_n", n).withColumn("_i", i)
    step = (F.col("_n") - 1) / F.lit(max(1, most - 1))
    # row i is picked if some k has floor(k * step) = i
    k = F.ceil(F.col("_i") / step - 1e-9)
    picked = (F.col("_n") <= most) | ((F.floor(k * step + 1e-9) == F.col("_i")) & (k < most))
    return df.where(picked).drop("_n", "_i")


# --- streams in batch form (A-37, T-01, T-04, P-16) ---


def monotone_only(df: DataFrame, by: list[str], arrival: list[str], t: str) -> DataFrame:
    """Drops rows older than the newest that arrived before them."""
    found = cells.scan(cells.dealt(df, by, arrival), by, arrival, highs={"_newest": F.col(t)})
    return found.where((F.col(t) >= F.col("_newest")) | F.col("_newest").isNull()).drop("_newest", "_cell")


def losses(df: DataFrame, by: list[str], arrival: list[str], seq: str, limit: int = 10_000) -> DataFrame:
    """Rows after a gap in sequence numbers: lost, the numbers missing; steps back and gaps from `limit` are resets."""
    found = cells.scan(cells.dealt(df, by, arrival), by, arrival, lags={"_seq": F.col(seq)})
    return found.withColumn("lost", F.col(seq) - F.col("_seq") - 1).where((F.col("lost") > 0) & (F.col("lost") < limit)).drop("_seq", "_cell")


def clock_offset(df: DataFrame, by: list[str], arrival: list[str], ticks: str, recv: str, scale: float, window: int = 512, wrap: int = 1 << 32) -> DataFrame:
    """Counters mapped to host time: `unwrapped` ticks, the least of recv - ticks * scale over the last `window` rows as
    `offset`, and `emit`, their sum.  A counter that steps back by over half its range has wrapped; one that steps back
    less has restarted, and a new epoch begins."""
    df = cells.scan(cells.dealt(df, by, arrival), by, arrival, lags={"_before": F.col(ticks)}, sums={"_place": F.lit(1).cast("long")})
    back = F.col("_before") - F.col(ticks)
    wrapped, reset = F.coalesce((back > wrap // 2).cast("long"), F.lit(0)), F.coalesce(((back > 0) & (back <= wrap // 2)).cast("long"), F.lit(0))
    df = materialise(df.withColumns({"_wrap": wrapped, "_reset": reset, "_place": F.col("_place") - 1}), "steps")
    df = materialise(cells.scan(df, by, arrival, sums={"epoch": F.col("_reset"), "_wraps": F.col("_wrap")}), "epochs")
    df = cells.scan(df, by, arrival, lasts={"_since": F.when(F.col("_reset") == 1, F.col("_wraps"))})
    df = df.withColumn("unwrapped", F.col(ticks) + F.lit(wrap) * (F.col("_wraps") - F.coalesce("_since", F.lit(0))))
    df = cells.framed(df.withColumn("_delay", F.col(recv) - F.col("unwrapped") * scale), by, window - 1, 0, {"offset": lambda w: F.min("_delay").over(w)}, ["epoch"])
    return df.withColumn("emit", F.col("unwrapped") * scale + F.col("offset")).drop("_wrap", "_reset", "_before", "_place", "_wraps", "_since", "_delay", "_cell")


# --- latches, fills and thinning (W-11, W-12, W-35, T-11) ---


def direction_latch(df: DataFrame, by: list[str], order: list[str], col: str, out: str, least: float = 0.005) -> DataFrame:
    """The sign of the last step of at least `least`; zero before the first."""
    df = cells.scan(cells.dealt(df, by, order), by, order, lags={"_before": F.col(col)})
    step = F.col(col) - F.col("_before")
    df = cells.scan(df, by, order, lasts={"_sign": F.when(F.abs(step) >= least, F.signum(step))})
    return df.withColumn(out, F.coalesce("_sign", F.lit(0.0))).drop("_sign", "_before", "_cell")


def signed_runs(df: DataFrame, by: list[str], x: str, y: str, reference: float = 0.0) -> DataFrame:
    """Points (by, x, y, run, above) of the curve, parted where it crosses the reference; the interpolated crossing ends
    one run and begins the next."""
    w = over(by, x)
    above = F.col(y) >= reference
    rows = df.select(*by, x, y, above.alias("above"), F.lag(x).over(w).alias("_x0"), F.lag(y).over(w).alias("_y0")).withColumn("_turn", F.coalesce((F.col("_y0") >= reference) != F.col("above"), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("_turn").cast("int")).over(w.rowsBetween(PAST, HERE)))
    at = F.col("_x0") + (F.col(x) - F.col("_x0")) * F.try_divide(F.lit(reference) - F.col("_y0"), F.col(y) - F.col("_y0"))
    cross = rows.where("_turn").select(*by, at.alias(x), F.lit(float(reference)).alias(y), F.explode(F.array(F.struct((F.col("run") - 1).alias("run"), (~F.col("above")).alias("above")), F.struct(F.col("run").alias("run"), F.col("above").alias("above")))).alias("_r"))
    return rows.select(*by, x, y, "run", "above").unionByName(cross.select(*by, x, y, "_r.run", "_r.above"))


def thinned(df: DataFrame, by: list[str], order: list[str], most: int = 60_000) -> DataFrame:
    """Every second row dropped as often as it takes to leave at most `most` of a series."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    stride = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(n / most)))).cast("bigint")
    i = F.row_number().over(over(by, *order)) - 1
    return df.withColumn("_s", stride).withColumn("_i", i).where(F.col("_i") % F.col("_s") == 0).drop("_s", "_i")


def transition_areas(signal: DataFrame, transitions: DataFrame, by: list[str], t: str, v: str, direction: str, half: float = 0.075) -> DataFrame:
    """(by, area): rises count up and falls down, each over a window around it that ends half-way to its neighbours,
    against the mean of the window itself."""
    w = over(by, t)
    lo = F.greatest(F.col(t) - half, F.coalesce((F.col(t) + F.lag(t).over(w)) / 2, F.col(t) - half))
    hi = F.least(F.col(t) + half, F.coalesce((F.col(t) + F.lead(t).over(w)) / 2, F.col(t) + half))
    windows = transitions.select(*by, F.col(t).alias("_at"), F.col(direction).alias("_dir"), lo.alias("_lo"), hi.alias("_hi"))
    inside = interval_join(signal.select(*by, t, v), windows, by, t, "_lo", "_hi", max(4 * half, 1e-3))
    keys = [*by, "_at", "_dir"]
    inside = inside.withColumn("_y", F.col(v) - F.avg(v).over(Window.partitionBy(*keys)))
    inner = over(keys, t)
    step = (F.col("_y") + F.lead("_y").over(inner)) / 2 * (F.lead(t).over(inner) - F.col(t))
    return inside.withColumn("_a", step * F.signum("_dir")).groupBy(*by).agg(F.sum("_a").alias("area"))
