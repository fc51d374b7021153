"""Series operators: a user's events are a run, their values its signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.operators import cells, flow, livemap, phase, robust, series
from sensorloom.queries.curves import rounded, table
from sensorloom.streaming import placement

DAY = 86_400.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", t.alias("t"), "ts", "props")


_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1e6 AS t, ts, props FROM events)"


def event_gaps_dropouts(spark, sf_dir):
    found = robust.dropouts(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "t", "value", factor=3.0, least_gap=60.0, spread=10.0)
    return rounded(found.select("user_id", "event_id", "gap", "jump"))


def rolling_stats(spark, sf_dir):
    df = events(spark, sf_dir)
    by, order = ["user_id"], ["t"]
    df = series.rolling_median(df, by, order, "value", 15, "med15")
    df = series.rolling_std(df, by, order, "value", 10, "std10")
    df = series.moving_average_zero(df, by, order, "value", 5, "zero5")
    df = series.moving_average_held(df, by, order, "value", 5, "held5")
    return rounded(df.select("event_id", "med15", "std10", "zero5", "held5"))


def gradients(spark, sf_dir):
    df = events(spark, sf_dir)
    df = series.gradient(df, ["user_id"], ["t"], "value", "per_row")
    df = series.gradient(df, ["user_id"], ["t"], "value", "per_second", "t")
    df = series.difference(df, ["user_id"], ["t"], "value", "step")
    df = series.detrend(df, ["user_id"], ["t"], "value", "flat")
    return rounded(df.select("event_id", "per_row", "per_second", "step", "flat"))


def _flagged(spark, sf_dir):
    df = events(spark, sf_dir)
    mid = df.groupBy("user_id").agg(F.median("value").alias("mid"))
    return df.join(mid, "user_id").withColumn("on", F.col("value") > F.col("mid"))


def active_runs(spark, sf_dir):
    """Runs above the user's median, merged over gaps of up to twelve hours, and the one with the largest sum."""
    runs = series.bridged_runs(_flagged(spark, sf_dir), ["user_id"], ["t"], "on", "t", 43_200.0, extra=[F.sum("value").alias("energy")])
    return rounded(series.best_run(runs, ["user_id"], F.round("energy", 6)).select("user_id", "run", "t_start", "t_end", "n", "energy"))


def plain_runs(spark, sf_dir):
    return rounded(series.true_runs(_flagged(spark, sf_dir), ["user_id"], ["t"], "on", "t"))


def contact_detect(spark, sf_dir):
    """The first of three rows in a row above the median."""
    df = series.consecutive(_flagged(spark, sf_dir), ["user_id"], ["t"], "on", 3, "hit")
    return rounded(df.where("hit").groupBy("user_id").agg(F.min("t").alias("t_contact"), F.min_by("event_id", "t").alias("event_id")))


def trapz_area(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("h", F.col("t") / 3600).withColumn("c", F.col("value") - 50)
    signed = robust.trapezoid(df, ["user_id"], ["t"], "h", "c", "signed_area")
    return rounded(signed.join(robust.trapezoid(df, ["user_id"], ["t"], "h", "c", "abs_area", True), "user_id"), 4)


def noise_corrected_peak(spark, sf_dir):
    df = events(spark, sf_dir)
    stats = df.groupBy("user_id").agg(F.median("value").alias("level"), F.stddev_pop("value").alias("sigma"))
    joined = df.join(stats, "user_id")
    return rounded(joined.groupBy("user_id").agg(robust.corrected_peak(F.first("level"), F.col("value"), F.first("sigma")).alias("peak"), robust.first_extreme("t", "value").alias("t_peak"), robust.first_extreme("t", "value", False).alias("t_trough")))


def _kind(df, kind):
    return df.where(F.col("event_type") == kind)


def lerp_users(spark, sf_dir):
    df = events(spark, sf_dir)
    found = series.lerp_join(_kind(df, "view").select("user_id", "event_id", "t"), _kind(df, "click").select("user_id", "t", "value"), ["user_id"], "t", "value", "y", cell=5 * DAY)
    return rounded(found.select("user_id", "event_id", "y"))


def placed_live(spark, sf_dir):
    """Clicks placed on the path that views (x) and purchases (y) draw, each point reaching two days."""
    df = events(spark, sf_dir).withColumnRenamed("user_id", "run_id")
    axis = F.when(F.col("event_type") == "view", "x").when(F.col("event_type") == "purchase", "y")
    force = _kind(df, "click").select("run_id", F.col("event_id").alias("seq"), "t", F.col("value").alias("v"))
    return rounded(placement.placed(force, df.select("run_id", axis.alias("axis"), "t", F.col("value").alias("v")), 2 * DAY, 5 * DAY))


def _grids(spark, sf_dir):
    """A user's events as a sweep of eight steps, each a tenth of their time, the first tenth being idle."""
    df = events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "t", F.col("value").alias("v"))
    ends = df.groupBy("run_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).withColumn("dwell_s", (F.col("b") - F.col("a")) / 10)
    levels = ends.select("run_id", "dwell_s", F.lit(0.4).alias("settle_frac"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("level_idx"))
    return df, ends.select("run_id", (F.col("a") + F.col("dwell_s")).alias("t_start")), levels


def grid_phase(spark, sf_dir):
    """How far each sweep's start moves, so that rises fall outside the measured parts of steps."""
    df, sweep, levels = _grids(spark, sf_dir)
    moved = flow.align_grid(df, sweep, levels).withColumnRenamed("t_start", "aligned").join(sweep, "run_id")
    return moved.select("run_id", F.round(F.col("aligned") - F.col("t_start"), 2).alias("moved"))


def shift_rises(spark, sf_dir):
    """The rise that each shift of the grid leaves in the measured parts of steps, from the steps up between events."""
    df, sweep, levels = _grids(spark, sf_dir)
    rises = series.difference(df, ["run_id"], ["t"], "v", "g").where("g > 0")
    grids = sweep.join(levels.groupBy("run_id").agg(F.max("dwell_s").alias("width")), "run_id").withColumns({"settle": F.lit(0.4), "clean": F.lit(4)})
    found = flow.shift_scores(rises.select("run_id", "t", "g"), grids)
    return found.select("run_id", "shift", F.round("score", 4).alias("score"))


def asof_last_type(spark, sf_dir):
    df = events(spark, sf_dir)
    found = series.asof_join(_kind(df, "error").select("user_id", "event_id", "t"), _kind(df, "signup").select("user_id", "t", "value"), ["user_id"], "t", ["value"], cell=5 * DAY)
    return rounded(found.select("user_id", "event_id", "at", "value"))


def _windows(spark, sf_dir):
    ends = events(spark, sf_dir).agg(F.floor(F.min("t") / DAY).alias("a"), F.floor(F.max("t") / DAY).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.select("day", (F.col("day") * DAY).alias("lo"), (F.col("day") * DAY + 1.5 * DAY).alias("hi"), F.lit(1).alias("one"))


def interval_assign(spark, sf_dir):
    """Windows of 36 hours every 24."""
    points = events(spark, sf_dir).withColumn("one", F.lit(1))
    found = series.interval_join(points, _windows(spark, sf_dir), ["one"], "t", "lo", "hi", DAY)
    return rounded(found.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


def coverage_per_window(spark, sf_dir):
    """Per user and window, the rows there are against those that the user's mean rate asks for."""
    df = events(spark, sf_dir)
    rate = df.groupBy("user_id").agg(((F.count(F.lit(1)) - 1) / (F.max("t") - F.min("t"))).alias("rate"))
    found = series.interval_join(df.withColumn("one", F.lit(1)), _windows(spark, sf_dir), ["one"], "t", "lo", "hi", DAY)
    counted = found.groupBy("user_id", "day", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).join(rate, "user_id")
    # the rate is per day here, so that it is above the floor of one a unit
    value = robust.coverage(F.col("n"), F.col("lo") / DAY, F.col("hi") / DAY, F.col("rate") * DAY)
    return rounded(counted.select("user_id", "day", "n", value.alias("coverage")))


def resample_grid(spark, sf_dir):
    df = events(spark, sf_dir).select("user_id", (F.col("t") / 3600).alias("h"), "value")
    found = series.resample(df, ["user_id"], "h", "value", 6.0, cell=240.0)
    return rounded(found.select("user_id", "i", "value"), 5)


def flow_levels(spark, sf_dir):
    """Per size (the level) the quantity's mean and deviation, and where the deviation first exceeds that of the quiet
    levels, or the mean falls below its peak."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("level"))
    stats = lines.join(parts, "p_partkey").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std"))
    from sensorloom.operators.flow import breakdown

    marks = breakdown(stats.withColumn("run", F.lit(1)).withColumn("predicted", F.lit(None).cast("double")).withColumn("sigma", F.lit(None).cast("double")), ["run"], var_factor=1.02, collapse=0.02)
    return rounded(stats.crossJoin(F.broadcast(marks.select("variance_onset", "collapse_level", "recommended"))))  # one row


def feature_stats(spark, sf_dir):
    df = events(spark, sf_dir)
    return rounded(df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.9).alias("p90"), F.percentile("value", 0.02).alias("p02"), F.percentile("value", 0.98).alias("p98")))


def arc_length(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("h", F.col("t") / 3600)
    return rounded(series.arc_length(df, ["user_id"], ["t"], "h", "value", "s").select("event_id", "s"), 4)


def _segments(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    w = Window.partitionBy("label").orderBy("vec_id")
    return vec, vec.select("label", F.col("vec_id").alias("seg_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")


def nearest_segment(spark, sf_dir):
    """Each vector's first two components against the path of its neighbour label's."""
    vec, segs = _segments(spark, sf_dir)
    points = vec.select("vec_id", F.pmod(F.col("label") + 1, F.lit(10)).alias("label"), "x", "y")
    return rounded(series.nearest_segment(points, segs, ["label"], "x", "y", "seg_id", 0.1).select("vec_id", "seg", "snap_x", "snap_y", "frac"), 5)


def line_breaks(spark, sf_dir):
    df = events(spark, sf_dir)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t"))
    df = series.stroke_ids(df.withColumn("gap", gap), ["user_id"], ["t"], F.col("gap") > 43_200)
    return df.select("event_id", "stroke")


def seq_loss(spark, sf_dir):
    df = table(spark, sf_dir, "events")  # a type's ids have gaps: the events of the others
    return series.losses(df, ["event_type"], ["event_id"], "event_id").select("event_type", "event_id", "lost")


def rates_hourly(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", "total")


def clock_offset(spark, sf_dir):
    """Counters of microseconds that wrap at 2 ** 32, received with a delay that depends on the value."""
    df = events(spark, sf_dir).select("event_type", "event_id", "t", ((F.col("t") * 1e6).cast("bigint") % (1 << 32)).alias("ticks"), (F.col("t") + F.col("value") / 1000).alias("recv"))
    found = series.clock_offset(df, ["event_type"], ["event_id"], "ticks", "recv", 1e-6)
    return rounded(found.select("event_id", "epoch", "unwrapped", "offset"), 3)


def monotone_only(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("late", F.col("t") - F.col("value") * 600)
    return series.monotone_only(df, ["user_id"], ["event_id"], "late").select("event_id")


def drift_rates(spark, sf_dir):
    df = events(spark, sf_dir)
    a = robust.drift(df, ["user_id"], ["t"], "value")
    return rounded(a.join(robust.sample_rate(df.withColumn("h", F.col("t") / 3600), ["user_id"], ["h"], "h"), "user_id"), 5)


def square_wave(spark, sf_dir):
    """Levels from the last 'signup' (rise) or 'error' (fall) before each 'view'."""
    df = events(spark, sf_dir)
    turns = df.where(F.col("event_type").isin("signup", "error")).select("user_id", "t", F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("dir"))
    return series.square_wave(_kind(df, "view").select("user_id", "event_id", "t"), turns, ["user_id"], "t", "dir", 0.8, 8.0, "v").select("event_id", "v")


def paired_transitions(spark, sf_dir):
    df = events(spark, sf_dir)
    turns = df.where(F.col("event_type").isin("signup", "error")).select("user_id", "t", F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("dir"))
    return rounded(series.pair_transitions(turns, ["user_id"], "t", "dir"))


def decimated(spark, sf_dir):
    df = events(spark, sf_dir)
    a = series.decimate(df, ["user_id"], ["t"], 20).select("event_id", F.lit("stride").alias("how"))
    return a.unionByName(series.evenly_spaced(df, ["user_id"], ["t"], 20).select("event_id", F.lit("even").alias("how")))


def top_values(spark, sf_dir):
    """The report's twenty most frequent whole values."""
    df = table(spark, sf_dir, "events").groupBy(F.floor("value").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(F.desc("n"), "v").limit(20)


def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_FLAG = f"{_E}, f AS (SELECT *, value > median(value) OVER (PARTITION BY user_id) AS on_ FROM e)"
_TURNS = "turns AS (SELECT user_id, t, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS dir FROM e WHERE event_type IN ('signup', 'error'))"
_DAYS = "days AS (SELECT unnest(range(CAST(floor(min(t) / 86400) AS BIGINT), CAST(floor(max(t) / 86400) AS BIGINT) + 1)) AS day FROM e), win AS (SELECT day, day * 86400.0::DOUBLE AS lo, day * 86400.0::DOUBLE + 129600 AS hi FROM days)"

def _at(axis, kind):
    """SQL: the axis at each click, from the nearest points within two days."""
    near = "CASE WHEN abs(f.t - p.t) <= 172800 THEN p.{} END AS {}"
    cut = lambda c, name: near.format(c, name)
    return f"""{axis}p AS (SELECT user_id, t, value AS v FROM e WHERE event_type = '{kind}'),
{axis}b AS (SELECT f.event_id, f.user_id, f.t, {cut("t", "t0")}, {cut("v", "v0")} FROM f ASOF LEFT JOIN {axis}p p ON f.user_id = p.user_id AND f.t >= p.t),
{axis}a AS (SELECT f.*, {cut("t", "t1")}, {cut("v", "v1")} FROM {axis}b f ASOF LEFT JOIN {axis}p p ON f.user_id = p.user_id AND f.t < p.t),
{axis} AS (SELECT event_id, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS {axis} FROM {axis}a)"""


_GRID = f"""{_E}, i AS (SELECT user_id, (max(t) - min(t)) / 10 AS w, min(t) + (max(t) - min(t)) / 10 AS t0 FROM e GROUP BY user_id)"""
_SHIFTED = """m AS (SELECT user_id, j, g, w, (CAST(round((t - t0) * 1e6) AS BIGINT) * 120 + (60 - j) * CAST(round(w * 1e6) AS BIGINT)) AS x, 120 * CAST(round(w * 1e6) AS BIGINT) AS wide, 120 * CAST(round(0.4::DOUBLE * w * 1e6) AS BIGINT) AS settle FROM g, (SELECT unnest(range(0, 121)) AS j) WHERE g > 0),
sc AS (SELECT user_id, j, w, sum(CASE WHEN x >= 0 AND x < 4 * wide AND x % wide >= settle THEN CAST(round(g, 9) AS DECIMAL(28, 9)) ELSE 0 END)::DOUBLE AS score FROM m GROUP BY ALL)"""


QUERIES = {f.__name__: f for f in (event_gaps_dropouts, rolling_stats, gradients, active_runs, plain_runs, contact_detect, trapz_area, noise_corrected_peak, lerp_users, placed_live, grid_phase, shift_rises, asof_last_type, interval_assign, coverage_per_window, resample_grid, flow_levels, feature_stats, arc_length, nearest_segment, line_breaks, seq_loss, rates_hourly, clock_offset, monotone_only, drift_rates, square_wave, paired_transitions, decimated, top_values, json_props)}
ORACLES = {
    "event_gaps_dropouts": f"""WITH {_E}, s AS (SELECT *, t - lag(t) OVER w AS gap, abs(value - lag(value) OVER w) AS jump FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
st AS (SELECT user_id, median(gap) AS mid, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS spread, count(*) AS n FROM s GROUP BY user_id)
SELECT user_id, event_id, round(gap, 6) AS gap, round(jump, 6) AS jump FROM s JOIN st USING (user_id) WHERE n >= 10 AND spread > 10 AND gap > greatest(3 * mid, 60) AND jump > 0.5 * spread""",
    "rolling_stats": f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
pad AS (SELECT a.event_id, b.value FROM n a, (SELECT unnest(range(-7, 8)) AS o), n b WHERE a.user_id = b.user_id AND b.i = greatest(1, least(a.n, a.i + o))),
med AS (SELECT event_id, median(value) AS med15 FROM pad GROUP BY event_id),
fr AS (SELECT *, stddev_pop(value) OVER (w ROWS 9 PRECEDING) AS std10, sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS zero5, CASE WHEN i > 2 AND i <= n - 2 THEN avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS whole FROM n WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(med15, 6) AS med15, round(std10, 6) AS std10, round(zero5, 6) AS zero5, round(coalesce(whole, CASE WHEN i <= 2 THEN first_value(whole IGNORE NULLS) OVER v ELSE last_value(whole IGNORE NULLS) OVER v END, avg(value) OVER (PARTITION BY user_id)), 6) AS held5
FROM fr JOIN med USING (event_id) WINDOW v AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "gradients": f"""WITH {_E}, n AS (SELECT *, row_number() OVER w AS i, lag(value) OVER w AS y0, lead(value) OVER w AS y2, t - lag(t) OVER w AS a, lead(t) OVER w - t AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
ln AS (SELECT user_id, regr_slope(value, i) AS m, regr_intercept(value, i) AS c, avg(value) AS av, count(*) AS n FROM n GROUP BY user_id)
SELECT event_id, round(CASE WHEN y0 IS NULL THEN y2 - value WHEN y2 IS NULL THEN value - y0 ELSE (y2 - y0) / 2 END, 6) AS per_row,
round(CASE WHEN y0 IS NULL THEN (y2 - value) / b WHEN y2 IS NULL THEN (value - y0) / a ELSE (a*a*y2 - b*b*y0 + (b*b - a*a)*value) / (a*b*(a+b)) END, 6) AS per_second,
round(value - y0, 6) AS step, round(CASE WHEN ln.n < 4 THEN value - av ELSE value - (m * i + c) END, 6) AS flat FROM n JOIN ln USING (user_id)""",
    "active_runs": f"""WITH {_FLAG}, p AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS before FROM f WHERE on_),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM p),
sp AS (SELECT user_id, run, min(t) AS a, max(t) AS b FROM r GROUP BY 1, 2),
g AS (SELECT sp.user_id, run, a, b, count(*) AS n, sum(value) AS energy FROM sp JOIN e ON e.user_id = sp.user_id AND e.t BETWEEN a AND b GROUP BY 1, 2, 3, 4)
SELECT user_id, CAST(run AS BIGINT) AS run, round(a, 6) AS t_start, round(b, 6) AS t_end, n, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(energy, 6) DESC, a) AS k FROM g) WHERE k = 1""",
    "plain_runs": f"""WITH {_FLAG}, p AS (SELECT *, on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY t), false) AS new FROM f),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM p)
SELECT user_id, CAST(run AS BIGINT) AS run, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, count(*) AS n FROM r WHERE on_ GROUP BY 1, 2""",
    "contact_detect": f"""WITH {_FLAG}, h AS (SELECT *, on_ AND lead(on_) OVER w AND lead(on_, 2) OVER w AS hit FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(min(t), 6) AS t_contact, arg_min(event_id, t) AS event_id FROM h WHERE hit GROUP BY user_id""",
    "trapz_area": f"""WITH {_E}, s AS (SELECT user_id, value - 50 AS c, lead(value) OVER w - 50 AS d, (lead(t) OVER w - t) / 3600 AS h, lead(t / 3600) OVER w - t / 3600 AS g FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(sum((c + d) / 2 * g), 4) AS signed_area, round(sum((abs(c) + abs(d)) / 2 * g), 4) AS abs_area FROM s GROUP BY user_id""",
    "noise_corrected_peak": f"""WITH {_E} SELECT user_id, round(max(value) - median(value) - stddev_pop(value) * sqrt(2 * ln(greatest(count(*), 2))), 6) AS peak, round(arg_min(t, {{'a': -value, 'b': t}}), 6) AS t_peak, round(arg_min(t, {{'a': value, 'b': t}}), 6) AS t_trough FROM e GROUP BY user_id""",
    "lerp_users": f"""WITH {_E}, a AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'view'), b AS (SELECT user_id, t, value FROM e WHERE event_type = 'click'),
p AS (SELECT a.*, b.t AS t0, b.value AS v0 FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t),
q AS (SELECT p.*, b.t AS t1, b.value AS v1 FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.t < b.t)
SELECT user_id, event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS y FROM q""",
    "placed_live": f"""WITH {_E}, f AS (SELECT user_id, event_id, t, value FROM e WHERE event_type = 'click'), {_at("x", "view")}, {_at("y", "purchase")}
SELECT user_id AS run_id, event_id AS seq, round(t, 6) AS t, round(value, 6) AS v, round(x, 6) AS x, round(y, 6) AS y FROM f JOIN x USING (event_id) JOIN y USING (event_id) WHERE x IS NOT NULL AND y IS NOT NULL""",
    "grid_phase": f"""WITH {_GRID}, near AS (SELECT e.user_id, event_id, t, value, w, t0 FROM e JOIN i USING (user_id) WHERE t >= t0 - w AND t <= t0 + 5 * w),
s AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY CAST(round(t * 1e6) AS BIGINT) RANGE BETWEEN 40000 PRECEDING AND 40000 FOLLOWING) AS y FROM near),
n AS (SELECT *, lag(y) OVER o AS y0, lead(y) OVER o AS y2 FROM s WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)),
g AS (SELECT user_id, t, w, t0, CASE WHEN y0 IS NULL THEN y2 - y WHEN y2 IS NULL THEN y - y0 ELSE (y2 - y0) / 2 END AS g FROM n), {_SHIFTED},
b AS (SELECT user_id, w, min(j) FILTER (WHERE j >= 60) AS up, max(j) FILTER (WHERE j <= 60) AS down FROM (SELECT *, min(score) OVER (PARTITION BY user_id) AS least FROM sc) WHERE score <= least * 1.05::DOUBLE + 1e-9 GROUP BY ALL)
SELECT user_id AS run_id, coalesce(round(w * (CASE WHEN down IS NULL OR up - 60 < 60 - down THEN up ELSE down END / 120 - 0.5::DOUBLE), 2), 0) AS moved FROM i LEFT JOIN b USING (user_id, w)""",
    "shift_rises": f"""WITH {_GRID}, d AS (SELECT user_id, t, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS g FROM e), g AS (SELECT d.user_id, t, g, w, t0 FROM d JOIN i USING (user_id)), {_SHIFTED}
SELECT i.user_id AS run_id, CAST(k.j AS BIGINT) AS shift, round(coalesce(score, 0), 4) AS score FROM i CROSS JOIN (SELECT unnest(range(0, 121)) AS j) k LEFT JOIN sc ON sc.user_id = i.user_id AND sc.j = k.j""",
    "asof_last_type": f"""WITH {_E}, a AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'error'), b AS (SELECT user_id, t, value FROM e WHERE event_type = 'signup')
SELECT a.user_id, a.event_id, round(b.t, 6) AS "at", round(b.value, 6) AS value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t""",
    "interval_assign": f"""WITH {_E}, {_DAYS} SELECT day, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM win JOIN e ON t BETWEEN lo AND hi GROUP BY day""",
    "coverage_per_window": f"""WITH {_E}, {_DAYS}, r AS (SELECT user_id, (count(*) - 1) / (max(t) - min(t)) * 86400 AS rate FROM e GROUP BY user_id),
c AS (SELECT user_id, day, lo, hi, count(*) AS n FROM win JOIN e ON t BETWEEN lo AND hi GROUP BY ALL)
SELECT user_id, day, n, round(least(1.0, n / greatest(1.0, (hi - lo) / 86400 * greatest(rate, 1.0))), 6) AS coverage FROM c JOIN r USING (user_id)""",
    "resample_grid": f"""WITH {_E}, s AS (SELECT user_id, t / 3600 AS t, value FROM e), ends AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM s GROUP BY user_id),
g AS (SELECT user_id, i, t0 + i * 6.0::DOUBLE AS t FROM (SELECT user_id, t0, unnest(range(0, greatest(2, CAST(floor((t1 - t0) / 6.0::DOUBLE + 1e-9) AS BIGINT) + 1))) AS i FROM ends)),
p AS (SELECT g.*, s.t AS a0, s.value AS v0 FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.t >= s.t),
q AS (SELECT p.*, s.t AS a1, s.value AS v1 FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t < s.t)
SELECT user_id, CAST(i AS INTEGER) AS i, round(CASE WHEN a0 IS NULL THEN v1 WHEN a1 IS NULL OR a0 = t THEN v0 ELSE v0 + (v1 - v0) * (t - a0) / (a1 - a0) END, 5) AS value FROM q""",
    "flow_levels": """WITH st AS (SELECT p_size AS level, count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
nu AS (SELECT *, row_number() OVER (ORDER BY level) AS i, count(*) OVER () AS m FROM st), k AS (SELECT *, least(m, greatest(5, CAST(round_even(0.45 * m, 0) AS BIGINT))) AS f FROM nu),
q AS (SELECT median(std) AS quiet FROM k WHERE i <= f AND std > 0), pk AS (SELECT arg_min(i, {'a': -mean, 'b': i}) AS pi, max(mean) AS pm FROM k),
v AS (SELECT min(level) AS variance_onset FROM k, q WHERE i > f AND std > 1.02 * quiet), c AS (SELECT min(level) AS collapse_level FROM k, pk WHERE i > pi AND mean < pm * 0.98)
SELECT level, n, round(mean, 6) AS mean, round(std, 6) AS std, variance_onset, collapse_level, round(coalesce(round_even(variance_onset * 0.85, 2), round_even(collapse_level * 0.85, 2), (SELECT max(level) FROM k)::DOUBLE), 6) AS recommended FROM st, v, c""",
    "feature_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.02), 6) AS p02, round(quantile_cont(value, 0.98), 6) AS p98 FROM events GROUP BY event_type",
    "arc_length": f"""WITH {_E}, s AS (SELECT user_id, event_id, t, coalesce(sqrt(pow(t / 3600 - lag(t / 3600) OVER w, 2) + pow(value - lag(value) OVER w, 2)), 0) AS d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(sum(d) OVER (PARTITION BY user_id ORDER BY t), 4) AS s FROM s""",
    "nearest_segment": """WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT * FROM (SELECT label, vec_id AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE x1 IS NOT NULL),
m AS (SELECT vec_id, seg, x, y, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, CASE WHEN (x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) > 0 THEN greatest(0.0, least(1.0, ((x - x0)*(x1-x0) + (y - y0)*(y1-y0)) / ((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)))) ELSE 0.0 END AS u FROM v JOIN s ON s.label = (v.label + 1) % 10),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pow(x - (x0 + u*dx), 2) + pow(y - (y0 + u*dy), 2), seg) AS r FROM m)
SELECT vec_id, seg, round(x0 + u*dx, 5) AS snap_x, round(y0 + u*dy, 5) AS snap_y, round(u, 5) AS frac FROM b WHERE r = 1""",
    "line_breaks": f"""WITH {_E}, s AS (SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS b FROM e)
SELECT event_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS stroke FROM s""",
    "seq_loss": """WITH s AS (SELECT event_type, event_id, event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS lost FROM events)
SELECT event_type, event_id, lost FROM s WHERE lost > 0 AND lost < 10000""",
    "rates_hourly": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "clock_offset": """WITH d AS (SELECT event_type, event_id, CAST(epoch_us(ts) / 1e6 * 1e6 AS BIGINT) % 4294967296 AS ticks, epoch_us(ts) / 1e6 + value / 1000 AS recv FROM events),
b AS (SELECT *, lag(ticks) OVER (PARTITION BY event_type ORDER BY event_id) - ticks AS back FROM d),
e AS (SELECT *, sum(CASE WHEN back > 0 AND back <= 2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS epoch FROM b),
u AS (SELECT *, ticks + 4294967296 * sum(CASE WHEN back > 2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, epoch ORDER BY event_id) AS unwrapped FROM e)
SELECT event_id, CAST(epoch AS BIGINT) AS epoch, CAST(unwrapped AS BIGINT) AS unwrapped, round(min(recv - unwrapped * 1e-6) OVER (PARTITION BY event_type, epoch ORDER BY event_id ROWS 511 PRECEDING), 3) AS "offset" FROM u""",
    "monotone_only": f"""WITH {_E}, l AS (SELECT user_id, event_id, t - value * 600 AS late FROM e), n AS (SELECT *, max(late) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM l)
SELECT event_id FROM n WHERE newest IS NULL OR late >= newest""",
    "drift_rates": f"""WITH {_E}, n AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, (t / 3600) - lag(t / 3600) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(avg(value) FILTER (i >= n // 2) - avg(value) FILTER (i < n // 2), 5) AS drift, count(*) AS n,
round((count(*) - 1) / (max(t / 3600) - min(t / 3600)), 5) AS rate_steps, round(1.0 / median(dt), 5) AS rate_median, round(count(*) / (max(t / 3600) - min(t / 3600)), 5) AS rate_rows FROM n GROUP BY user_id""",
    "square_wave": f"""WITH {_E}, {_TURNS}, f AS (SELECT user_id, arg_min(dir, t) AS d0 FROM turns GROUP BY user_id), a AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'view')
SELECT event_id, CASE WHEN coalesce(turns.dir, -d0) > 0 THEN 8.0::DOUBLE ELSE 0.8::DOUBLE END AS v FROM a ASOF LEFT JOIN turns ON a.user_id = turns.user_id AND a.t >= turns.t LEFT JOIN f ON f.user_id = a.user_id""",
    "paired_transitions": f"""WITH {_E}, {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, dir ORDER BY t) - 1 AS seg_idx FROM turns)
SELECT a.user_id, CAST(a.seg_idx AS INTEGER) AS seg_idx, round(a.t, 6) AS t_rise, round(b.t, 6) AS t_fall FROM n a JOIN n b ON a.user_id = b.user_id AND a.seg_idx = b.seg_idx AND a.dir = 1 AND b.dir = -1 WHERE b.t > a.t""",
    "decimated": f"""WITH {_E}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT event_id, 'stride' AS how FROM n WHERE i % greatest(CAST(ceil(n / 20.0) AS BIGINT), 1) = 0
UNION ALL SELECT event_id, 'even' FROM n WHERE n <= 20 OR i IN (SELECT CAST(floor(k * ((n - 1) / 19.0::DOUBLE) + 1e-9) AS BIGINT) FROM range(20) r(k))""",
    "top_values": "SELECT CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, v LIMIT 20",
    "json_props": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1",
}


def direction_latch(spark, sf_dir):
    return series.direction_latch(events(spark, sf_dir), ["user_id"], ["t"], "value", "dir", 20.0).select("event_id", "dir")


def signed_runs(spark, sf_dir):
    found = series.signed_runs(events(spark, sf_dir).withColumn("h", F.col("t") / 3600), ["user_id"], "h", "value", 25.0)
    return rounded(found.groupBy("user_id", "run", "above").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")), 5)


def thinned(spark, sf_dir):
    return series.thinned(events(spark, sf_dir), ["user_id"], ["t"], 20).select("event_id")


def monotone_times(spark, sf_dir):
    """Days of arrival as times: each that isn't later than the one before goes one after it."""
    df = table(spark, sf_dir, "events").select("event_type", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000 - F.col("value") / 7).cast("bigint").alias("us"))
    return cells.monotone_times(df, ["event_type"], ["event_id"], "us", "t_us").select("event_id", "t_us")


def phase_lags(spark, sf_dir):
    """By how many events a type's values follow a command that shows them two and three events ahead."""
    df = events(spark, sf_dir)
    at = cells.placed(cells.dealt(df.select("event_type", "event_id", "value"), ["event_type"], ["event_id"]), ["event_type"], ["event_id"])
    ahead = cells.framed(at, ["event_type"], 0, 3, {"next": lambda w: F.collect_list("value").over(w)})
    value = lambda k: F.coalesce(F.try_element_at("next", F.lit(k)), F.lit(0.0))
    signals = ahead.select("event_type", "event_id", "value", (value(3) + 0.3 * value(4) + F.col("event_id") % 5).alias("command"))
    return rounded(phase.phase_lags(signals, ["event_type"], ["event_id"], "value", "command", 1.0, 20.0), 3)


QUERIES |= {f.__name__: f for f in (direction_latch, signed_runs, thinned, monotone_times, phase_lags)}
ORACLES |= {
    "phase_lags": """WITH b AS (SELECT event_type AS k, event_id, value AS f, row_number() OVER w - 1 AS i, coalesce(lead(value, 2) OVER w, 0) + 0.3 * coalesce(lead(value, 3) OVER w, 0) + event_id % 5 AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
l AS (SELECT k, count(*) AS n, avg(f) AS mean, regr_slope(f, i) AS fs, regr_intercept(f, i) AS fi, regr_slope(c, i) AS cs, regr_intercept(c, i) AS ci FROM b GROUP BY k),
r AS (SELECT k, i, n, f - fs * i - fi AS f, c - cs * i - ci AS c FROM b JOIN l USING (k)), d AS (SELECT k, stddev_pop(f) + 1e-12 AS df, stddev_pop(c) + 1e-12 AS dc FROM r GROUP BY k),
z AS (SELECT k, i, n, f / df AS f, c / dc AS c FROM r JOIN d USING (k)),
x AS (SELECT a.k, lag, sum(b.f * a.c) AS s FROM (SELECT *, unnest(range(-20, 21)) AS lag FROM z) a JOIN z b ON b.k = a.k AND b.i = a.i + lag WHERE abs(lag) < a.n GROUP BY 1, 2),
y AS (SELECT *, lag(s) OVER w AS p, lead(s) OVER w AS q, row_number() OVER (PARTITION BY k ORDER BY s DESC, lag) AS best FROM x WINDOW w AS (PARTITION BY k ORDER BY lag)),
m AS (SELECT k, CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE (lag + greatest(-1, least(1, CASE WHEN p - 2 * s + q = 0 THEN 0 ELSE 0.5 * (p - q) / (p - 2 * s + q) END))) * 1000 END AS ms FROM y WHERE best = 1),
st AS (SELECT k, f, c - lag(c) OVER (PARTITION BY k ORDER BY i) AS dc FROM b),
a AS (SELECT k, sum((f - mean) * sign(dc)) AS area FROM st JOIN l USING (k) GROUP BY k)
SELECT l.k AS event_type, n, round(CASE WHEN n >= 8 THEN ms END, 3) AS phase_lag_ms, round(area, 3) AS area FROM l JOIN m USING (k) JOIN a USING (k)""",
    "monotone_times": """WITH RECURSIVE e AS (SELECT event_type, event_id, CAST(trunc(epoch_us(ts) / 86400000000 - value / 7) AS BIGINT) AS us, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
m AS (SELECT event_type, event_id, i, us AS t_us FROM e WHERE i = 1 UNION ALL SELECT e.event_type, e.event_id, e.i, CASE WHEN e.us <= m.t_us THEN m.t_us + 1 ELSE e.us END FROM m JOIN e ON e.event_type = m.event_type AND e.i = m.i + 1)
SELECT event_id, t_us FROM m""",
    "direction_latch": f"""WITH {_E}, s AS (SELECT user_id, event_id, t, value - lag(value) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e)
SELECT event_id, coalesce(last_value(CASE WHEN abs(d) >= 20 THEN sign(d) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::DOUBLE AS dir FROM s""",
    "signed_runs": f"""WITH {_E}, s AS (SELECT user_id, t / 3600 AS h, value AS y, value >= 25 AS above, lag(t / 3600) OVER w AS h0, lag(value) OVER w AS y0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, coalesce((y0 >= 25) <> above, false) AS turn FROM s), n AS (SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY h) AS run FROM r),
c AS (SELECT user_id, run, above, h0 + (h - h0) * (25 - y0) / (y - y0) AS x FROM n WHERE turn),
p AS (SELECT user_id, run, above, h FROM n UNION ALL SELECT user_id, run, above, x FROM c UNION ALL SELECT user_id, run - 1, NOT above, x FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, above, count(*) AS n, round(min(h), 5) AS a, round(max(h), 5) AS b FROM p GROUP BY 1, 2, 3""",
    "thinned": f"""WITH {_E}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT event_id FROM n WHERE i % CAST(pow(2, greatest(0, ceil(log2(n / 20.0::DOUBLE)))) AS BIGINT) = 0""",
}


def _positions(spark, sf_dir):
    """Events as a position: x at every event of a user, y at those that aren't errors."""
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "t", "event_type", F.col("value").alias("x"), (F.col("event_id") * 7919 % 101).cast("double").alias("y"))
    x = e.select("run_id", F.lit("pos_x").alias("metric"), "seq", "t", F.col("x").alias("v"))
    return e, x.unionByName(e.where("event_type <> 'error'").select("run_id", F.lit("pos_y").alias("metric"), "seq", "t", F.col("y").alias("v")))


def position_quality(spark, sf_dir):
    """Whether the position ten minutes after each view is known: interval width, heaps of times, folded turns."""
    e, signals = _positions(spark, sf_dir)
    points = e.where("event_type = 'view'").select("run_id", F.col("seq").alias("event_id"), (F.col("t") + 600).alias("t"))
    for axis in ("x", "y"):
        points = livemap.interval_width(points, livemap._times(signals, f"pos_{axis}"), f"gap_{axis}")
    points = livemap.turn_folds(livemap.pile_ups(points, signals, step=7200.0, reach=3600.0), signals)
    return rounded(points.select("event_id", F.greatest("gap_x", "gap_y").alias("gap"), "piled", "fold"), 3)


QUERIES |= {"position_quality": position_quality}
ORACLES |= {
    "position_quality": f"""WITH {_E}, s AS (SELECT user_id, event_id, t, event_type, value AS x, (event_id * 7919 % 101)::DOUBLE AS y FROM e),
q AS (SELECT user_id, event_id, t + 600 AS t FROM s WHERE event_type = 'view'),
src AS (SELECT user_id, t, 'x' AS axis FROM s UNION ALL SELECT user_id, t, 'y' FROM s WHERE event_type <> 'error'),
d AS (SELECT user_id, axis, t, t - lag(t) OVER (PARTITION BY user_id, axis ORDER BY t) AS step, coalesce(t - lag(t) OVER (PARTITION BY user_id, axis ORDER BY t), lead(t) OVER (PARTITION BY user_id, axis ORDER BY t) - t) AS w FROM src),
nxt AS (SELECT q.event_id, d.axis, arg_min(d.w, d.t) AS w FROM q JOIN d ON q.user_id = d.user_id AND d.t >= q.t GROUP BY 1, 2),
lst AS (SELECT q.event_id, d.axis, arg_max(d.w, d.t) AS w FROM q JOIN d ON q.user_id = d.user_id GROUP BY 1, 2),
gaps AS (SELECT q.event_id, max(coalesce(nxt.w, lst.w, 0)) AS gap FROM q LEFT JOIN lst ON q.event_id = lst.event_id LEFT JOIN nxt ON lst.event_id = nxt.event_id AND lst.axis = nxt.axis GROUP BY 1),
piles AS (SELECT DISTINCT q.event_id FROM q JOIN d ON q.user_id = d.user_id AND d.step < 7200 AND abs(q.t - d.t) < 3600),
ys AS (SELECT user_id, event_id, t, x, CASE WHEN event_type <> 'error' THEN y END AS y, CASE WHEN event_type <> 'error' THEN t END AS ty FROM s),
fill AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS y0, last_value(ty IGNORE NULLS) OVER a AS t0, first_value(y IGNORE NULLS) OVER b AS y1, first_value(ty IGNORE NULLS) OVER b AS t1 FROM ys
  WINDOW a AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
full_ AS (SELECT user_id, t, x, CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR t0 = t1 THEN y0 ELSE y0 + (y1 - y0) * (t - t0) / (t1 - t0) END AS y FROM fill),
steps AS (SELECT user_id, t, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM full_ WINDOW w AS (PARTITION BY user_id ORDER BY t)),
around AS (SELECT user_id, t, dx, dy, lag(dx) OVER w AS ax, lag(dy) OVER w AS ay, lead(dx) OVER w AS bx, lead(dy) OVER w AS by_ FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY t)),
folds AS (SELECT user_id, t, coalesce(ax * bx + ay * by_ < -0.17 * sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) AND sqrt(ax * ax + ay * ay) > 0.05 AND sqrt(bx * bx + by_ * by_) > 0.05 AND sqrt(dx * dx + dy * dy) < 0.7 * (sqrt(ax * ax + ay * ay) + sqrt(bx * bx + by_ * by_)) / 2, false) AS fold FROM around),
carried AS (SELECT q.event_id, arg_max(folds.fold, folds.t) AS fold FROM q JOIN folds ON q.user_id = folds.user_id AND folds.t <= q.t GROUP BY 1)
SELECT q.event_id, round(gap, 3) AS gap, piles.event_id IS NOT NULL AS piled, coalesce(fold, false) AS fold FROM q LEFT JOIN gaps USING (event_id) LEFT JOIN piles USING (event_id) LEFT JOIN carried USING (event_id)""",
}
