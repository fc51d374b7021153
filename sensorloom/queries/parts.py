"""Scalar functions and the parts of analyses, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.functions import lines, scalar
from sensorloom.operators import fits, gcode, livemap, probe, robust, series
from sensorloom.plans import tables
from sensorloom.queries.curves import _BOOT, _minimum, bootstrap_values, rounded, table
from sensorloom.queries.series import _E, _TURNS, events
from sensorloom.sources import runs
from sensorloom.streaming import fanout, retime


def axis_words(spark, sf_dir):
    """Program lines made of events, and what is read from them."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    move = F.concat(F.lit("g1 X"), (i % 211).cast("string"), F.lit(".5 y-"), (i % 17).cast("string"), F.lit(" E.25 F"), (i % 9 * 600).cast("string"), F.lit(" ; X9"))
    line = F.when(i % 4 == 0, F.concat(F.lit(";TYPE:"), "event_type")).when(i % 4 == 1, F.concat(F.lit(";Z:"), (i % 7).cast("string"), F.lit(".25"))).when(i % 4 == 2, F.lit("G0 X1.5.2 Y2 E7 F3")).otherwise(move)
    x = F.col("line")
    words = e.select("event_id", line.alias("line")).select("event_id", *[scalar.axis_value(x, a).alias(a.lower()) for a in "XY"], scalar.extrusion(x)["e"].alias("e"), scalar.extrusion(x)["f"].alias("f"), scalar.comment_feature(x).alias("feature"), scalar.comment_z(x).alias("z"))
    return words


def printer_models(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("Core One", "core_1", "INDX", "coreone indx", "")]), F.col("s_nationkey") % 5 + 1)
    model = scalar.printer_model(spelled)
    return s.select("s_suppkey", model.alias("model"), scalar.tool_index(model, F.col("s_nationkey") % 8).alias("tool"))


def run_file_names(spark, sf_dir):
    i = F.col("event_id")
    name = F.element_at(F.array(*[F.concat(F.lit(a), i.cast("string"), F.lit(b)) for a, b in (("run_", ".npz"), ("flow_", ".npz"), ("run_", ".json"), ("run_../", ".npz"), ("../run_", ".npz"), ("run_a..", ".npz"))]), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scalar.is_run_file(name, "run").alias("ok"))


def weight_texts(spark, sf_dir):
    text = F.concat(F.lit("overshoot="), (F.col("c_nationkey") / 4).cast("string"), F.lit(", tail_area = 1.5"))
    w = scalar.weights(text, ["overshoot", "tail_area", "rise_delay"])
    return table(spark, sf_dir, "customer").select("c_custkey", w["overshoot"].alias("overshoot"), w["tail_area"].alias("tail_area"))


def arcs(spark, sf_dir):
    """An arc per part from angle to angle; every tenth ends off its circle."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", (k % 29 + 1.3).alias("r"), (k % 59 * 0.1 + 0.01).alias("a"), (k % 31 * 0.17 + 0.05).alias("b"), (k % 2 == 0).alias("cw"))
    ends = p.withColumns({"x0": F.col("r") * F.cos("a"), "y0": F.col("r") * F.sin("a"), "x1": (F.col("r") + F.when(k % 10 == 0, 1.0).otherwise(0.0)) * F.cos("b"), "y1": (F.col("r") + F.when(k % 10 == 0, 1.0).otherwise(0.0)) * F.sin("b")})
    points = ends.withColumn("p", scalar.arc_points(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), -F.col("x0"), -F.col("y0"), F.col("cw")))
    total = F.aggregate("p", F.lit(0.0), lambda s, q: s + q["x"] + 2 * q["y"])
    return rounded(points.select("p_partkey", F.when(F.col("p").isNotNull(), F.size("p")).alias("n"), total.alias("total")), 4)


def flow_values(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity"), F.col("l_extendedprice")
    return rounded(s.groupBy("l_suppkey").agg(F.sum(F.round(scalar.power_law(F.lit(3.5), F.lit(0.55), F.lit(-2.0), q), 6)).alias("force"), F.sum(F.round(scalar.filament_length(q, scalar.flow_duration(d, q)), 6)).alias("length"), F.max(scalar.per_minute(q)).alias("fastest")), 3)


def number_picks(spark, sf_dir):
    """Which number stands for a line's value."""
    i = F.col("event_id")
    fields = F.when(i % 4 == 0, F.concat(F.lit("a=3i,v="), i.cast("string"), F.lit("i"))).when(i % 4 == 1, F.concat(F.lit("a=t,b="), i.cast("string"), F.lit("i,c=2i"))).when(i % 4 == 2, F.lit('a="x",b=f')).otherwise(F.concat(F.lit("b="), i.cast("string"), F.lit(".5,a=1i")))
    got = lines.parse(table(spark, sf_dir, "events").select(F.concat(F.lit("msg,id="), i.cast("string"), F.lit(" "), fields, F.lit(" 0")).alias("value")))
    f = F.col("fields")
    inverse = F.lit(1.0) / scalar.finite_or_null(F.when(F.col("tags")["id"].cast("long") % 3 == 0, F.lit(float("nan"))).when(F.col("tags")["id"].cast("long") % 3 == 1, F.lit(float("-inf"))).otherwise(F.lit(4.0)))
    return got.select(F.col("tags")["id"].cast("long").alias("event_id"), scalar.numeric(f).alias("number"), scalar.first_finite(f).alias("first"), inverse.alias("inverse"))


def _moves(spark, sf_dir):
    """Each user's events as moves: eight to a layer, errors travel, and every eleventh event's move begins elsewhere."""
    w = series.over(["user_id"], "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.col("value") * 10).cast("double").alias("x1"), (F.col("event_id") % 23).cast("double").alias("y1"), "value", F.floor((F.row_number().over(w) - 1) / 8).cast("int").alias("layer"))
    e = e.withColumns({"x0": F.coalesce(F.lag("x1").over(w), F.lit(0.0)) + (F.col("event_id") % 11 == 0).cast("double"), "y0": F.coalesce(F.lag("y1").over(w), F.lit(0.0))})
    return e.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("move_idx"), "x0", "y0", "x1", "y1", (F.col("event_type") != "error").alias("extruding"), "layer", ((F.col("layer") + 1) * 0.25).alias("layer_z"),
        F.when(F.col("event_type").isin("view", "click"), "Perimeter").otherwise("Infill").alias("feature"), F.when(F.col("event_type") == "error", 150.0).otherwise(20 + F.col("event_id") % 90).alias("feed_mm_s"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("length_mm"), "value",
    )


_M = """w AS (SELECT user_id, event_id, event_type, value, floor(value * 10)::DOUBLE AS x1, (event_id % 23)::DOUBLE AS y1, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 8) AS INTEGER) AS layer FROM events),
v AS (SELECT *, coalesce(lag(x1) OVER (PARTITION BY user_id ORDER BY event_id), 0) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS x0, coalesce(lag(y1) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS y0 FROM w),
m AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS move_idx, x0, y0, x1, y1, event_type <> 'error' AS extruding, layer, (layer + 1) * 0.25 AS layer_z, CASE WHEN event_type IN ('view', 'click') THEN 'Perimeter' ELSE 'Infill' END AS feature,
  CASE WHEN event_type = 'error' THEN 150.0 ELSE 20 + event_id % 90 END::DOUBLE AS feed, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length, value FROM v)"""


def polylines(spark, sf_dir):
    found = gcode.polylines(_moves(spark, sf_dir))
    return found.select("run_id", "layer", "feature", F.size("points").alias("n"), F.element_at("points", 1)["x"].alias("x_first"), F.element_at("points", -1)["x"].alias("x_last"), F.element_at("points", -1)["y"].alias("y_last"))


def travel_speeds(spark, sf_dir):
    return rounded(gcode.travel_threshold(_moves(spark, sf_dir)))


def _mapped(spark, sf_dir):
    return _moves(spark, sf_dir).where("extruding and layer % 3 < 2").withColumn("force", F.col("value"))


def layer_samples(spark, sf_dir):
    return livemap.layer_counts(_mapped(spark, sf_dir), _moves(spark, sf_dir))


def colour_ranges(spark, sf_dir):
    return rounded(livemap.colour_range(_mapped(spark, sf_dir)))


def path_positions(spark, sf_dir):
    """Where on the path each point falls by the way it has travelled, the points being the path's ends, drifted."""
    moves = _moves(spark, sf_dir)
    points = moves.select("run_id", F.col("move_idx").alias("seq"), F.col("move_idx").cast("double").alias("t"), (F.col("x1") * 1.1).alias("x"), "y1")
    found = livemap.by_path(points.withColumnRenamed("y1", "y"), moves.where("extruding"))
    return rounded(found.select("run_id", "seq", F.col("arc"), "arc_layer"), 3)


def map_agreement(spark, sf_dir):
    moves = _moves(spark, sf_dir)
    points = moves.select("run_id", F.col("move_idx").alias("seq"), F.col("move_idx").cast("double").alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"), "extruding").withColumnRenamed("extruding", "printing")
    return rounded(livemap.cross_check(points, moves.where("extruding")), 5)


def map_breaks(spark, sf_dir):
    """Line breaks between a user's events that aren't errors: jumps, left-out rows, and holes of over an hour that hide a turn."""
    w = series.over(["run_id"], "t")
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "t", "event_type", (F.col("value") / 50).alias("x"), (F.col("event_id") % 7 * 0.3).alias("y"), (F.col("event_id") % 5 * 0.4 + F.col("value") / 60).alias("snap_s"))
    points = e.withColumn("idx", F.row_number().over(w)).where("event_type <> 'error'").drop("event_type")
    return livemap.line_breaks(points, 3.0, 3600.0).select("run_id", "seq", "is_break")


def plateau_levels(spark, sf_dir):
    e = events(spark, sf_dir)
    turns = e.where("event_id % 5 = 0").select("user_id", "t", F.when(F.col("event_id") % 10 == 0, 1).otherwise(-1).alias("dir"))
    return rounded(robust.plateau_levels(e, turns, ["user_id"], "t", "value", "dir", settle=60.0, least_n=2, least=2, width=86_400.0))


def transition_areas(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("h", F.col("t") / 3600)
    turns = e.where("event_type in ('signup', 'error')").select("user_id", "h", F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("dir"))
    return rounded(series.transition_areas(e, turns, ["user_id"], "h", "value", "dir", half=48.0), 4)


def metric_heads(spark, sf_dir):
    return series.heads(events(spark, sf_dir), ["event_type"], ["t", "event_id"], 3).select("event_type", "event_id")


def wall_times(spark, sf_dir):
    """Exported rows with the run's wall clock."""
    e = events(spark, sf_dir)
    signals = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("metric"), F.col("event_id").alias("seq"), F.floor("t").cast("double").alias("t"), F.col("value").alias("v"))
    anchors = signals.groupBy("run_id").agg(F.lit(1000.0).alias("mono"), F.lit(2500.0).alias("unix"))
    return runs.export_rows(signals, anchors).select("run_id", "metric", "seq", "t_rel_s", F.unix_micros("wall").alias("wall_us"), "v")


def json_rows(spark, sf_dir):
    """Values out as JSON texts and back; what isn't finite becomes null."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.floor(F.col("value"))).alias("v"))
    got = runs.as_json(e)
    return got.select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.get_json_object("value", "$.v").cast("double").alias("v"), F.col("value").contains('"v":').alias("has_v"))


def bootstrap_rescaled(spark, sf_dir):
    """bootstrap_kopt with each draw's metrics scaled anew."""
    long, index = bootstrap_values(spark, sf_dir)
    return rounded(fits.bootstrap_minima(long, [], 20, index, {"a": 1.0, "b": 0.5}, rescale="p90"))


def bootstrap_rescaled_summary(spark, sf_dir):
    return rounded(fits.spread(bootstrap_rescaled(spark, sf_dir), "k_opt"), 4)


_OWN_SCALE = (
    _BOOT.split("), fixed AS (")[0]
    + """), drawn AS (
  SELECT k, metric, draw, (i * 7919 + draw * 104729 + i * i % 1009 * 31) % n AS pick FROM long, (SELECT unnest(range(20)) AS draw)
), med AS (
  SELECT draw, drawn.k AS k, drawn.metric AS metric, median(value) AS m FROM drawn JOIN long ON long.k = drawn.k AND long.metric = drawn.metric AND long.i = drawn.pick GROUP BY 1, 2, 3
), scales AS (
  SELECT draw, metric, CASE WHEN quantile_cont(abs(m), 0.9) <= 0.05 * max(abs(m)) THEN max(abs(m)) ELSE quantile_cont(abs(m), 0.9) END AS s FROM med GROUP BY 1, 2
), costs AS (
  SELECT draw, k, sum(CASE metric WHEN 'a' THEN 1.0 ELSE 0.5 END * m / s) AS cost FROM med JOIN scales USING (draw, metric) GROUP BY 1, 2
)"""
    + _minimum("costs", "cost", "draw")
)

def fan_out(spark, sf_dir):
    """Hourly events in queues of forty, one for each type and one for all, read ten an hour."""
    e = fanout.subscribed(events(spark, sf_dir).select("event_type", F.floor(F.col("t") / 3600).alias("hour")), "event_type")
    return fanout.queues(e.groupBy("subscriber", "hour").agg(F.count("*").alias("n")), ["subscriber"], "hour", "n", 40, 10)


def collected(spark, sf_dir):
    """What is collected of each user's events from each signup until the next error."""
    e = events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    runs = e.withColumn("stopped", F.min(F.when(F.col("event_type") == "error", F.col("t"))).over(w)).where("event_type = 'signup'").select(F.col("event_id").alias("run_id"), "user_id", F.col("t").alias("started"), "stopped")
    return rounded(fanout.collected(e, runs, ["user_id"], "t", "value", 86_400.0), 4)


QUERIES = {f.__name__: f for f in (axis_words, printer_models, run_file_names, weight_texts, arcs, flow_values, number_picks, polylines, travel_speeds, layer_samples, colour_ranges, path_positions, map_agreement, map_breaks, plateau_levels, transition_areas, metric_heads, wall_times, json_rows, bootstrap_rescaled, bootstrap_rescaled_summary, fan_out, collected)}
ORACLES = {
    "fan_out": f"""WITH RECURSIVE {_E}, a AS (SELECT subscriber, hour, count(*) AS n FROM (SELECT unnest([event_type, '*']) AS subscriber, CAST(floor(t / 3600) AS BIGINT) AS hour FROM e) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY hour) AS i FROM a),
q AS (SELECT subscriber, i, hour AS tick, n AS arrived, greatest(0, n - 40) AS dropped, least(10, n) AS delivered, greatest(0, least(40, n) - 10) AS waiting FROM k WHERE i = 1
  UNION ALL SELECT subscriber, i, hour, n, left_ + n - least(40, left_ + n), waiting - left_ + least(10, least(40, left_ + n)), least(40, left_ + n) - least(10, least(40, left_ + n))
  FROM (SELECT k.subscriber, k.i, k.hour, k.n, q.waiting, greatest(0, q.waiting - 10 * (k.hour - q.tick - 1)) AS left_ FROM q JOIN k ON k.subscriber = q.subscriber AND k.i = q.i + 1))
SELECT subscriber, tick, arrived, dropped::BIGINT AS dropped, delivered::BIGINT AS delivered, waiting::BIGINT AS waiting FROM q""",
    "collected": f"""WITH {_E}, r AS (SELECT s.user_id, s.event_id AS run_id, s.t AS started, (SELECT min(x.t) FROM e x WHERE x.user_id = s.user_id AND x.event_type = 'error' AND x.t > s.t) AS stopped FROM e s WHERE s.event_type = 'signup')
SELECT run_id, count(e.event_id) AS n, round(min(e.t), 4) AS t_first, round(max(e.t), 4) AS t_last, round(sum(e.value), 4) AS total FROM r LEFT JOIN e ON e.user_id = r.user_id AND e.t >= started AND (stopped IS NULL OR e.t < stopped) GROUP BY run_id""",
    "axis_words": """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_id % 211 + 0.5 END::DOUBLE AS x, CASE event_id % 4 WHEN 3 THEN -(event_id % 17) WHEN 2 THEN 2 END::DOUBLE AS y, CASE WHEN event_id % 4 = 3 THEN 0.25 END::DOUBLE AS e,
CASE WHEN event_id % 4 = 3 THEN event_id % 9 * 600 END::DOUBLE AS f, CASE WHEN event_id % 4 = 0 THEN event_type END AS feature, CASE WHEN event_id % 4 = 1 THEN event_id % 7 + 0.25 END::DOUBLE AS z FROM events""",
    "printer_models": "SELECT s_suppkey, CASE WHEN s_nationkey % 5 IN (2, 3) THEN 'COREONEINDX' ELSE 'COREONE' END AS model, s_nationkey % 8 AS tool FROM supplier",
    "run_file_names": "SELECT event_id, event_id % 6 = 0 AS ok FROM events",
    "weight_texts": "SELECT c_custkey, c_nationkey / 4.0::DOUBLE AS overshoot, 1.5::DOUBLE AS tail_area FROM customer",
    "arcs": """WITH p AS (SELECT p_partkey AS k, p_partkey % 29 + 1.3::DOUBLE AS r, p_partkey % 59 * 0.1::DOUBLE + 0.01 AS a, p_partkey % 31 * 0.17::DOUBLE + 0.05 AS b FROM part),
s AS (SELECT *, CASE WHEN k % 2 = 0 THEN a - b ELSE b - a END AS d FROM p), t AS (SELECT *, CASE WHEN d < 1e-9 THEN d + 2 * pi() ELSE d END AS sweep FROM s),
c AS (SELECT *, CAST(greatest(1, ceil(r * sweep / 0.5), ceil(sweep / radians(10))) AS INTEGER) AS n FROM t),
q AS (SELECT c.*, unnest(range(1, n + 1)) AS i FROM c WHERE k % 10 <> 0),
g AS (SELECT k, sum(r * cos(a + CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * sweep * i / n) + 2 * r * sin(a + CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * sweep * i / n)) AS total FROM q GROUP BY k)
SELECT c.k AS p_partkey, CASE WHEN c.k % 10 <> 0 THEN n END AS n, round(total, 4) AS total FROM c LEFT JOIN g USING (k)""",
    "flow_values": "SELECT l_suppkey, round(sum(round(3.5 * pow(l_quantity, 0.55) - 2, 6)), 3) AS force, round(sum(round(l_extendedprice, 6)), 3) AS length, max(l_quantity * 60) AS fastest FROM lineitem GROUP BY 1",
    "number_picks": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 3 THEN event_id + 0.5 END::DOUBLE AS number, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN event_id WHEN 3 THEN event_id + 0.5 END::DOUBLE AS first, CASE WHEN event_id % 3 = 2 THEN 0.25 END::DOUBLE AS inverse FROM events""",
    "polylines": f"""WITH {_M}, j AS (SELECT *, coalesce(lag(extruding) OVER p AND lag(feature) OVER p = feature AND abs(lag(x1) OVER p - x0) <= 1e-6 AND abs(lag(y1) OVER p - y0) <= 1e-6, false) AS joined FROM m WINDOW p AS (PARTITION BY run_id, layer ORDER BY move_idx)),
l AS (SELECT *, sum(CASE WHEN extruding AND NOT joined THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, layer ORDER BY move_idx) AS line FROM j)
SELECT run_id, layer, feature, CAST(count(*) + 1 AS INTEGER) AS n, arg_min(x0, move_idx) AS x_first, arg_max(x1, move_idx) AS x_last, arg_max(y1, move_idx) AS y_last FROM l WHERE extruding GROUP BY run_id, layer, line, feature""",
    "travel_speeds": f"""WITH {_M}, s AS (SELECT run_id, coalesce(max(feed) FILTER (extruding), 100) AS p, max(feed) FILTER (NOT extruding) AS q0 FROM m WHERE length > 1e-9 GROUP BY 1), c AS (SELECT run_id, p, coalesce(q0, 2 * p) AS q FROM s)
SELECT run_id, round(CASE WHEN q > 1.1 * p THEN p + 0.4 * (q - p) ELSE 1.5 * p END, 6) AS speed FROM c""",
    "layer_samples": f"WITH {_M} SELECT run_id, layer, min(layer_z)::DOUBLE AS z, count(*) FILTER (extruding AND layer % 3 < 2) AS n FROM m GROUP BY 1, 2",
    "colour_ranges": f"""WITH {_M}, r AS (SELECT run_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM m WHERE extruding AND layer % 3 < 2 GROUP BY 1)
SELECT run_id, round(lo, 6) AS lo, round(CASE WHEN hi <= lo THEN lo + 1 ELSE hi END, 6) AS hi FROM r""",
    "path_positions": f"""WITH {_M}, st AS (SELECT run_id, move_idx, coalesce(sqrt(pow(x1 * 1.1 - lag(x1 * 1.1) OVER w, 2) + pow(y1 - lag(y1) OVER w, 2)), 0) AS d FROM m WINDOW w AS (PARTITION BY run_id ORDER BY move_idx)),
way AS (SELECT run_id, move_idx, sum(d) OVER (PARTITION BY run_id ORDER BY move_idx) AS s FROM st),
pth AS (SELECT run_id, layer, sum(length) OVER (PARTITION BY run_id ORDER BY move_idx) - length AS s0, length FROM m WHERE extruding AND length > 1e-9),
tot AS (SELECT run_id, sum(length) AS total FROM pth GROUP BY 1), most AS (SELECT run_id, max(s) AS most FROM way GROUP BY 1),
arc AS (SELECT way.run_id, move_idx AS seq, greatest(0, least(s * CASE WHEN most > 1e-6 THEN greatest(0.8, least(1.25, total / most)) ELSE 1 END, total - 1e-9)) AS arc FROM way JOIN most USING (run_id) JOIN tot USING (run_id))
SELECT arc.run_id, seq, round(arc, 3) AS arc, layer AS arc_layer FROM arc ASOF LEFT JOIN pth ON arc.run_id = pth.run_id AND arc.arc >= pth.s0""",
    "map_agreement": f"""WITH {_M}, st AS (SELECT run_id, extruding, coalesce(sqrt(pow(x1 - lag(x1) OVER w, 2) + pow(y1 - lag(y1) OVER w, 2)), 0) AS d FROM m WINDOW w AS (PARTITION BY run_id ORDER BY move_idx)),
way AS (SELECT run_id, sum(d) AS way, avg(CASE WHEN extruding THEN 1.0 ELSE 0.0 END) AS kept FROM st GROUP BY 1), tot AS (SELECT run_id, sum(length) AS total FROM m WHERE extruding AND length > 1e-9 GROUP BY 1),
s AS (SELECT run_id, kept, CASE WHEN way > 1e-6 THEN greatest(0.8, least(1.25, total / way)) ELSE 1 END AS scale FROM way JOIN tot USING (run_id))
SELECT run_id, round(scale, 5) AS scale, round(kept, 5) AS kept, CASE WHEN abs(scale - 1) < 0.06 AND kept > 0.4 THEN 'good' WHEN abs(scale - 1) < 0.15 THEN 'warn' ELSE 'poor' END AS agreement FROM s""",
    "map_breaks": f"""WITH {_E}, p AS (SELECT user_id, event_id, t, event_type, value / 50 AS x, event_id % 7 * 0.3::DOUBLE AS y, event_id % 5 * 0.4::DOUBLE + value / 60 AS s, row_number() OVER (PARTITION BY user_id ORDER BY t) AS idx FROM e),
d AS (SELECT *, idx - lag(idx) OVER w AS di, t - lag(t) OVER w AS dt, s - lag(s) OVER w AS adv, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS chord FROM p WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY t)),
n AS (SELECT *, chord / greatest(dt, 1e-6) AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE di IS NOT NULL),
med AS (SELECT a.event_id, median(b.v) AS speed FROM n a, (SELECT unnest(range(-7, 8)) AS o), n b WHERE a.user_id = b.user_id AND b.i = greatest(1, least(a.n, a.i + o)) GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS run_id, d.event_id AS seq, di IS NULL OR di > 1 OR chord > 3 OR (dt > 3600 AND (abs(adv - chord) > greatest(0.5, 0.35 * chord) OR dt * speed - greatest(chord, abs(adv)) > greatest(1.0, 0.5 * dt * speed))) AS is_break FROM d LEFT JOIN med USING (event_id)""",
    "plateau_levels": f"""WITH {_E}, tr AS (SELECT user_id, t, CASE WHEN event_id % 10 = 0 THEN 1 ELSE -1 END AS dir, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM e WHERE event_id % 5 = 0),
leg AS (SELECT tr.user_id, tr.t, dir, median(value) AS m FROM tr JOIN e ON e.user_id = tr.user_id AND e.t >= tr.t + 60 AND e.t < nxt GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT user_id, round(median(m) FILTER (dir < 0), 6) AS slow, round(median(m) FILTER (dir > 0), 6) AS fast, count(*) FILTER (dir < 0) AS n_slow, count(*) FILTER (dir > 0) AS n_fast FROM leg GROUP BY user_id HAVING n_slow >= 2 AND n_fast >= 2""",
    "transition_areas": f"""WITH {_E}, {_TURNS}, b AS (SELECT user_id, t / 3600 AS mid, dir, lag(t / 3600) OVER w AS p, lead(t / 3600) OVER w AS f FROM turns WINDOW w AS (PARTITION BY user_id ORDER BY t)),
win AS (SELECT user_id, mid, dir, greatest(mid - 48, coalesce((mid + p) / 2, mid - 48)) AS lo, least(mid + 48, coalesce((mid + f) / 2, mid + 48)) AS hi FROM b),
pts AS (SELECT win.user_id, mid, dir, e.t / 3600 AS h, value - avg(value) OVER (PARTITION BY win.user_id, mid) AS y FROM win JOIN e ON e.user_id = win.user_id AND e.t / 3600 BETWEEN lo AND hi),
stp AS (SELECT user_id, dir * (y + lead(y) OVER w) / 2 * (lead(h) OVER w - h) AS a FROM pts WINDOW w AS (PARTITION BY user_id, mid ORDER BY h))
SELECT user_id, round(sum(a), 4) AS area FROM stp GROUP BY user_id""",
    "metric_heads": f"WITH {_E}, n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS i FROM e) SELECT event_type, event_id FROM n WHERE i <= 3",
    "wall_times": f"""WITH {_E} SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS metric, event_id AS seq, floor(t)::DOUBLE - min(floor(t)::DOUBLE) OVER (PARTITION BY user_id, event_type) AS t_rel_s, CAST((floor(t) + 1500) * 1000000 AS BIGINT) AS wall_us, value AS v FROM e""",
    "json_rows": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN floor(value) END::DOUBLE AS v, true AS has_v FROM events",
    "bootstrap_rescaled": f"WITH {_OWN_SCALE} SELECT draw, round(k_opt, 6) AS k_opt FROM best",
    "bootstrap_rescaled_summary": f"""WITH {_OWN_SCALE}, k AS (SELECT round(k_opt, 6) AS k FROM best)
SELECT round(avg(k), 4) AS mean, round(median(k), 4) AS median, round(stddev_samp(k), 4) AS std, round(min(k), 4) AS least, round(max(k), 4) AS most, round(quantile_cont(k, 0.05), 4) AS p05, round(quantile_cont(k, 0.95), 4) AS p95, round(quantile_cont(k, 0.75) - quantile_cont(k, 0.25), 4) AS iqr FROM k""",
}


def probe_verdicts(spark, sf_dir):
    """A verdict per supplier, its lines being the touches."""
    k = F.col("l_suppkey")
    found = table(spark, sf_dir, "lineitem").select(k.alias("run_id"), F.when(F.col("l_linenumber") % (k % 3 + 2) != 0, 0.6 + F.col("l_tax") * (k % 5)).alias("contact_pos"), F.col("l_extendedprice").alias("peak_force"), (F.col("l_quantity") * (k % 2 * 189)).alias("noise"))
    return rounded(probe.verdicts(found, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 3).alias("run_id"))), 9)


def planned_windows(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.lit(2.0).alias("min_flow"), (F.col("s_nationkey") % 7 + 5).cast("double").alias("max_flow"), F.lit(1.0).alias("step_flow"), F.lit(3.0).alias("dwell_s"), F.lit(10.0).alias("warmup_s"), F.lit(1.75).alias("filament_diameter"))
    planned = tables.plan_windows(tables.flow_segments(s), F.col("run_id") * 100.0)
    return planned.select("run_id", "level_idx", "t_lo", "t_hi")


def _samples(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").alias("printer"), F.col("event_type").alias("name"), F.col("event_id").alias("packet"), F.floor("t").cast("double").alias("t"), (F.col("event_id") % 3).alias("lost"))


def window_rates(spark, sf_dir):
    got = retime.rates(_samples(spark, sf_dir), "1 hour")
    return rounded(got.select(F.unix_seconds("start").alias("start_s"), "name", "n", "rate", "lost"), 9)


def live_windows(spark, sf_dir):
    return retime.live_window(_samples(spark, sf_dir), 200_000.0).select("printer", "packet")


_PARTS = {f.__name__: f for f in (probe_verdicts, planned_windows, window_rates, live_windows)}
QUERIES |= _PARTS
ORACLES |= {
    "probe_verdicts": """WITH f AS (SELECT l_suppkey AS run_id, CASE WHEN l_linenumber % (l_suppkey % 3 + 2) <> 0 THEN 0.6::DOUBLE + l_tax * (l_suppkey % 5) END AS pos, l_extendedprice AS peak, l_quantity * (l_suppkey % 2 * 189) AS noise FROM lineitem),
g AS (SELECT run_id, count(*) AS n, count(pos) AS c, avg(pos) AS mean, CASE WHEN count(pos) > 1 THEN stddev_pop(pos) END AS std, coalesce(median(peak) / median(noise) FILTER (noise > 0), 0) AS snr FROM f GROUP BY 1),
v AS (SELECT *, CASE WHEN snr >= 10 AND c / n >= 0.6 AND c > 0 AND coalesce(std, 0) <= 0.1 THEN 'usable' WHEN snr >= 4 AND c / n >= 0.4 THEN 'marginal' ELSE 'no clear signal' END AS verdict FROM g)
SELECT s_suppkey + 3 AS run_id, coalesce(n, 0) AS n_touches_found, coalesce(c, 0) AS n_contacts, round(mean, 9) AS contact_pos_mean, round(std, 9) AS contact_pos_std, round(coalesce(snr, 0), 9) AS snr, coalesce(verdict, 'no creeps detected') AS verdict FROM supplier LEFT JOIN v ON run_id = s_suppkey + 3""",
    "planned_windows": """WITH s AS (SELECT s_suppkey AS run_id, unnest(range(0, s_nationkey % 7 + 4)) AS i FROM supplier)
SELECT run_id, CAST(i AS INTEGER) AS level_idx, (run_id * 100 + 10 + i * 3)::DOUBLE AS t_lo, (run_id * 100 + 13 + i * 3)::DOUBLE AS t_hi FROM s""",
    "window_rates": f"""WITH {_E}, s AS (SELECT event_type AS name, floor(t)::DOUBLE AS t, event_id % 3 AS lost FROM e)
SELECT CAST(floor(t / 3600) * 3600 AS BIGINT) AS start_s, name, count(*) AS n, CASE WHEN count(*) >= 2 AND max(t) > min(t) THEN round(count(*) / (max(t) - min(t)), 9) END AS rate, CAST(sum(lost) AS BIGINT) AS lost FROM s GROUP BY 1, 2""",
    "live_windows": f"WITH {_E}, n AS (SELECT user_id, max(floor(t)) AS top FROM e GROUP BY 1) SELECT user_id AS printer, event_id AS packet FROM e JOIN n USING (user_id) WHERE floor(t) >= top - 200000",
}
