"""Curves over K: l_discount's eleven values are the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import cells, fits, ranks, robust
from sensorloom.sources.shared import materialise

WEIGHTS = {"quantity": 1.0, "price": 2.0, "unit": 0.5}
METRICS = ["quantity", "price", "unit"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("k"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") / F.col("l_quantity") + 1000 * F.col("l_tax")).alias("unit"))
    return lines.unpivot(["k"], METRICS, "metric", "value")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


_LONG = """long AS (
  SELECT l_discount AS k, 'quantity' AS metric, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_discount, 'price', l_extendedprice FROM lineitem
  UNION ALL SELECT l_discount, 'unit', l_extendedprice / l_quantity + 1000 * l_tax FROM lineitem
)"""
_NORMAL = (
    _LONG
    + """, med AS (
  SELECT k, metric, median(value) AS median FROM long GROUP BY k, metric
), scales AS (
  SELECT metric, CASE WHEN quantile_cont(abs(median), 0.9) <= 0.05 * max(abs(median)) THEN max(abs(median)) ELSE quantile_cont(abs(median), 0.9) END AS s FROM med GROUP BY metric
), norm AS (
  SELECT k, metric, median, CASE WHEN s > 0 THEN median / s END AS v FROM med JOIN scales USING (metric)
)"""
)


def _minimum(source: str, y: str, by: str = "") -> str:
    """CTEs around, best: the refined minimum of a curve (k, y) of `source`."""
    part = f"PARTITION BY {by} " if by else ""
    keep = f"{by}, " if by else ""
    return f""", around AS (
  SELECT {keep}k, {y} AS y1, lag(k) OVER ({part}ORDER BY k) AS x0, lag({y}) OVER ({part}ORDER BY k) AS y0, lead(k) OVER ({part}ORDER BY k) AS x2, lead({y}) OVER ({part}ORDER BY k) AS y2,
         row_number() OVER ({part}ORDER BY {y}, k) AS r
  FROM {source} WHERE {y} IS NOT NULL
), slopes AS (
  SELECT *, (y1 - y0) / (k - x0) AS d1, ((y2 - y1) / (x2 - k) - (y1 - y0) / (k - x0)) / (x2 - x0) AS a FROM (
    SELECT {keep}k, y1, x0, y0, x2, y2, r FROM around
  )
), best AS (
  SELECT {keep}CASE WHEN x0 IS NULL OR x2 IS NULL OR a <= 0 THEN k ELSE greatest(x0, least(x2, (x0 + k) / 2 - d1 / (2 * a))) END AS k_opt FROM (SELECT * FROM slopes WHERE r = 1)
)"""


def kopt_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per K and the K of the least cost: medians, normalisation, weighted sum, minimum, parabola."""
    medians = ranks.median(long_lines(spark, sf_dir), ["k", "metric"], "value")
    costs = materialise(fits.cost(fits.normalise(materialise(medians, "medians"), []), [], WEIGHTS), "costs")
    return rounded(costs.crossJoin(F.broadcast(fits.argmin_parabolic(costs, [], "cost"))))  # one row


def per_k_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits.per_k(long_lines(spark, sf_dir), []))


def per_metric_kopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = ranks.median(long_lines(spark, sf_dir), ["k", "metric"], "value")
    return rounded(fits.per_metric_minima(fits.normalise(materialise(medians, "medians"), []), [], WEIGHTS))


def order_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer nation, the median price of lines over K, less the overall median: a curve that crosses zero."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_discount").alias("k"), F.col("l_extendedprice").alias("v"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    joined = lines.join(orders, "l_orderkey")
    medians = materialise(ranks.median(materialise(joined.select("o_orderpriority", "k", "v"), "joined"), ["o_orderpriority", "k"], "v", "m"), "curve")  # read many times by the fits
    centre = medians.groupBy("o_orderpriority").agg(F.median("m").alias("c"))
    return medians.join(centre, "o_orderpriority").select(F.col("o_orderpriority").alias("run"), "k", (F.col("m") - F.col("c")).alias("y"))


_CURVE = """med AS (
  SELECT o_orderpriority AS run, l_discount AS k, median(l_extendedprice) AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2
), centre AS (
  SELECT run, median(m) AS c FROM med GROUP BY run
), curve AS (
  SELECT run, k, m - c AS y FROM med JOIN centre USING (run)
)"""


def fit_linear_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits.linear_zero(order_curve(spark, sf_dir), ["run"], "y"), 4)


def fit_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = order_curve(spark, sf_dir).withColumn("y", F.col("y") + F.lit(40000.0) * (F.col("k") - 0.13) * (F.col("k") - 0.04))
    return rounded(fits.quadratic_zero(curve, ["run"], "y").drop("quad", "slope", "intercept"), 5)


def theil_sen_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits.theil_sen_zero(order_curve(spark, sf_dir), ["run"], "y"), 4)


def first_zero_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fits.first_zero(order_curve(spark, sf_dir), ["run"], "k", "y"))


_LINE = """line AS (
  SELECT run, regr_slope(y, k) AS slope, regr_intercept(y, k) AS intercept, CASE WHEN var_pop(y) = 0 THEN 1.0 ELSE regr_r2(y, k) END AS r2 FROM curve GROUP BY run HAVING count(*) >= 2 AND regr_slope(y, k) <> 0
)"""


def bootstrap_values(spark: SparkSession, sf_dir: str):
    """Values by k and metric, and which of them a draw takes: arithmetic on row numbers, so that any engine draws the same."""
    rows = table(spark, sf_dir, "events").select(((F.col("event_id") % 9) / 100).alias("k"), "event_id", (F.abs(F.col("value") - F.lit(50.0) - 100 * (F.col("event_id") % 9))).alias("a"), F.abs(F.col("value") - 20).alias("b"))
    rows = cells.placed(cells.dealt(rows, ["k"], ["event_id"]), ["k"], ["event_id"])
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # whole numbers of 64 bits: a square of 32 bits overflows from 46,341 rows of a K
    rows = ranks.joined(rows, sizes, ["k"]).withColumn("i", F.col("_place").cast("long"))
    long = rows.unpivot(["k", "i", "n"], ["a", "b"], "metric", "value")
    return long, (F.col("i") * 7919 + F.col("draw") * 104729 + F.col("i") * F.col("i") % 1009 * 31) % F.col("n")


def bootstrap_kopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty draws with replacement."""
    long, index = bootstrap_values(spark, sf_dir)
    return rounded(fits.bootstrap_minima(long, [], 20, index, {"a": 1.0, "b": 0.5}))


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fits.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 30)


def bootstrap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, deviations, range and percentiles of the draws."""
    return rounded(fits.spread(bootstrap_kopt(spark, sf_dir), "k_opt"), 4)


_BOOT = (
    """base AS (
  SELECT (event_id % 9) / 100.0::DOUBLE AS k, event_id, abs(value - 50.0 - 100 * (event_id % 9)) AS a, abs(value - 20) AS b FROM events
), num AS (
  SELECT k, a, b, row_number() OVER (PARTITION BY k ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM base
), long AS (
  SELECT k, i, n, 'a' AS metric, a AS value FROM num UNION ALL SELECT k, i, n, 'b', b FROM num
), fixed AS (
  SELECT metric, max(abs(m)) AS s FROM (SELECT k, metric, median(value) AS m FROM long GROUP BY k, metric) GROUP BY metric
), drawn AS (
  SELECT k, metric, draw, (i * 7919 + draw * 104729 + i * i % 1009 * 31) % n AS pick FROM long, (SELECT unnest(range(20)) AS draw)
), med AS (
  SELECT draw, drawn.k AS k, drawn.metric AS metric, median(value) AS m FROM drawn JOIN long ON long.k = drawn.k AND long.metric = drawn.metric AND long.i = drawn.pick GROUP BY 1, 2, 3
), costs AS (
  SELECT draw, k, sum(CASE metric WHEN 'a' THEN 1.0 ELSE 0.5 END * m / s) AS cost FROM med JOIN fixed USING (metric) GROUP BY 1, 2
)"""
    + _minimum("costs", "cost", "draw")
)

QUERIES = {
    "kopt_composite": kopt_composite,
    "per_k_robust": per_k_robust,
    "per_metric_kopt": per_metric_kopt,
    "fit_linear_zero": fit_linear_zero,
    "fit_quadratic": fit_quadratic,
    "theil_sen_local": theil_sen_local,
    "first_zero_cross": first_zero_cross,
    "bootstrap_kopt": bootstrap_kopt,
    "bootstrap_summary": bootstrap_summary,
    "value_histogram": value_histogram,
}
ORACLES = {
    "kopt_composite": f"""WITH {_NORMAL}, costs AS (
  SELECT k, CASE WHEN count(v) = 3 THEN sum(CASE metric WHEN 'quantity' THEN 1.0 WHEN 'price' THEN 2.0 ELSE 0.5 END * v) END AS cost FROM norm GROUP BY k
){_minimum("costs", "cost")}
SELECT round(k, 6) AS k, round(cost, 6) AS cost, round(k_opt, 6) AS k_opt FROM costs, best""",
    "per_k_robust": f"""WITH {_LONG}
SELECT round(k, 6) AS k, metric, count(value) AS n, round(median(value), 6) AS median, round(1.4826 * mad(value), 6) AS mad, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM long GROUP BY k, metric""",
    "per_metric_kopt": f"""WITH {_NORMAL}{_minimum("norm", "v", "metric")}
SELECT metric, round(k_opt, 6) AS k_opt FROM best""",
    "fit_linear_zero": f"""WITH {_CURVE}, {_LINE}
SELECT run, round(-intercept / slope, 4) AS k_opt, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 4) AS r2 FROM line""",
    "fit_quadratic": f"""WITH {_CURVE.replace("SELECT run, k, m - c AS y", "SELECT run, k, m - c + 40000.0 * (k - 0.13) * (k - 0.04) AS y")}, {_LINE}, xs AS (
  SELECT run, k, y, avg(k) OVER (PARTITION BY run) AS c, k - avg(k) OVER (PARTITION BY run) AS x FROM curve
), s AS (
  SELECT run, min(c) AS c, count(*) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2, sum(y*y) AS yy, min(k) AS lo, max(k) AS hi, max(abs(y)) AS top FROM xs GROUP BY run
), d AS (
  SELECT *, s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2) AS det FROM s
), f AS (
  SELECT *, (t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0)) / det AS a, (s4*(t1*s0-t0*s1) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2)) / det AS b, (s4*(s2*t0-s1*t1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2)) / det AS q FROM d
), r AS (
  SELECT *, b*b - 4*a*q AS disc, c + (-b - sqrt(greatest(b*b - 4*a*q, 0))) / (2*a) AS root FROM f
), good AS (
  SELECT run, root AS k_opt, 1 - (yy - a*t2 - b*t1 - q*t0) / (yy - t0*t0/s0) AS r2, 'quadratic' AS method FROM r
  WHERE disc > 0 AND root BETWEEN lo - 0.2*(hi-lo) AND hi + 0.2*(hi-lo) AND abs(a)*(hi-lo)*(hi-lo) > 1e-10 * top
)
SELECT run, round(k_opt, 5) AS k_opt, round(r2, 5) AS r2, method FROM good
UNION ALL SELECT run, round(-intercept / slope, 5), round(r2, 5), 'linear' FROM line WHERE run NOT IN (SELECT run FROM good)""",
    "theil_sen_local": f"""WITH {_CURVE}, {_LINE}, num AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i, lead(y) OVER (PARTITION BY run ORDER BY k) AS nxt FROM curve
), flips AS (
  SELECT *, median(k) OVER (PARTITION BY run) AS mid FROM num WHERE y > 0 AND nxt <= 0
), cr AS (
  SELECT run, i AS c FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(k - mid), i) AS r FROM flips) WHERE r = 1
), loc AS (
  SELECT num.run, i, k, y FROM num JOIN cr USING (run) WHERE i > c - 5 AND i <= c + 5
), sl AS (
  SELECT a.run, median((b.y - a.y) / (b.k - a.k)) AS slope FROM loc a JOIN loc b ON a.run = b.run AND a.i < b.i GROUP BY a.run
), ts AS (
  SELECT loc.run, slope, median(y - slope * k) AS intercept, min(k) AS lo, max(k) AS hi FROM loc JOIN sl USING (run) GROUP BY loc.run, slope HAVING count(*) >= 3 AND slope <> 0
)
SELECT run, round(greatest(lo, least(hi, -intercept / slope)), 4) AS k_opt, round(slope, 4) AS slope, round(intercept, 4) AS intercept, 'theil_sen_local' AS method FROM ts
UNION ALL SELECT run, round(-intercept / slope, 4), round(slope, 4), round(intercept, 4), 'linear' FROM line WHERE run NOT IN (SELECT run FROM ts)""",
    "first_zero_cross": f"""WITH {_CURVE}, num AS (
  SELECT *, sign(first_value(y) OVER w) AS s0, lag(k) OVER w AS x0, lag(y) OVER w AS y0 FROM curve WINDOW w AS (PARTITION BY run ORDER BY k)
)
SELECT run, round(arg_min(x0 + (k - x0) * (-y0) / (y - y0), k), 6) AS k_zero FROM num WHERE sign(y) <> s0 AND x0 IS NOT NULL GROUP BY run""",
    "bootstrap_kopt": f"WITH {_BOOT} SELECT draw, round(k_opt, 6) AS k_opt FROM best",
    "bootstrap_summary": f"""WITH {_BOOT}, k AS (SELECT round(k_opt, 6) AS k FROM best)
SELECT round(avg(k), 4) AS mean, round(median(k), 4) AS median, round(stddev_samp(k), 4) AS std, round(min(k), 4) AS least, round(max(k), 4) AS most, round(quantile_cont(k, 0.05), 4) AS p05, round(quantile_cont(k, 0.95), 4) AS p95, round(quantile_cont(k, 0.75) - quantile_cont(k, 0.25), 4) AS iqr FROM k""",
    "value_histogram": """WITH e AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)
SELECT event_type, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 30)), 29) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1, 2""",
}
