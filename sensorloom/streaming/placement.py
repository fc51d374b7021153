"""Force placed on the path while it is printed: one code for tables and streams.

Force and positions arrive apart, late and out of order.  Both are cut into
cells of time; a position also goes to the neighbouring cells that its reach
touches, so that a cell holds all that its force samples need.  A cell is one
group of bounded size (rate times length), whatever the run's length, and on a
stream it is given out once the slower of the two streams has passed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y")


def _micros(seconds: float) -> int:
    return round(seconds * 1e6)


def _sound(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def _at(points: Column, t: Column, reach: float) -> Column:
    """The value at t between the nearest points around it, held where one side has none within reach."""
    back = F.array_max(F.transform(F.filter(points, lambda p: (p["t"] <= t) & (p["t"] >= t - reach)), lambda p: F.struct(p["t"].alias("t"), (-p["v"]).alias("v"))))
    ahead = F.array_min(F.filter(points, lambda p: (p["t"] > t) & (p["t"] <= t + reach)))
    held = -back["v"]
    return F.when(back.isNull(), ahead["v"]).when(ahead.isNull() | (back["t"] == t), held).otherwise(held + (ahead["v"] - held) * (t - back["t"]) / (ahead["t"] - back["t"]))


def placed(force: DataFrame, positions: DataFrame, reach: float = 0.5, cell: float = 1.0, late: float = 5.0) -> DataFrame:
    """(run_id, seq, t, v, x, y): force samples with the position at their times.

    force: run_id, seq, t, v.  positions: run_id, axis ('x' or 'y'), t, v.
    A position is linear between the last point at or before a sample and the
    first after it, both within `reach` seconds, and held where only one is;
    samples without a point on either axis are left out.  Of points of one
    time the least value counts.  Points with a null or NaN time or value and
    samples with such a time take no part; a null run is a run; samples that repeat come
    back as often; other columns are not returned; without points or samples
    there are no rows.

    On streams, rows that are up to `late` seconds behind the newest of their
    stream are used, so the result is that of the table.  A stream's watermark
    begins at time 0: samples before it are given out by tables only.
    """
    width = _micros(cell)

    def start(t: Column) -> Column:
        return F.floor(t * 1e6 / width).cast("bigint")

    f = force.where(_sound("t")).select("run_id", start(F.col("t")).alias("_cell"), F.struct("seq", "t", F.col("v").cast("double").alias("v")).alias("_f"))
    p = positions.where(_sound("t") & _sound("v") & F.col("axis").isin(*AXES))
    p = p.select("run_id", F.explode(F.sequence(start(F.col("t") - reach), start(F.col("t") + reach))).alias("_cell"), "axis", F.struct("t", F.col("v").cast("double").alias("v")).alias("_p"))
    kinds = {"_f": f.schema["_f"].dataType, "axis": "string", "_p": p.schema["_p"].dataType}

    def side(df: DataFrame) -> DataFrame:
        df = df.withColumn("_ts", F.timestamp_micros(F.col("_cell") * width))
        if df.isStreaming:  # a point's cells begin up to `reach` after it and end up to `reach` before it
            df = df.withWatermark("_ts", f"{_micros(late + 2 * reach)} microseconds")
        return df.select("run_id", "_ts", *[F.col(k) if k in df.columns else F.lit(None).cast(t).alias(k) for k, t in kinds.items()])

    both = side(f).unionByName(side(p))
    groups = both.groupBy("run_id", F.window("_ts", f"{width} microseconds").alias("_w")).agg(F.collect_list("_f").alias("_f"), *[F.collect_list(F.when(F.col("axis") == a, F.col("_p"))).alias(f"_{a}") for a in AXES])
    full = groups.where(" and ".join(f"size({c}) > 0" for c in ("_f", "_x", "_y")))
    rows = F.transform("_f", lambda s: F.struct(s["seq"].alias("seq"), s["t"].alias("t"), s["v"].alias("v"), *[_at(F.col(f"_{a}"), s["t"], reach).alias(a) for a in AXES]))
    return full.select("run_id", F.inline(rows)).where("x is not null and y is not null")
