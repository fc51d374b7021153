"""Scans and frames over series of any length: no window runs over a whole series.

A series is cut into cells along its order.  What a scan needs from earlier
cells (a sum, an extreme, the last value) is one row per cell; those rows are
scanned in turn and joined back.  A frame of rows around each row is cut by
places: every block of rows is given a margin of its neighbours' rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorloom.operators.ranks import joined
from sensorloom.sources.shared import materialise

#: Rows of a block of frames.
BLOCK = 65_536
PAST = Window.unboundedPreceding


def dealt(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows with `_cell`: contiguous stretches of each series of about even size, numbered along it.

    The order must be unique in a series, or ties of no matter.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *by, *order).withColumn("_cell", F.spark_partition_id()), "dealt")


def scan(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, highs: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> DataFrame:
    """Rows of dealt() with running sums, greatest and last values (nulls skipped, the row itself included), and the
    values of the row before (nulls included, null on the first)."""
    sums, highs, lasts, lags = sums or {}, highs or {}, lasts or {}, lags or {}
    at = F.struct(*order)
    w = Window.partitionBy(*by, "_cell").orderBy(*order)
    upto = w.rowsBetween(PAST, 0)
    inner = {k: F.sum(c).over(upto) for k, c in sums.items()} | {k: F.max(c).over(upto) for k, c in highs.items()} | {k: F.last(c, True).over(upto) for k, c in lasts.items()}
    boxed = {k: F.struct(c.alias("v")) for k, c in lags.items()}  # a box is never null, what it holds may be
    inner |= {k: F.lag(c).over(w) for k, c in boxed.items()}
    ends = [F.sum(c).alias(k) for k, c in sums.items()] + [F.max(c).alias(k) for k, c in highs.items()] + [F.max_by(c, F.when(c.isNotNull(), at)).alias(k) for k, c in lasts.items()] + [F.max_by(c, at).alias(k) for k, c in boxed.items()]
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(PAST, -1)  # one row per cell
    carried = {k: F.sum(k).over(before) for k in sums} | {k: F.max(k).over(before) for k in highs} | {k: F.last(k, True).over(before) for k in (*lasts, *lags)}
    carry = rows.groupBy(*by, "_cell").agg(*ends).select(*by, "_cell", *[c.alias(f"_from_{k}") for k, c in carried.items()])
    both = joined(rows.withColumns(inner), carry, [*by, "_cell"])
    done = {k: F.when(F.col(k).isNull(), F.col(f"_from_{k}")).otherwise(F.col(k) + F.coalesce(F.col(f"_from_{k}"), F.lit(0))) for k in sums}
    done |= {k: F.greatest(F.col(k), F.col(f"_from_{k}")) for k in highs} | {k: F.coalesce(F.col(k), F.col(f"_from_{k}")) for k in lasts} | {k: F.coalesce(F.col(k), F.col(f"_from_{k}"))["v"] for k in lags}
    return both.withColumns(done).drop(*[f"_from_{k}" for k in carried])


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of dealt() with `_place`, the place in the series, from 0."""
    return scan(rows, by, order, sums={"_place": F.lit(1).cast("long")}).withColumn("_place", F.col("_place") - 1)


def framed(rows: DataFrame, by: list[str], before: int, after: int, made: dict[str, Callable[[WindowSpec], Column]], within: list[str] | None = None) -> DataFrame:
    """Rows of placed() with columns over the frame of `before` rows back and `after` rows on.

    made: by name, a function of the frame.  `within` names columns that part
    a series further into stretches of rows that follow each other.
    """
    size = max(BLOCK, before, after)
    own = F.floor(F.col("_place") / size)
    at = F.col("_place") % size
    # a row near an edge also goes to the block beyond it
    blocks = F.array_compact(F.array(own, F.when(at >= size - before, own + 1), F.when((at < after) & (own > 0), own - 1)))
    spread = rows.withColumns({"_own": own, "_block": F.explode(blocks)})
    frame = Window.partitionBy(*by, *(within or []), "_block").orderBy("_place").rowsBetween(-before, after)
    return spread.withColumns({k: f(frame) for k, f in made.items()}).where("_own = _block").drop("_own", "_block")


def monotone_times(df: DataFrame, by: list[str], arrival: list[str], us: str, out: str) -> DataFrame:
    """Times in whole microseconds made to rise: one that isn't later than the one before it is put a microsecond after it.

    Pushed times cascade; the time at place i is i plus the greatest of t - i so far.
    """
    at = placed(dealt(df, by, arrival), by, arrival)
    found = scan(at, by, arrival, highs={"_high": F.col(us) - F.col("_place")})
    return found.withColumn(out, F.col("_high") + F.col("_place")).drop("_high", "_place", "_cell")
