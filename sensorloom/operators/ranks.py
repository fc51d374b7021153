"""Exact percentiles of groups of any size, by selection: no task ever holds a group's values.

A value at a rank lies in a cell, an interval of its group's values.  Each
round deals the values of all open cells into buckets, counts them with a
map-side combine, keeps for each rank the bucket that it falls into (with the
bucket's own least and largest value, so that outliers don't slow the search
down) and goes on with that as its cell.  A cell of one value is settled; one
of at most SMALL rows is sorted.  A group of a thousand million rows takes two
rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.sources.shared import materialise

BUCKETS = 1024
#: Rows of a cell that are sorted at once: half a megabyte.
SMALL = 65_536
#: Cells of at most this many rows go to all tasks; more are joined by their group.
BROADCAST_CELLS = 100_000


def percentiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float], counts: str | None = None) -> DataFrame:
    """(by, one column for each wanted fraction): percentiles with linear interpolation, as F.percentile() gives them.

    Nulls and NaN count as missing; a group without any value has nulls; a
    null key is a group.  `counts` names a column for the number of values.
    The rows are read once a round, so they should be cheap to read again.
    """
    names = [f"_g{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.when(~F.isnan(v), v).alias("_v"))
    groups = materialise(rows.groupBy(*names).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "groups")
    rows = rows.where("_v is not null")
    # each fraction needs the values at one or two ranks
    place = {k: F.lit(float(p)) * (F.col("_n") - 1) for k, p in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place.values()])))
    asked = groups.where("_n > 0").select(*names, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_size"))
    settled = []
    while True:
        asked = materialise(asked, "cells")
        settled.append(asked.where("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_at")))
        small = asked.where(f"_lo < _hi and _size <= {SMALL}")
        settled.append(_sorted(rows, small, names))
        large = asked.where(f"_lo < _hi and _size > {SMALL}")
        if large.isEmpty():
            break
        asked = _refined(rows, large, names)
    at = reduce(DataFrame.unionByName, settled)
    found = materialise(at, "ranks").groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_at"))).alias("_values"))
    met = joined(groups, found, names, "left")

    def between(x: Column) -> Column:
        low, high = F.floor(x), F.ceil(x)
        a, b = F.try_element_at("_values", low), F.try_element_at("_values", high)
        return F.when(low == high, a).otherwise((high - x) * a + (x - low) * b)

    own = [F.col(n).alias(c) for c, n in zip(by, names)]
    return met.select(*own, *([F.col("_n").alias(counts)] if counts else []), *[between(x).alias(k) for k, x in place.items()])


def median(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    return percentiles(df, by, value, {out: 0.5})


def joined(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join by group, null keys included."""
    b = b.withColumnsRenamed({n: f"_other_{n}" for n in names})
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_other_{n}")) for n in names], F.lit(True))
    return a.join(b, same, how).drop(*[f"_other_{n}" for n in names])


def _within(rows: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """The rows of each cell that is asked for: with _lo, _hi, _below."""
    cells = asked.groupBy(*names, "_lo", "_hi", "_below").agg(F.count("*").alias("_ranks"))
    if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return joined(rows, cells, names).where("_v >= _lo and _v <= _hi")


def _refined(rows: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """The buckets that the ranks fall into, as cells."""
    # halves, as the distance of two doubles may be too large for one
    at = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    cell = [*names, "_lo", "_hi", "_below"]
    bucket = F.least(F.floor(at * BUCKETS), F.lit(BUCKETS - 1))
    counted = _within(rows, asked, names).groupBy(*cell, bucket.alias("_b")).agg(F.count("*").alias("_size"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    along = Window.partitionBy(*cell).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    counted = counted.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_size").over(along), F.lit(0)))
    ranks = asked.groupBy(*cell).agg(F.collect_list("_rank").alias("_ranks")).withColumnsRenamed({"_lo": "_lo2", "_hi": "_hi2", "_below": "_below2"})
    met = joined(counted, ranks, names).where("_lo = _lo2 and _hi = _hi2 and _below = _below2")
    hit = met.withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_size")))))
    return hit.select(*names, "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), F.col("_start").alias("_below"), "_size")


def _sorted(rows: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """(group, _rank, _at) of cells of at most SMALL rows."""
    cell = [*names, "_lo", "_hi", "_below"]
    held = _within(rows, asked, names).groupBy(*cell).agg(F.sort_array(F.collect_list("_v")).alias("_sorted"))
    ranks = asked.select(*names, "_rank", F.col("_lo").alias("_lo2"), F.col("_hi").alias("_hi2"), F.col("_below").alias("_below2"))
    met = joined(ranks, held, names).where("_lo = _lo2 and _hi = _hi2 and _below = _below2")
    return met.select(*names, "_rank", F.element_at("_sorted", (F.col("_rank") - F.col("_below") + 1).cast("int")).alias("_at"))
